"""The streaming of the engine."""
