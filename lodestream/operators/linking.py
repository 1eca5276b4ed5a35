"""Links between chunks of one page and of neighbouring pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The order of modalities on a page.
MODALITIES = ["text", "tables", "images"]


def modality_rank(modality: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MODALITIES)), modality)


def _pages(chunks: DataFrame) -> DataFrame:
    """A row per page with its chunk ids in order; a page is what bounds the list."""
    place = F.struct(modality_rank(F.col("modality")).alias("m"), "block_no", "chunk_index", "chunk_id")
    return chunks.where("page is not null").groupBy("source", "page").agg(
        F.transform(F.sort_array(F.collect_list(place)), lambda x: x["chunk_id"]).alias("ids"),
        F.max((F.col("modality") == "tables").cast("int")).cast("boolean").alias("has_table_on_page"),
        F.max((F.col("modality") == "images").cast("int")).cast("boolean").alias("has_image_on_page"),
        F.count("*").alias("page_chunk_count"),
    )


def link_chunks(chunks: DataFrame, window: int = 1, limit: int = 10) -> DataFrame:
    """``chunks(source, page, modality, block_no, chunk_index, chunk_id, ...)`` with siblings, adjacent chunks and page flags.

    Siblings are the other ids of the page, adjacent ones those of pages up to ``window`` away, lower pages first; both are cut to
    ``limit``, while ``n_links`` counts all. Rows without a page have no links. Pages are joined with their neighbours
    by an equi-join on shifted page numbers.
    """
    pages = _pages(chunks)
    steps = [d for d in range(-window, window + 1) if d]
    near = pages.select("source", F.explode(F.array(*(F.struct((F.col("page") - d).cast("int").alias("page"), F.lit(d).alias("step")) for d in steps))).alias("at"), "ids")
    near = near.select("source", F.col("at.page").alias("page"), F.struct(F.col("at.step").alias("step"), "ids").alias("part"))
    near = near.groupBy("source", "page").agg(F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda x: x["ids"])).alias("adjacent"))
    placed = chunks.join(pages, ["source", "page"], "left").join(near, ["source", "page"], "left")
    none = F.array().cast("array<string>")
    others = F.coalesce(F.filter("ids", lambda x: x != F.col("chunk_id")), none)
    adjacent = F.coalesce("adjacent", none)
    return placed.select(
        *chunks.columns,
        F.slice(others, 1, limit).alias("sibling_chunk_ids"), F.slice(adjacent, 1, limit).alias("adjacent_chunk_ids"),
        F.coalesce("has_table_on_page", F.lit(False)).alias("has_table_on_page"), F.coalesce("has_image_on_page", F.lit(False)).alias("has_image_on_page"),
        F.coalesce("page_chunk_count", F.lit(0)).cast("long").alias("page_chunk_count"), (F.size(others) + F.size(adjacent)).cast("long").alias("n_links"),
    )


def document_id(path: Column, checksum: Column) -> Column:
    """A name made of the file's stem and a digest of its path and content: the same file has the same id again."""
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    return F.concat(F.lit("doc_"), stem, F.lit("_"), F.substring(F.sha2(F.concat(path, checksum), 256), 1, 8))
