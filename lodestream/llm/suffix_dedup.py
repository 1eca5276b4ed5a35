"""Removal of repeated passages: every byte that a string of ``length`` bytes covers which also starts earlier.

Earlier means a smaller doc_id, or the same document and an earlier start. The suffixes that can matter are found,
dealt out and sorted as Spark jobs:

1. Every window of ``length`` bytes is named by the smallest keyed hash of its 32-byte grams (its minimizer); runs of
   windows with one minimizer are one segment. Equal windows have equal minimizers, so only segments whose minimizer
   occurs again anywhere are kept, by a grouped count over all segments.
2. Kept segments are cut from the texts and dealt by minimizer. Identical segments of a task are sent once, and the
   windows of a minimizer with more than ``HOT`` segments are dealt one by one by their content, so that a passage
   in a third of all documents is spread over the cluster.
3. Each task puts the suffixes of each minimizer's segments in order by deep-shallow sorting: a multikey quicksort on
   8-byte characters to a shallow depth, then blind tries for groups that still share their whole prefix. Neighbours in
   that order that agree on ``length`` bytes are equal strings; all but the earliest are repeated. The suffixes of one
   minimizer that are too many to be sorted at once are divided by a hash of their bytes, which equal ones share.
4. Repeated spans go back to their documents, are merged and cut out.

Defined cases: null and empty texts have nothing to remove; a text shorter than ``length`` is kept whole; rows without a
doc_id are kept whole and are never the earlier one; rows that repeat a doc_id with the same text have the same result
and are not earlier than each other, with another text the order is that of a 32-bit hash of the text (two texts
of one doc_id whose hashes are equal, one pair in four billion, are taken for one); very long texts are worked on in pieces that overlap; an empty table gives an empty result; other columns pass through, and those named like
a result column give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import in_tasks
from ._text import U, grouped, mix, text_bytes

GRAM, SHALLOW = 32, 24
#: Segments of one minimizer beyond which its windows are dealt one by one.
HOT = 50_000
#: Segments by which a task knows what it has sent before.
SEEN = 200_000
#: Windows of a segment at most, and bytes of a piece of a long text.
LONGEST, PIECE = 4095, 1 << 22
#: Windows that a task sorts at once (some 300 bytes each while they are sorted), and for which it gathers segments of several minimizers.
SORTED_AT_ONCE, GATHERED = 1 << 17, 1 << 16
_RUN = 13  # a segment is its start, 12 bits for its windows, and one that says whether its minimizer occurs twice in it
_PLACE = U(0xFFFFFF)


def _tag(text: bytes) -> int:
    """What tells texts of one doc_id apart."""
    return xxhash.xxh3_64_intdigest(text) >> 33


def _load(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as little-endian integers."""
    return np.ndarray(len(data) - 7, "<u8", data.data, strides=(1,))


def segments(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: text number, start, windows, minimizer, and whether it occurs twice in the run."""
    data = np.frombuffer(b"".join(texts) + bytes(GRAM), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    words = _load(data)
    n = len(words) - GRAM + 8
    gram = words[:n] * U(0x9E3779B97F4A7C15)
    for i, factor in enumerate((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5), 1):
        gram += words[8 * i : 8 * i + n] * U(factor)
    gram ^= gram >> U(32)
    gram *= U(0xD6E8FEB86659FD93)
    gram ^= gram >> U(29)
    low = (gram & ~_PLACE) | np.arange(n, dtype=np.uint64)
    span, reach = length - GRAM + 1, 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    windows = np.maximum(sizes - length + 1, 0)
    before = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), windows)
    first = np.cumsum(windows) - windows
    at = np.arange(len(owner)) - np.repeat(first - before, windows)
    low = low[at]
    moved = np.ones(len(low), bool)
    moved[1:] = (low[1:] ^ low[:-1]) > _PLACE
    moved[1:] |= owner[1:] != owner[:-1]
    begin = np.flatnonzero(moved)
    count = np.diff(np.append(begin, len(low)))
    if len(count) and count.max() > LONGEST:  # cut long runs
        parts = -(-count // LONGEST)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, left = np.repeat(begin, parts) + step * LONGEST, np.repeat(count, parts) - step * LONGEST
        count = np.minimum(left, LONGEST)
    twice = low[begin] != low[begin + count - 1] if len(begin) else np.zeros(0, bool)
    key = gram[(low[begin] & _PLACE).astype(np.int64)]
    who = owner[begin]
    return who, at[begin] - before[who], count, key.view(np.int64), twice | (count >= LONGEST)


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            pieces, owners, tags, places = [], [], [], []
            for doc, text in zip(ids, text_bytes(batch.column("text")), strict=True):
                if doc is None or len(text) < length:
                    continue
                tag = _tag(text)
                for at in range(0, len(text) - length + 1, PIECE):
                    pieces.append(text[at : at + PIECE + length - 1])
                    owners.append(doc)
                    tags.append(tag)
                    places.append(at)
            for lo, hi in grouped(pieces):
                who, start, count, key, twice = segments(pieces[lo:hi], length)
                owner, place = (np.array(x[lo:hi], np.int64)[who] for x in (owners, places))
                tag = np.array(tags[lo:hi], np.int32)[who]
                packed = (place + start) << _RUN | count << 1 | twice
                yield pa.record_batch([pa.array(x) for x in (key, owner, tag, packed)], ["key", "doc_id", "tag", "segment"])

    return run


def _cut(length: int):
    """Segments to sort, sent once for each content; those seen before at an earlier place are known to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int, int]] = {}
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            found = batch.column("__found")
            ends = found.offsets.to_numpy()
            fields = {f: found.values.field(f).to_numpy(zero_copy_only=False) for f in ("key", "tag", "segment", "hot")}
            for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True)):
                if doc is None:
                    continue
                own = slice(ends[i], ends[i + 1])
                tag = _tag(text) if ends[i + 1] > ends[i] else None
                for key, owner, segment, hot in zip(*(x[own].tolist() for x in fields.values()), strict=True):
                    if owner != tag:
                        continue
                    start, n = segment >> _RUN, (segment & (1 << _RUN) - 1) >> 1
                    for at, many in ((start + j, 1) for j in range(n)) if hot else ((start, n),):
                        part = text[at : at + many + length - 1]
                        name = xxhash.xxh3_128_digest(part)
                        here = (doc, tag, at)
                        first = seen.get(name)
                        if first == here:
                            continue  # a row that repeats a doc_id and text: the same place
                        known = first is not None and first < here
                        if not known:
                            seen[name] = here
                        route = doc if known else int.from_bytes(name[:8], "little", signed=True) if hot else key
                        for column, value in zip(rows, (route, *here, many, None if known else part), strict=True):
                            column.append(value)
                if len(seen) > SEEN:
                    seen.clear()
                if len(rows[0]) > 50_000:
                    yield _batch(rows)
                    rows = ([], [], [], [], [], [])
            yield _batch(rows)

    return run


_SEGMENT = "route long, doc_id long, tag int, place long, n int, part binary"


def _batch(rows: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.record_batch([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["route", "doc_id", "tag", "place", "n", "part"])


def _heads(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group begins and how many members it has; a group's members are neighbours."""
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    return head, np.diff(np.r_[head, len(group)])


def _ternary(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step of quicksort in every group: for each member its new place, the new groups, and whether its key is the pivot.

    The pivot is the median of a group's first, middle and last key; members keep their order on either side of it.
    """
    head, size = _heads(group)
    a, b, c = key[head], key[head + size // 2], key[head + size - 1]
    pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
    less, same = key < pivot, key == pivot
    first = np.repeat(head, size)
    before = [np.r_[0, np.cumsum(x)] for x in (less, same)]
    n_less, n_same = (x[head + size] - x[head] for x in before)
    rank_less, rank_same = (x[:-1] - x[first] for x in before)
    rank_more = np.arange(len(key)) - first - rank_less - rank_same
    skip_less, skip_same = np.repeat(n_less, size), np.repeat(n_same, size)
    to = first + np.where(less, rank_less, skip_less + np.where(same, rank_same, skip_same + rank_more))
    fresh = np.zeros(len(key) + 1, bool)
    fresh[head] = fresh[head + n_less] = fresh[head + n_less + n_same] = True
    return to, np.cumsum(fresh[:-1]) - 1, same


def _by_byte(group: np.ndarray, byte: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order members by group and byte; number the groups of equal bytes anew."""
    order = np.lexsort((byte, group))
    who, group, byte = who[order], group[order], byte[order]
    fresh = np.ones(len(who), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (byte[1:] != byte[:-1])
    return who, np.cumsum(fresh) - 1


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int, shallow: int = SHALLOW, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Member numbers of the suffixes ``starts`` of ``data`` in ascending order of their first ``length`` bytes, equal ones by
    number, and for each whether it agrees with the one before it. With ``group`` each group's suffixes are put in order apart.

    Shallow: a multikey quicksort on 8-byte characters. A group is divided into those below, at and above its pivot, and those at it
    go on with the next character, down to ``shallow`` bytes; the steps of all groups are taken side by side. Deep: groups
    that are left go into blind tries, one per group and all a level at a time: a node skips to the first byte at which a
    member differs from the group's first (no byte before it is branched on) and branches on that byte.
    """
    words = _load(data)
    group = np.zeros(len(starts), np.int64) if group is None else group
    order = np.argsort(group, kind="stable")
    equal = np.zeros(len(order), bool)
    slot, group, reach = np.arange(len(order)), group[order], np.zeros(len(order), np.int64)  # places still open
    end = min(shallow, length) & ~7
    deep: list[tuple[np.ndarray, np.ndarray]] = []
    while len(slot):
        _, size = _heads(group)
        several, done = np.repeat(size > 1, size), reach >= end
        if (several & done).any():
            deep.append((slot[several & done], group[several & done]))
        keep = several & ~done
        slot, group, reach = slot[keep], group[keep], reach[keep]
        if not len(slot):
            break
        who = order[slot]
        to, group, same = _ternary(group, words[starts[who] + reach].byteswap())
        order[slot[to]] = who
        reach[to] = reach + 8 * same
    slot, group = (np.concatenate(x) for x in zip(*((s, g + (i << 40)) for i, (s, g) in enumerate(deep)), strict=True)) if deep else (slot, group)
    reach = np.full(len(slot), end, np.int64)  # bytes on which a member's group agrees
    while len(slot):
        who = order[slot]
        head, size = _heads(group)
        first = np.repeat(starts[who[head]], size)
        same, open_ = reach.copy(), np.arange(len(who))
        while len(open_):
            at = same[open_]
            apart = words[starts[who[open_]] + at] ^ words[first[open_] + at]
            bits = apart & (~apart + U(1))  # the lowest bit that differs
            agree = np.where(apart == 0, 8, np.log2(np.maximum(bits, U(1)).astype(np.float64)).astype(np.int64) >> 3)
            same[open_] = np.minimum(at + agree, length)
            open_ = open_[(apart == 0) & (same[open_] < length)]
        node = np.minimum.reduceat(same, head)
        leaf = np.repeat(node >= length, size)
        leaf_tail = leaf.copy()
        leaf_tail[head] = False
        equal[slot[leaf_tail]] = True
        slot, group, who, reach = slot[~leaf], group[~leaf], who[~leaf], np.repeat(node, size)[~leaf]
        if len(slot):
            who, group = _by_byte(group, data[starts[who] + reach], who)
            order[slot] = who
            _, size = _heads(group)
            keep = np.repeat(size > 1, size)
            slot, group, reach = slot[keep], group[keep], reach[keep] + 1  # the same for all of a group, in whatever order
    return order, equal


def deep_shallow(data: np.ndarray, starts: np.ndarray, length: int, shallow: int = SHALLOW, group: np.ndarray | None = None) -> list[np.ndarray]:
    """Groups (ascending member numbers) of the suffixes ``starts`` of ``data`` that agree on ``length`` bytes."""
    order, equal = suffix_order(data, starts, length, shallow, group)
    begin = np.flatnonzero(equal & ~np.r_[False, equal[:-1]]) - 1
    end = np.flatnonzero(equal & ~np.r_[equal[1:], False]) + 1
    return [order[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]


def _portions(data: np.ndarray, starts: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """Ascending numbers of the windows ``starts`` of ``data`` to be sorted at once; equal windows are in one portion.

    More than ``SORTED_AT_ONCE`` are divided by a hash of all their bytes.
    """
    many = -(-len(starts) // SORTED_AT_ONCE)
    if many < 2:
        yield np.arange(len(starts))
        return
    words, drawn = _load(data), np.empty(len(starts), np.uint32)
    for lo in range(0, len(starts), SORTED_AT_ONCE):
        at = starts[lo : lo + SORTED_AT_ONCE]
        name = np.zeros(len(at), np.uint64)
        for i in (*range(0, length - 8, 8), length - 8):
            name = mix(name ^ words[at + i])
        drawn[lo : lo + len(at)] = name % U(many)
    order = np.argsort(drawn, kind="stable")
    yield from np.split(order, np.cumsum(np.bincount(drawn, minlength=many))[:-1])


def repeated(parts: list[tuple], length: int, keys: list[int] | None = None) -> list[tuple]:
    """``(document, place, bytes)`` of the spans of repeated windows in segments ``(document, place, windows, bytes)``.

    Equal windows have equal ``keys`` where these are given.
    """
    spans, own, groups, seen = [], [], [], {}
    for i in sorted(range(len(parts)), key=parts.__getitem__):
        doc, place, n, part = parts[i]
        if part not in seen:
            seen[part] = doc, place
            own.append(parts[i])
            groups.append(0 if keys is None else keys[i])
        elif seen[part] != (doc, place):  # rows that repeat a doc_id and text send the same segment
            spans.append((doc, place, n + length - 1))
    counts = np.array([x[2] for x in own], np.int64)
    sizes = np.array([len(x[3]) for x in own], np.int64)
    data = np.frombuffer(b"".join(x[3] for x in own) + bytes(16), np.uint8)
    owner = np.repeat(np.arange(len(own), dtype=np.int32), counts)
    starts = np.arange(len(owner))
    starts += np.repeat(np.cumsum(sizes) - sizes - np.cumsum(counts) + counts, counts)
    group = np.array(groups, np.int64)
    again = np.zeros(len(starts) + 1, bool)
    for some in _portions(data, starts, length):
        order, equal = suffix_order(data, starts[some], length, group=group[owner[some]])
        again[some[order[equal]]] = True  # of equal ones the first is the earliest: members are numbered in the order of places
    flag = again[:-1]
    new = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
    begin = np.flatnonzero(flag & (new | ~np.r_[False, flag[:-1]]))
    stop = np.flatnonzero(flag & (np.r_[new[1:], True] | ~again[1:]))
    step = begin - (np.cumsum(counts) - counts)[owner[begin]]
    for b, e, at in zip(begin.tolist(), stop.tolist(), step.tolist(), strict=True):
        doc, place, _, _ = own[owner[b]]
        spans.append((doc, place + at, e - b + length))
    return spans


def _sort(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, keys, size, last = [], [], 0, None

        def out(spans: list) -> pa.RecordBatch:
            flat = [(*doc, place, n) for doc, place, n in spans]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array([x[i] for x in flat], k) for i, k in enumerate(kinds)], ["doc_id", "tag", "place", "bytes"])

        for batch in batches:
            known = []
            for route, doc, tag, place, n, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part is None:
                    known.append(((doc, tag), place, n + length - 1))
                    continue
                if size > GATHERED and route != last:
                    yield out(repeated(waiting, length, keys))
                    waiting, keys, size = [], [], 0
                waiting.append(((doc, tag), place, n, part))
                keys.append(route)
                size, last = size + n, route
            yield out(known)
        if waiting:
            yield out(repeated(waiting, length, keys))

    return run


def _remove(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("__spans")
            ends, flat = found.offsets.to_numpy(), [found.values.field(f).to_numpy(zero_copy_only=False) for f in ("tag", "place", "bytes")]
            total, gone, runs, kept = [], [], [], []
            for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True)):
                tag, begin, many = (x[ends[i] : ends[i + 1]] for x in flat)
                total.append(len(text))
                if len(tag):
                    own = (tag == _tag(text)) & (doc is not None)
                    begin, many = begin[own], many[own]
                if not len(begin):
                    gone.append(0), runs.append(0), kept.append(text)
                    continue
                order = np.argsort(begin)
                begin, end = begin[order], np.maximum.accumulate((begin + many)[order])
                head = np.r_[True, begin[1:] > end[:-1]]
                begin, end = begin[head], end[np.r_[np.flatnonzero(head)[1:] - 1, len(end) - 1]]
                runs.append(len(begin))
                gone.append(int((end - begin).sum()))
                kept.append(b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True)))
            made = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.record_batch([*(batch.column(c) for c in names), *made], [*names, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs(doc_id, text, ...)`` with n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes left)."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = {"n_bytes", "n_removed", "n_spans", "kept"}
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).select([c for c in docs.columns if c not in made])
    # The three uses of the texts share one exchange by doc_id, and both uses of the segments one by minimizer.
    # Rows without a doc_id have a place by their text, and nothing that is found there concerns them.
    placed = docs.withColumn("__key", F.coalesce("doc_id", F.xxhash64("text"))).repartition(n, "__key")
    kinds = T.StructType([T.StructField(c, T.IntegerType() if c == "tag" else T.LongType(), False) for c in ("key", "doc_id", "tag", "segment")])
    anchors = placed.transform(in_tasks, _anchors(length), kinds).repartition(n, "key")
    # The maximum reads every column, and the joins with the texts are outer ones, so that the exchanges are the same.
    counts = anchors.groupBy("key").agg(F.count("*").alias("m"), F.max(F.struct(F.col("segment").bitwiseAND(1).alias("twice"), "doc_id", "tag"))["twice"].alias("t"))
    counts = counts.where("m > 1 or t = 1").select("key", (F.col("m") > HOT).alias("hot"))
    chosen = anchors.join(counts, "key").groupBy(F.col("doc_id").alias("__key")).agg(F.collect_set(F.struct("key", "tag", "segment", "hot")).alias("__found"))  # rows may repeat
    parts = placed.join(chosen, "__key", "left").transform(in_tasks, _cut(length), _SEGMENT)
    spans = parts.repartition(n, "route").sortWithinPartitions("route").transform(in_tasks, _sort(length), "doc_id long, tag int, place long, bytes long")
    spans = spans.groupBy(F.col("doc_id").alias("__key")).agg(F.collect_list(F.struct("tag", "place", "bytes")).alias("__spans"))
    joined = placed.join(spans, "__key", "left").withColumn("__spans", F.coalesce("__spans", F.from_json(F.lit("[]"), "array<struct<tag:int,place:long,bytes:long>>")))
    extra = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType())]
    return joined.transform(in_tasks, _remove(docs.columns), T.StructType([*docs.schema.fields, *extra]))


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with repeated bytes cut out of each text (and n_chars of what is left, if there is such a column).

    What is left of a character that was cut in two becomes U+FFFD.
    """
    cut = remove_repeats(docs, length)
    left = F.make_valid_utf8(F.col("kept").cast("string"))
    cut = cut.withColumn("text", F.when(F.col("n_removed") > 0, left).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return cut.select([c for c in docs.columns if c in cut.columns])
