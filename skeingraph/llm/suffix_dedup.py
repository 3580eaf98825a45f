"""Removal of repeated byte strings with suffix arrays, across all documents.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else, in
the same document or another.  All strings are judged on the input.

1. The smallest hash of the 32-byte substrings of a window of ``length`` bytes is its
   anchor.  Equal windows have equal anchors, and neighbouring windows of one anchor form a
   segment (of at most 4096 windows), so a run of one byte is a few segments and not one
   for each byte.  Segments are written once, some 1.2 for each 100 bytes.
2. Segments of one content (anchor, 64 bits of hash, length) are counted, combined batch by
   batch before the shuffle.  Contents whose anchor occurs at one place only, their own inside included, are unique.  Of all others
   the bytes are cut out of the texts, of a content that occurs twice or more at two places.
3. The contents that share an anchor meet in one task, and their suffixes are sorted.  A
   window repeats if its neighbour in the array has a common prefix of ``length`` bytes or
   more; the bytes are compared.  What holds for a content holds wherever it occurs.
4. Sorting is in two stages: only suffixes smaller than their successors are sorted
   directly (to the depth that matters); the others are induced from them by one scan
   over the buckets of first bytes.
5. An anchor of very many distinct contents is dealt to several tasks: its windows are cut
   by how far from their start the anchor lies, and windows of one range share the bytes
   around the anchor, which are their new anchor.  Ranges shrink until no task has too many;
   the last hold windows that are equal, so it ends.  The suffix arrays of the parts decide.

Wrong unions need two contents of one anchor that agree in 64 bits of hash and in length:
for an anchor with 10^6 contents a chance of 3e-8.  Documents are told apart by 96 bits.

Null and empty texts, and texts shorter than ``length``, lose nothing.  Rows that repeat
are separate documents, so all their strings start elsewhere too.  Null ids stay null.
Other columns of the input are not looked at.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut, drop, settings
from ._arrays import RollingHash, batch_text, mix, small_batches, text_blocks

#: Bytes of an anchor, windows of a segment, bytes of contents sorted at once.
ANCHOR, LONGEST, CHUNK_BYTES = 32, 4096, 2 << 20
#: Distinct contents of an anchor beyond which it is dealt to several tasks, and the ranges that it is cut to in turn.
CROWD, RANGES = 20_000, (43, 11, 3, 1)
#: A content with more occurrences than this, and than a ten-thousandth of all segments, is matched by broadcast.
OFTEN = 1000
_SEPARATOR = 255


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Per segment of a block: row, start in the row, windows, anchor, content hash, whether the anchor recurs inside."""
    gram = min(ANCHOR, length)
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    rolling = RollingHash(data, seed=5)
    hashes = _anchors(rolling, gram)
    anchor = _sliding_min(hashes, length - gram + 1)
    opens = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, offsets[:-1], np.maximum(offsets[1:] - length + 1, 0)))
    opens = np.unique(opens[opens < n])
    # A run of windows lies in one row whole or reaches over its end from the first.
    row = np.searchsorted(offsets, opens, side="right") - 1
    windows = np.diff(np.append(opens, n))
    inside = opens + length <= offsets[row + 1]
    row, opens, windows = row[inside], opens[inside], windows[inside]
    parts = -(-windows // LONGEST)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    row, opens, windows = (np.repeat(x, parts) for x in (row, opens, windows))
    start, windows = opens + nth * LONGEST, np.minimum(windows - nth * LONGEST, LONGEST)
    size = windows + length - 1
    name = mix(rolling.ranges(start, start + size) + size.astype(np.uint64) * np.uint64(31))
    return row, start - offsets[row], windows, anchor[start], name, _recurs(hashes, start, windows, length - gram + 1)


def _recurs(hashes: np.ndarray, start: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """Whether the anchor's first place in a segment's first window is another than its last place in the last window."""
    out = windows > width
    view = np.lib.stride_tricks.sliding_window_view(hashes, width)
    few = np.flatnonzero(~out)
    for some in np.split(few, range(4096, len(few), 4096)):
        first, last = start[some], start[some] + windows[some] - 1
        out[some] = first + view[first].argmin(axis=1) < last + width - 1 - view[last][:, ::-1].argmin(axis=1)
    return out


def _anchors(rolling: RollingHash, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes at each place; one-to-one with their rolling hash."""
    hashes = rolling.grams(gram)
    return (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


def _names(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    return mix(RollingHash(data, seed=seed).ranges(start, start + size) + size.astype(np.uint64) * np.uint64(31))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _words(data: np.ndarray, depth: int) -> np.ndarray:
    """The 8 bytes from each place on, as one big-endian number; zeros follow the end."""
    padded = np.zeros(len(data) + depth + 8, dtype=np.uint64)
    padded[: len(data)] = data
    out = (padded[:-1] << np.uint64(8)) | padded[1:]
    out = (out[:-2] << np.uint64(16)) | out[2:]
    return (out[:-4] << np.uint64(32)) | out[4:]


def _sorted_directly(places: np.ndarray, data: np.ndarray, words: np.ndarray, depth: int, ends: np.ndarray) -> np.ndarray:
    """``places`` by the first ``depth`` bytes of their suffixes, eight bytes at a time.

    Suffixes that are equal to the whole depth, or to the end of their strings, need no order
    among them: by a hash of those bytes one of them is sorted for all.  (Should two others
    agree in 64 bits, a repeat could stay unseen; none is made up, since bytes are compared.)
    """
    if not len(places):
        return places
    stop = np.minimum(places + depth, ends[places])
    whole = mix(RollingHash(data, seed=8).ranges(places, stop) + (stop - places).astype(np.uint64) * np.uint64(31))
    by = np.argsort(whole, kind="stable")
    new = np.flatnonzero(np.concatenate(([True], whole[by[1:]] != whole[by[:-1]])))
    size = np.diff(np.append(new, len(by)))
    chosen = _sorted_distinct(places[by[new]], words, depth)
    # Members of a class lie together in ``by``.
    size, new = size[chosen], new[chosen]
    at = np.repeat(new - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(len(by))
    return places[by[at]]


def _sorted_distinct(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """The order of ``places`` by their suffixes; only groups that differ in the next eight bytes are sorted again."""
    order = np.argsort(words[places])
    key = words[places[order]]
    group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
    spot = np.flatnonzero(np.bincount(group)[group] > 1)
    group = group[spot]
    for done in range(8, depth, 8):
        if not len(spot):
            break
        key = words[places[order[spot]] + done]
        opens = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(opens, len(group)))
        differ = np.repeat(np.minimum.reduceat(key, opens) != np.maximum.reduceat(key, opens), size)
        moved = np.flatnonzero(differ)
        if not len(moved):
            continue
        by = np.lexsort((key[moved], group[moved]))
        order[spot[moved]] = order[spot[moved[by]]]
        key[moved] = key[moved[by]]
        group = np.cumsum(np.concatenate(([0], (group[1:] != group[:-1]) | (key[1:] != key[:-1]))))
        tied = np.bincount(group)[group] > 1
        spot, group = spot[tied], group[tied]
    return order


def suffix_array(data: np.ndarray, depth: int, ends: np.ndarray | None = None) -> np.ndarray:
    """Places of all suffixes, sorted by their first ``depth`` bytes, in two stages.

    ``ends`` has for each place where its string ends; what follows there need not be sorted.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[-1] = -1  # the empty suffix is smaller than the last
    decides = np.minimum.accumulate(np.where(step != 0, np.arange(n), n)[::-1])[::-1]
    rises = step[decides] > 0
    direct = _sorted_directly(np.flatnonzero(rises), data, _words(data, depth), depth, np.full(n, n) if ends is None else ends)
    first = data[direct]
    cuts = np.searchsorted(first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[data[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        falling = induced[c]
        for places in falling:  # grows by the runs of this byte
            before = places[places > 0] - 1
            before = before[data[before] == c]
            if len(before):
                falling.append(before)
        bucket = np.concatenate([*falling, direct[cuts[c] : cuts[c + 1]]]) if falling or cuts[c] < cuts[c + 1] else direct[:0]
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[data[before] > c]
        byte = data[before]
        by = np.argsort(byte, kind="stable")
        before, byte = before[by], byte[by]
        for part in np.split(before, np.flatnonzero(np.diff(byte)) + 1):
            if len(part):
                induced[data[part[0]]].append(part)
    return np.concatenate(out)


def repeated_windows(data: np.ndarray, valid: np.ndarray, length: int, ends: np.ndarray | None = None) -> np.ndarray:
    """Marks each place of ``valid`` whose ``length`` bytes also start at another place."""
    order = suffix_array(data, length, ends)
    words = _words(data, length)
    order = order[valid[order]]
    after = np.full(len(data) + 1, -1, dtype=np.int64)
    after[order[:-1]] = order[1:]
    one = np.flatnonzero(after >= 0)
    two = after[one]
    # Where the pair before, one place back, has its prefix, the eight bytes at the end are all that is left to compare.
    shifted = np.concatenate(([False], (one[1:] == one[:-1] + 1) & (two[1:] == two[:-1] + 1)))[: len(one)]
    same = np.zeros(len(one), dtype=bool)
    heads = np.flatnonzero(~shifted)
    same[heads] = _equal(words, one[heads], two[heads], range(0, length - 7, 8), length)
    tails = np.flatnonzero(shifted)
    same[tails] = _equal(words, one[tails], two[tails], (), length)
    fails = np.concatenate(([0], np.cumsum(~same)))
    run = heads[np.cumsum(~shifted) - 1] if len(heads) else heads
    doubtful = np.flatnonzero(shifted & same & (fails[:-1] > fails[run]))
    same[doubtful] = _equal(words, one[doubtful], two[doubtful], range(0, length - 7, 8), length)
    marked = np.zeros(len(data), dtype=bool)
    marked[one[same]] = True
    marked[two[same]] = True
    return marked


def _equal(words: np.ndarray, one: np.ndarray, two: np.ndarray, places: Iterable[int], length: int) -> np.ndarray:
    """Which pairs agree in the eight bytes at each of ``places`` and in the last of ``length``."""
    active = np.arange(len(one))
    for done in [max(0, length - 8), *places]:
        a, b = words[one[active] + done], words[two[active] + done]
        if length < 8:
            a, b = a >> np.uint64(64 - 8 * length), b >> np.uint64(64 - 8 * length)
        active = active[a == b]
    out = np.zeros(len(one), dtype=bool)
    out[active] = True
    return out


_SEGMENT = "anchor long, content long, windows int, key long, key2 int, start int, n long, again boolean"


def _emit_segments(length: int):
    """Segments of each document; of a content in a batch, two occurrences stand for all (``n``) and the others have 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for first, end, data, offsets in text_blocks(batch.column(2)):
                row, start, windows, anchor, content, again = segments(data, offsets, length)
                held.append((anchor, content, windows, row + first, start, again))
            if not held:
                continue
            anchor, content, windows, row, start, again = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.lexsort((content, anchor))
            anchor, content, windows, row, start, again = (x[by] for x in (anchor, content, windows, row, start, again))
            new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])))[: len(anchor)]
            opens = np.flatnonzero(new)
            size = np.diff(np.append(opens, len(anchor)))
            n = np.zeros(len(anchor), dtype=np.int64)
            n[opens] = np.maximum(size - 1, 1)
            n[opens[size > 1] + 1] = 1
            keys = [batch.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1)]
            columns = (anchor.view(np.int64), content.view(np.int64), windows.astype(np.int32), *keys, start.astype(np.int32), n, again)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor", "content", "windows", "key", "key2", "start", "n", "again"])

    return run


_PIECE = "bucket long, id long, rep int, windows int, bytes binary"


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The ranges of ``data`` as binary values."""
    offsets = np.concatenate(([0], np.cumsum(size)))
    index = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[index])])


def _listed(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The row of each struct in a column of lists, and the structs' fields."""
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    flat = column.flatten()
    return row, {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}


def _cut_out(length: int):
    """Contents of the segments that a document was asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch.column(0)):
                row, x = _listed(batch.column(1).slice(first, end - first))
                held = _gather(data, offsets[row] + x["start"], x["windows"].astype(np.int64) + length - 1)
                columns = [pa.array(x["bucket"], pa.int64()), pa.array(x["id"], pa.int64()), pa.array(x["rep"], pa.int32()), pa.array(x["windows"], pa.int32()), held]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "id", "rep", "windows", "bytes"])

    return run


def _split(length: int, width: int):
    """Pieces cut by the distance of the anchor from a window's start, with the bytes that all windows of a piece share around it as their bucket."""
    gram = min(ANCHOR, length)

    def pieces(bucket: int, id_: int, windows: int, raw: bytes) -> Iterator[tuple]:
        data = np.frombuffer(raw, dtype=np.uint8)
        hashes = _anchors(RollingHash(data, seed=5), gram)
        at = np.arange(windows)
        least = _sliding_min(hashes, length - gram + 1)[0]
        places = np.flatnonzero(hashes == least)
        anchor = places[np.searchsorted(places, at)]
        part = (anchor - at) // width
        opens = np.flatnonzero(np.concatenate(([True], (np.diff(part) != 0) | (np.diff(anchor) != 0))))
        size = np.diff(np.append(opens, windows)) + length - 1
        # Windows of a part reach from the least distance before the anchor to the greatest behind it.
        low, high = part[opens] * width, np.minimum(part[opens] * width + width - 1, length - gram)
        around = RollingHash(data, seed=7).ranges(np.maximum(anchor[opens] - low, 0), np.minimum(anchor[opens] - high + length, len(data)))
        to = mix(around + np.uint64(bucket % (1 << 64)) * np.uint64(5) + part[opens].astype(np.uint64))
        one, two = _names(data, opens, size, 6), _names(data, opens, size, 9)
        for i, start in enumerate(opens):
            yield int(to[i].view(np.int64)), int(one[i].view(np.int64)), int(two[i].view(np.int64)), id_, int(start), int(size[i]) - length + 1, raw[start : start + size[i]]

    schema = pa.schema([("bucket", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("owner", pa.int64()), ("at", pa.int32()), ("windows", pa.int32()), ("bytes", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [p for row in zip(*(batch.column(i).slice(at, 256).to_pylist() for i in (0, 1, 3, 4)), strict=True) for p in pieces(*row)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


_FINE = "bucket long, one long, two long, owner long, at int, windows int, bytes binary"
_SPAN = "id long, at int, windows int"


def _sort_contents(length: int):
    """Repeated windows of pieces that come grouped by bucket, some buckets at a time."""

    def spans(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        column = lambda name: table.column(name).chunk(0)
        raw, offsets = batch_text(column("bytes").cast(pa.large_binary()).view(pa.large_string()))
        size, windows = np.diff(offsets), column("windows").to_numpy()
        from_ = offsets[:-1] + np.arange(len(size))
        data = np.full(len(raw) + len(size), _SEPARATOR, dtype=np.uint8)
        data[np.arange(len(raw)) + np.repeat(np.arange(len(size)), size)] = raw
        valid = np.zeros(len(data) + 1, dtype=np.int8)
        valid[from_] += 1
        valid[from_ + windows] -= 1
        marked = repeated_windows(data, np.cumsum(valid[:-1]) > 0, length, np.repeat(from_ + size, size + 1))
        edge = np.diff(np.concatenate(([0], marked.view(np.int8), [0])))
        opens, closes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.searchsorted(from_, opens, side="right") - 1
        told = column("rep").to_numpy()[owner] == 0
        opens, closes, owner = opens[told], closes[told], owner[told]
        columns = [pa.array(column("id").to_numpy()[owner]), pa.array((opens - from_[owner]).astype(np.int32)), pa.array((closes - opens).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["id", "at", "windows"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            lengths = pa.compute.binary_length(batch.column(4)).to_numpy()
            changes = np.flatnonzero(np.concatenate(([len(bucket) > 0 and bucket[0] != last], bucket[1:] != bucket[:-1])))
            from_ = 0
            for at in changes:
                before = int(lengths[from_:at].sum())
                if size + before > CHUNK_BYTES:
                    if at > from_:
                        parts.append(batch.slice(from_, at - from_))
                    yield spans(parts)
                    parts, size, from_ = [], 0, at
            if from_ < batch.num_rows:
                parts.append(batch.slice(from_))
                size += int(lengths[from_:].sum())
                last = bucket[-1]
        if parts:
            yield spans(parts)

    return run


def _marks(pieces: DataFrame, length: int, crowd: int, ranges: tuple[int, ...]) -> DataFrame:
    """(id, at, windows): runs of repeated windows in each content; crowded buckets are split and decided by their parts."""
    crowded = pieces.where("rep = 0").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("bucket")
    crowded = cut(crowded)
    if not ranges or crowded.isEmpty():
        return cut(pieces.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sort_contents(length), _SPAN))
    some = pieces.join(crowded, "bucket", "left_anti").select(*pieces.columns)
    found = cut(some.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sort_contents(length), _SPAN))
    # A content's second copy is found by its parts' names.
    fine = cut(pieces.join(crowded, "bucket", "left_semi").select(*pieces.columns).mapInArrow(_split(length, ranges[0]), _FINE))
    name = ["bucket", "one", "two", "windows"]
    nth = F.row_number().over(Window.partitionBy(*name).orderBy("owner", "at"))
    two = fine.withColumn("nth", nth).where("nth <= 2")
    names = cut(fine.select(*name).distinct().withColumn("id", F.monotonically_increasing_id()))
    parts = cut(two.join(names, name).select("bucket", "id", (F.col("nth") - 1).cast("int").alias("rep"), "windows", "bytes"))
    below = _marks(parts, length, crowd, ranges[1:])
    whose = fine.select(*name, "owner", F.col("at").alias("from")).join(names, name).select("id", "owner", "from")
    spread = below.join(whose, "id").select(F.col("owner").alias("id"), (F.col("from") + F.col("at")).cast("int").alias("at"), "windows").distinct()
    out = cut(found.unionByName(spread))
    drop(found, fine, names, parts, below)
    return out


def repeated_spans(source: DataFrame, length: int, crowd: int = CROWD) -> DataFrame:
    """(key, key2, start, windows): runs of repeated windows in the texts of ``source`` (key, key2, id, text)."""
    found = cut(source.select("key", "key2", "text").mapInArrow(_emit_segments(length), _SEGMENT))
    content = ["anchor", "content", "windows"]
    place = ["key", "key2", "start"]
    # Dealt by anchor alone: contents and anchors are both summed on the one exchange.
    ends = [f(c).alias(f"{n}_{c}") for n, f in (("first", F.first), ("last", F.last)) for c in place]
    contents = found.where("n > 0").repartition("anchor").groupBy(*content).agg(F.sum("n").alias("n"), F.max("again").alias("again"), *ends)
    total = F.sum("n").over(Window.partitionBy("anchor"))
    # The number of a content is fixed by the table that is written here.
    # Of an anchor at one place in all, windows differ; one that recurs inside its only segment may have equal ones there.
    contents = cut(contents.withColumn("total", total).where("total > 1 or again").drop("total", "again").withColumn("id", F.monotonically_increasing_id()))
    asked = [contents.where(f"n > {k}").select(F.col("anchor").alias("bucket"), "id", F.lit(k).alias("rep"), "windows", *[F.col(f"{n}_{c}").alias(c) for c in place]) for k, n in enumerate(("first", "last"))]
    lists = asked[0].unionByName(asked[1]).groupBy("key", "key2").agg(F.collect_list(F.struct("bucket", "id", "rep", "start", "windows")).alias("asked"))
    # Rows that repeat in id and text have one key, and one of them is cut.
    held = source.join(lists, ["key", "key2"]).select("text", "asked", F.row_number().over(Window.partitionBy("key", "key2").orderBy(F.lit(1))).alias("nth")).where("nth = 1")
    pieces = cut(held.select("text", "asked").mapInArrow(_cut_out(length), _PIECE))
    marks = _marks(pieces, length, crowd, RANGES)
    drop(pieces)
    told = contents.join(marks.withColumnRenamed("windows", "run"), "id")
    once = told.where("n = 1").select("first_key", "first_key2", (F.col("first_start") + F.col("at")).alias("start"), "run").toDF("key", "key2", "start", "windows")
    many = cut(told.where("n > 1").select(*content, "n", "at", "run"))
    # Contents that occur often are at most 10,000, so they may be broadcast; no other key of the join has more rows than they.
    bound = F.greatest(F.lit(OFTEN), F.lit(found.count() // 10_000))
    often, seldom = many.where(F.col("n") > bound), many.where(F.col("n") <= bound)
    rows = found.select(*content, *place)
    twice = rows.join(F.broadcast(often), content).unionByName(rows.join(F.broadcast(often.select(*content).distinct()), content, "left_anti").join(seldom, content))
    twice = twice.select("key", "key2", (F.col("start") + F.col("at")).alias("start"), F.col("run").alias("windows"))
    out = cut(once.unionByName(twice).distinct())
    drop(found, contents, many, marks)
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep_text: bool = False, crowd: int = CROWD) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` (and ``kept``, bytes).

    ``n_spans`` counts maximal removed runs; the digest is over the bytes that stay, in order.
    """
    source = docs.select(F.xxhash64(id_col, text_col).alias("key"), F.hash(id_col, text_col).alias("key2"), F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    with settings(docs.sparkSession, small_batches(docs.sparkSession)):
        spans = repeated_spans(source, length, crowd)
    spans = spans.groupBy("key", "key2").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    fields = [T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    if keep_text:
        fields.append(T.StructField("kept", T.BinaryType()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch.column(1)):
                row, x = _listed(batch.column(2).slice(first, end - first))
                gone = _covered(len(data), offsets[row] + x.get("start", row), x.get("windows", row) + length - 1)
                before = np.concatenate(([False], gone[:-1]))
                before[offsets[:-1][offsets[:-1] < len(data)]] = False
                removed, runs = (np.diff(np.concatenate(([0], np.cumsum(f)))[offsets]) for f in (gone, gone & ~before))
                kept = [data[a:b][~gone[a:b]].tobytes() if n else data[a:b].tobytes() for a, b, n in zip(offsets[:-1], offsets[1:], removed, strict=True)]
                columns = [batch.column(0).slice(first, end - first), *(pa.array(c, pa.int64()) for c in (np.diff(offsets), removed, runs)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary())] if keep_text else []), names=[f.name for f in fields])

    listed = F.coalesce("spans", F.array().cast("array<struct<start:int,windows:int>>")).alias("spans")
    return source.join(spans, ["key", "key2"], "left").select("id", "text", listed).mapInArrow(run, T.StructType(fields))


def _covered(size: int, start: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Which of ``size`` bytes lie in one of the ranges."""
    depth = np.bincount(start, minlength=size + 1).astype(np.int64) - np.bincount(start + span, minlength=size + 1)
    return np.cumsum(depth[:size]) > 0
