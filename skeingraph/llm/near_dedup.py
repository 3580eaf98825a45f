"""Near-duplicate detection with HyperMinHash sketches, confirmed on full shingle sets.

1. Each text becomes the set of its hashed word shingles and a HyperMinHash: registers of
   16 bits that keep of a smallest hash the number of leading zeros and ten bits of mantissa.
   Sets of over 1536 shingles are dealt to 256 buckets with a register each.  Smaller sets
   would leave buckets empty, so each of their 252 registers has a hash function of its own
   and looks at the whole set; sets between the two sizes that a linked pair can have get
   both kinds.  Texts with equal sets are one class from here on, so copies are never paired.
2. Registers are banded, 42 bands of 6.  A pair of resemblance 0.85 shares no band with a
   chance of 2e-9, one of 0.8 with 3e-6.
3. Pairs that share a band are compared on their registers; the estimate is corrected
   for registers that agree by collision, and pairs six standard errors or more below
   the threshold go (at most 2e-6 of those at 0.85 and 2.5e-7 of those at 0.8, by the
   binomial tail; 2.4e-8 and 1.2e-8 with all registers filled).
4. The rest are confirmed on the full sets, and links are closed to components.

Large bands are not paired out.  First every member is tried against one hub of its band
only (a number of pairs linear in the members), and links found so far are closed; that
repeats with other hubs while bands hold far more pairs than members.  Then pairs are made
only inside bands that still hold several components, and only between components; bands of
many members are cut in tiles that tasks share, and a tile's pairs are confirmed where they
are made, on the sets of the members concerned.  A pair of one component needs no link of
its own, and no band or group is capped.

A class has a number of its own, given when the table of classes is written, so no two
classes can meet under one name; sets are told apart by their size and 128 bits of hash.

Words are runs of bytes other than ASCII white space; only A-Z is folded.  A text with
fewer words than a shingle has its whole sequence as its one shingle; a null text or one
without words has an empty set and links with nothing.  Rows that share an id are rows of
their own; a null id takes part but never names a component, which is null if no member
has an id.  Empty tables give no rows; other columns of the input are not looked at, so
their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut, drop, replace, settings
from ._arrays import LOWER, RollingHash, mix, small_batches, text_blocks, words
from ..operators.components import components

#: Buckets of a large set, registers of a band, bits of mantissa in a register.
REGISTERS, BAND, MANTISSA = 256, 6, 10
BANDS = REGISTERS // BAND
#: Registers of a small set.
DRAWS = BANDS * BAND
#: Sets of more shingles have registers by buckets.
DENSE = 1536
#: Pairs are confirmed unless their estimate is so many standard errors short of the threshold.
GATE = 6
#: Members of a tile; turns of hubs at most; pairs for each member from which another turn pays.
TILE, TURNS, CROWDED = 512, 2, 8
#: Rows of tile pairs that a task is given, about.
TASK_ROWS = 4096
#: Bytes of sets that the confirmation of pairs keeps for later pairs.
HELD_BYTES = 16 << 20
#: So many classes (48 bytes each) may be broadcast.
BROADCAST_IDS = 200_000
_ANY_WORD = r"[^\x20\x09-\x0D]"
_ORDER = np.arange(DRAWS).reshape(BAND, BANDS).T
_FACTORS = mix(np.arange(DRAWS, dtype=np.uint64) + np.uint64(424243)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text of a block."""
    data = LOWER[data]
    start, end, at = words(data, offsets)
    own = mix(RollingHash(data, seed=3).ranges(start, end))
    rolled = np.zeros(max(0, len(own) - size + 1), dtype=np.uint64)
    for j in range(size):
        rolled = mix(rolled * np.uint64(5) + own[j : j + len(rolled)] + np.uint64(j + 1))
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for h in own[a:b]:
                short = _fold(short, h)
            out.append(np.array([short], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _fold(state: np.uint64, value: np.uint64) -> np.uint64:
    return mix(np.array([state], dtype=np.uint64) * np.uint64(7) + value)[0]


def _register(value: np.ndarray) -> np.ndarray:
    """Leading zeros + 1 and the mantissa bits that follow the first one, in 16 bits."""
    top = np.maximum(value >> np.uint64(11), np.uint64(1)).astype(np.float64)
    zeros = np.minimum(52 - np.floor(np.log2(top)).astype(np.int64), 40)
    mantissa = (value << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    return ((zeros + 1) << MANTISSA | mantissa.astype(np.int64)).astype(np.uint16)


def registers(hashes: np.ndarray) -> np.ndarray:
    """Registers by buckets of a sorted set; 0 for an empty bucket.

    A hash's top 8 bits choose the bucket and the others are the value, so the first
    hash of a bucket in sorted order is its smallest.
    """
    bucket = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.searchsorted(bucket, np.arange(REGISTERS))
    out = np.zeros(REGISTERS, dtype=np.uint16)
    there = first < len(bucket)
    there[there] = bucket[first[there]] == np.flatnonzero(there)
    out[there] = _register((hashes[first[there]] << np.uint64(8)) | np.uint64(255))
    return out


def drawn_registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (a row per set, none of them empty) that each have a hash function of their own."""
    at = np.cumsum([0, *map(len, sets[:-1])])
    hashes = np.concatenate(sets)
    return np.stack([_register(np.minimum.reduceat(hashes * f, at)) for f in _FACTORS], axis=1)


def few_shingles(percent: int) -> int:
    """Sets of so many shingles have drawn registers; a set that links with a larger one has over ``DENSE``."""
    return DENSE * 100 // max(percent, 1)


def _borrowed(own: np.ndarray) -> np.ndarray:
    """Registers by buckets with each empty one lent by the next that is filled, and how far that is."""
    at = np.arange(2 * REGISTERS)
    filled = np.where(np.concatenate((own, own), axis=1) != 0, at, 4 * REGISTERS)
    lender = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1][:, :REGISTERS]
    away = lender - at[:REGISTERS]
    return np.take_along_axis(own, lender % REGISTERS, axis=1).astype(np.uint64) | away.astype(np.uint64) << np.uint64(16)


def _keys(values: np.ndarray, kind: int) -> np.ndarray:
    """A 64-bit key per band of each row of registers."""
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1 + kind * BANDS), (len(values), BANDS))
    for columns in _ORDER.T:
        key = mix(key * np.uint64(11) + values[:, columns].astype(np.uint64))
    return key


def band_keys(drawn: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Keys of both kinds of bands, 0 where a sketch lacks the kind."""
    small, big = drawn.any(axis=1), own.any(axis=1)
    out = np.zeros((len(drawn), 2 * BANDS), dtype=np.uint64)
    if small.any():
        out[small, :BANDS] = _keys(drawn[small], 1)
    if big.any():
        out[big, BANDS:] = _keys(_borrowed(own[big]), 0)
    return out


def _packed(sets: list[np.ndarray], few: int) -> list[bytes | None]:
    """The sketch of each set: drawn registers, those by buckets, or both; none for an empty set."""
    small = [i for i, s in enumerate(sets) if 0 < len(s) <= few]
    drawn = dict(zip(small, drawn_registers([sets[i] for i in small]), strict=True)) if small else {}
    parts = [(drawn[i].tobytes() if i in drawn else b"") + (registers(s).tobytes() if len(s) > DENSE else b"") for i, s in enumerate(sets)]
    return [p or None for p in parts]


def _sketches(column: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Drawn registers and those by buckets of each sketch, zeros for a kind that it lacks."""
    no_drawn, no_own = bytes(2 * DRAWS), bytes(2 * REGISTERS)
    whole = b"".join(x if len(x) > 2 * REGISTERS else x + no_own if len(x) == 2 * DRAWS else no_drawn + x for x in column)
    both = np.frombuffer(whole, dtype=np.uint16).reshape(-1, DRAWS + REGISTERS)
    return both[:, :DRAWS], both[:, DRAWS:]


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Resemblance from registers (rows of ``a`` against rows of ``b``), corrected for collisions.

    Two different minima of buckets with x and y expected hashes agree in all kept bits
    with a chance of about 0.72 * 2 ** -MANTISSA * x * y / (x + y) ** 2.
    """
    either = (a | b) != 0
    shared = ((a == b) & either).sum(axis=-1)
    filled = np.maximum(either.sum(axis=-1), 1)
    na, nb = na.astype(np.float64), nb.astype(np.float64)
    chance = 0.72 * 2.0**-MANTISSA * na * nb / np.maximum(na + nb, 1) ** 2
    return np.maximum(0.0, (shared / filled - chance) / (1 - chance))


def _least(filled: np.ndarray, threshold: float) -> np.ndarray:
    """Estimates below this are ``GATE`` standard errors short of the threshold."""
    return threshold - GATE * np.sqrt(threshold * (1 - threshold) / np.maximum(filled, 1))


def _near(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows of sketches may be alike enough, by sizes and by registers of a kind that both have."""
    good = np.zeros(len(a[0]), dtype=bool)
    for x, y in zip(a, b, strict=True):
        there = x.any(axis=-1) & y.any(axis=-1)
        good |= there & (estimate(x, y, na, nb) >= _least(((x | y) != 0).sum(axis=-1), threshold))
    return good & (np.minimum(na, nb) >= threshold * np.maximum(na, nb))


def _sketch_batches(size: int, few: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch.column(3)):
                sets = shingle_sets(data, offsets, size)
                part = batch.slice(first, end - first)
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_hash(s) for s in sets], pa.binary())]
                columns.append(pa.array(_packed(sets, few), pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], names=["key", "h1", "h2", "n_shingles", "set_hash", "sketch"])

    return run


def _set_hash(own: np.ndarray) -> bytes:
    """128 bits of a set, from sums of two mixings of its members."""
    one = np.add.reduce(mix(own ^ np.uint64(0x1234567)), dtype=np.uint64) if len(own) else np.uint64(0)
    two = np.add.reduce(mix(own * np.uint64(9) + np.uint64(77)), dtype=np.uint64) if len(own) else np.uint64(0)
    return int(one).to_bytes(8, "little") + int(two).to_bytes(8, "little")


def _band_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            keys = band_keys(*_sketches(part.column(1).to_pylist()))
            there = keys != 0
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), there.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys[there].view(np.int64), pa.int64())], names=["id", "band"])


def _estimate_pairs(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                a, b = (_sketches(part.column(i).to_pylist()) for i in (4, 5))
                na, nb = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(_near(a, b, na, nb, threshold)))

    return run


def _across(sketches: tuple[np.ndarray, np.ndarray], ids: np.ndarray, component: np.ndarray, n: np.ndarray, side: np.ndarray, key: tuple, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of a tile pair, the others it may link with.

    They are of another component, near by estimate, and share no earlier band with it.
    """
    bands = band_keys(*sketches)
    here = int(np.flatnonzero(bands[0].view(np.int64) == key[0])[0])
    for i in np.flatnonzero(side == key[1]):
        j = np.arange(i + 1, len(ids)) if key[1] == key[2] else np.flatnonzero(side == key[2])
        j = j[(component[j] != component[i]) & (np.minimum(n[j], n[i]) >= threshold * np.maximum(n[j], n[i]))]
        if here and len(j):
            j = j[~((bands[j, :here] == bands[i, :here]) & (bands[i, :here] != 0)).any(axis=1)]
        if len(j):
            one = tuple(x[i : i + 1] for x in sketches)
            good = _near(tuple(x[j] for x in sketches), one, n[j], n[i : i + 1], threshold)
            if good.any():
                yield i, j[good]


def _candidates(threshold: float):
    """The members of a tile pair that have anyone to be confirmed with."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id").reset_index(drop=True)
        ids, component, n, side = (group[c].to_numpy() for c in ("id", "component", "n_shingles", "tile"))
        wanted = np.zeros(len(ids), dtype=bool)
        for i, j in _across(_sketches(group["sketch"]), ids, component, n, side, key, threshold):
            wanted[i] = True
            wanted[j] = True
        return group.loc[wanted, ["band", "low", "high", "id", "component", "n_shingles", "tile"]]

    return run


def _links_within(threshold: float, percent: int):
    """Links between the components of a tile pair, confirmed on full sets; joined ones need no second link."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id").reset_index(drop=True)
        ids, component, n, side = (group[c].to_numpy() for c in ("id", "component", "n_shingles", "tile"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group["members"]]
        _, component = np.unique(component, return_inverse=True)
        root = np.arange(component.max() + 1)
        a, b = [], []
        for i, near in _across(_sketches(_packed(sets, few_shingles(percent))), ids, component, n, side, key, threshold):
            for j in near:
                if root[component[i]] == root[component[j]]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (n[i] + n[j] - both):
                    root[root == root[component[j]]] = root[component[i]]
                    a.append(ids[i])
                    b.append(ids[j])
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    return run


def _set_batches(size: int):
    """The full set of each text, as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(data, offsets, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(sets, pa.binary())], names=["id", "members"])

    return run


def _confirm(size: int, numerator: int, denominator: int):
    """Pairs (a, b) whose full sets are alike enough; rows have the two texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, np.ndarray] = {}
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids = [part.column(0).to_pylist(), part.column(1).to_pylist()]
                new: dict[int, str] = {}
                for side in (0, 1):
                    text = part.column(2 + side)
                    for row, i in enumerate(ids[side]):
                        if i not in held and i not in new:
                            new[i] = text[row].as_py()
                if new:
                    texts = pa.array(list(new.values()), pa.string())
                    sets = [s for _, _, data, offsets in text_blocks(texts) for s in shingle_sets(data, offsets, size)]
                    held.update(zip(new, sets, strict=True))
                good = []
                for i, j in zip(*ids, strict=True):
                    x, y = held[i], held[j]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(both * denominator >= numerator * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(good))
                if sum(x.nbytes for x in held.values()) > HELD_BYTES:
                    held = {}

    return run


def _links(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed pairs; the texts of candidates alone are moved."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    held = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return held.mapInArrow(_confirm(size, percent, 100), "a long, b long")


#: Rows are told apart by id and two hashes of the text.
_MARK = ["key", "h1", "h2"]
#: The first row is found by this; a null id comes after all others.
_ORDERED = "struct(key is null as nil, key, h1, h2)"


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("key"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"), text.alias("text"))


def _same_row(a: str, b: str):
    """Null ids count as equal."""
    return F.expr(f"{a}.key <=> {b}.key and {a}.h1 = {b}.h1 and {a}.h2 = {b}.h2")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Each row's (key, h1, h2, n_shingles, set_hash), and (n_shingles, set_hash, component, row) of each class.

    ``row`` is the first row of the class by id and hashes.
    """
    threshold = percent / 100
    source = _marked(docs, id_col, text_col)
    sketched = cut(source.mapInArrow(_sketch_batches(shingle, few_shingles(percent)), "key long, h1 long, h2 long, n_shingles long, set_hash binary, sketch binary"))
    first = F.min(F.struct(F.expr(_ORDERED).alias("mark"), "sketch")).alias("row")
    classes = sketched.where("n_shingles > 0").groupBy("n_shingles", "set_hash").agg(first)
    # The number is fixed by the table that is written here.
    classes = cut(classes.select(F.monotonically_increasing_id().alias("id"), "n_shingles", "set_hash", F.col("row.mark").alias("row"), "row.sketch"))

    banded = classes.select("id", "sketch").mapInArrow(_band_batches, "id long, band long")
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    banded = cut(banded.join(shared, "band"))
    # From here on only classes that share a band with another are moved.
    members = cut(classes.select("id", "n_shingles", "sketch").join(banded.select("id").distinct(), "id", "left_semi"))
    label = None
    for turn in range(TURNS):
        known = _labelled(banded, label)
        if turn and not _crowded(known):
            break
        near = cut(_close(_to_hubs(known, turn), members, threshold))
        texts = cut(_wanted(source, classes, _ends(near)))
        links = cut(_links(near, texts, shingle, percent))
        drop(near, texts)
        before, label = label, components(_with_known(links, label))
        drop(links, before)

    known = _labelled(banded.where("members > 2"), label)
    mixed = known.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    open_ = cut(known.join(mixed, "band").join(members, "id"))
    tiles = _tiled(open_)
    size = tiles.select("id").count()
    # Dealt by rows: a tile pair costs far more time than its bytes tell.
    asked = tiles.repartition(1 + size // TASK_ROWS, "band", "low", "high").groupBy("band", "low", "high").applyInPandas(_candidates(threshold), "band long, low int, high int, id long, component long, n_shingles long, tile int")
    asked = cut(asked)
    drop(open_, members, banded)
    sets = _wanted(source, classes, asked.select("id").distinct()).select("id", "text").mapInArrow(_set_batches(shingle), "id long, members binary")
    more = cut(asked.join(sets, "id").groupBy("band", "low", "high").applyInPandas(_links_within(threshold, percent), "a long, b long"))
    closed = components(_with_known(more, label)).withColumnRenamed("node", "id")
    reached = cut(classes.select("id", "n_shingles", "set_hash", "row").join(closed, "id", "left").select("n_shingles", "set_hash", "row", F.coalesce("component", "id").alias("component")))
    drop(asked, more, label, closed, classes)
    return sketched.drop("sketch"), reached


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Rows link if 100 * |A and B| >= ``percent`` * |A or B|; ``component_id`` is the
    smallest id that a row reaches, itself included, and ``kept`` marks that one.
    """
    with settings(docs.sparkSession, small_batches(docs.sparkSession)):
        rows, reached = _grouped(docs, id_col, text_col, shingle, percent)
    least = reached.groupBy("component").agg(F.min("row.key").alias("component_id"))
    reached = reached.join(least, "component").select("n_shingles", "set_hash", "component_id")
    out = rows.select("key", "n_shingles", "set_hash").join(reached, ["n_shingles", "set_hash"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))


def _labelled(banded: DataFrame, label: DataFrame | None) -> DataFrame:
    """Members of bands with their component so far; without links each is its own."""
    if label is None:
        return banded.withColumn("component", F.col("id"))
    known = banded.join(label.withColumnRenamed("node", "id"), "id", "left")
    return known.withColumn("component", F.coalesce("component", "id"))


def _with_known(links: DataFrame, label: DataFrame | None) -> DataFrame:
    """New links beside those of closed components, of which one to the smallest member stands for all."""
    return links if label is None else links.unionByName(label.toDF("a", "b"))


def _to_hubs(known: DataFrame, turn: int) -> DataFrame:
    """Pairs of each member of a band with the band's hub, if that is of another component.

    The hub is the smallest member by a hash that bands share and turns do not, so bands
    with much the same members have the same hub and a member has few of them.
    """
    drawn = F.xxhash64("id", F.lit(turn))
    hub = known.groupBy("band").agg(F.min_by(F.struct("id", "component"), drawn).alias("hub"))
    pairs = known.join(hub, "band").where("component <> hub.component")
    return pairs.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def _crowded(known: DataFrame) -> bool:
    """Whether pairs between components of one band are far more than members."""
    parts = known.groupBy("band", "component").agg(F.count(F.lit(1)).cast("double").alias("n"))
    bands = parts.groupBy("band").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"))
    total = bands.agg(F.sum(F.col("n") * F.col("n") - F.col("within")).alias("across"), F.sum("n").alias("members")).first()
    return bool(total["members"]) and total["across"] > CROWDED * total["members"]


def _close(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose estimate is near enough to the threshold."""
    a = members.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    b = members.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    held = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb")
    return held.mapInArrow(_estimate_pairs(threshold), "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def _wanted(source: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the first row of each class with one of these ids.

    The rows are broadcast while they are at most ``BROADCAST_IDS``, which saves a shuffle
    of all texts; beyond that both sides are shuffled.
    """
    rows = cut(classes.select("id", "row.key", "row.h1", "row.h2").join(ids, "id", "left_semi"))
    if rows.count() <= BROADCAST_IDS:
        rows = F.broadcast(rows)
    # A row that is repeated matches as often as it occurs.
    return source.alias("s").join(rows.alias("r"), _same_row("s", "r")).select("r.id", "s.text").dropDuplicates(["id"])


def _tiled(rows: DataFrame) -> DataFrame:
    """Members of each band dealt to pairs of tiles: every two members meet in one of them."""
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("id"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    return rows.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, in the columns of ``docs``: its first by id (null last) and hashes of the text.

    A row that repeats in id and text stays once.  Rows without words are groups of their
    own and all stay.
    """
    with settings(docs.sparkSession, small_batches(docs.sparkSession)):
        _, reached = _grouped(docs, id_col, text_col, shingle, percent)
    first = reached.groupBy("component").agg(F.min("row").alias("row")).select("row.key", "row.h1", "row.h2")
    own = [F.col(id_col).cast("long").alias("key"), F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit("second"), F.col(text_col)).alias("h2")]
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), *own)
    held = whole.alias("s").join(first.alias("m"), _same_row("s", "m"), "left_semi")
    nth = F.row_number().over(Window.partitionBy(*_MARK).orderBy(F.lit(1)))
    kept = held.withColumn("nth", nth).where("nth = 1").select("__row.*")
    return kept.unionByName(docs.where(F.coalesce(~F.col(text_col).rlike(_ANY_WORD), F.lit(True))))
