"""Document fingerprints: bottom-k sketches of word shingle hashes, in DataFrame operations alone.

A fingerprint is the ascending list of the ``k`` smallest distinct 64-bit hashes (taken
as signed numbers) of a text's shingles of five words.  Sketches merge by uniting and
cutting again, so parts of a text or corpus may be sketched apart.  From sketches alone
follow the number of distinct shingles, the resemblance of two sets and how much of one
the other contains.

A text of fewer words than a shingle has its whole sequence as one shingle; without
words, or null, its fingerprint is empty.  Two empty fingerprints are alike (1.0), an
empty and another are not (0.0).  Equal texts have equal fingerprints.

The next document is the row with the next smaller id; rows that tie in id follow each other
by a hash of the text, then by the text, and null ids come last.  Rows that repeat in both
are interchangeable.  An empty table gives no rows.  Other columns of the input are not
looked at, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut, drop, replace

#: Hashes in a sketch, words in a shingle.
K, SHINGLE = 128, 5
_SPACE = r"[\x20\x09-\x0D]+"
#: Documents in a cell of neighbouring ids, about; cells of up to twice as many are not split.
CELL_ROWS = 2000


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    """Bottom-k sketch of the whole text: ``array<bigint>``, ascending."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), lambda w: w != "")
    return _let(F.transform(found, lambda w: F.xxhash64(w)), lambda hashes: sketch_of_words(hashes, k, size))


def sketch_of_words(hashes: Column, k: int = K, size: int = SHINGLE) -> Column:
    """Bottom-k sketch from the hashes of a text's words in order."""
    rolled = F.transform(
        F.sequence(F.lit(1), F.size(hashes) - (size - 1)),
        lambda i: F.xxhash64(*[F.get(hashes, i + (j - 1)) for j in range(size)]),
    )
    shingles = F.when(F.size(hashes) >= size, rolled).when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def _count(of: Column, k: int) -> Column:
    """Distinct shingles: exact below k, else from how densely the k smallest lie."""
    top = (F.element_at(of, -1).cast("double") + 9223372036854775808.0) / 18446744073709551616.0
    return F.when(F.size(of) < k, F.size(of).cast("double")).otherwise((k - 1) / top)


distinct_shingles = _count


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A or B|: the share of the union's sketch that both have."""

    def share(both: Column) -> Column:
        shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
        return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.size(both))

    return _let(merge(a, b, k), share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of A's shingles that B has; 1.0 for an empty A."""
    common = resemblance(a, b, k) * _count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / _count(a, k)))


def corpus_sketch(docs: DataFrame, *, text_col: str = "text", k: int = K) -> DataFrame:
    """One row: the sketch of all distinct shingles of a corpus.

    Each task cuts its hashes to the smallest, so about k per task are shuffled.
    """
    hashes = docs.select(F.explode(sketch(F.col(text_col), k)).alias("hash")).distinct()
    return hashes.orderBy("hash").limit(k).agg(F.sort_array(F.collect_list("hash")).alias("sketch"))


def as_text(of: Column) -> Column:
    """Sixteen hexadecimal digits for each hash, in order."""
    return F.array_join(F.transform(of, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def _spread(value: str, low: str, high: str, parts: Column) -> Column:
    """Which of ``parts`` equal ranges from ``low`` to ``high`` has ``value``; exact differences, whatever the 64-bit numbers."""
    wide = "cast({} as decimal(20,0))".format
    share = F.expr(f"cast({wide(value)} - {wide(low)} as double)") / (F.expr(f"cast({wide(high)} - {wide(low)} as double)") + 1)
    return F.least(parts - 1, F.floor(share * parts)).cast("int")


def _descend(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` (id, h, path, ...) with the path of those in a node that is split longer by one."""
    held = rows.alias("r").join(nodes.alias("n"), F.expr("r.path = n.node"), "left")
    by_id = F.col("parts") - 1 - _spread("id", "low", "high", F.col("parts"))
    step = F.when(F.col("low") < F.col("high"), by_id).otherwise(_spread("h", "low_h", "high_h", F.col("parts")))
    return held.withColumn("path", F.when(F.col("node").isNull(), F.col("path")).otherwise(F.concat("path", F.array(step)))).drop("node", "parts", "low", "high", "low_h", "high_h")


def _levels(slim: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``slim`` (id, h) with the path of its cell, and the nodes that were split, level by level.

    Paths in ascending order hold descending ids.  A node is cut in equal ranges of ids, or
    of hashes if it has one id, until it has few rows or one value; each level looks only at
    the range that its node has, so outlying ids don't gather the others.
    """
    now, levels = cut(slim.withColumn("path", F.array(F.when(F.col("id").isNull(), 1).otherwise(0)))), []
    while True:
        sizes = now.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.min("h").alias("low_h"), F.max("h").alias("high_h"))
        wide = sizes.where((F.col("n") > 2 * CELL_ROWS) & (F.coalesce(F.col("low") < F.col("high"), F.lit(False)) | (F.col("low_h") < F.col("high_h"))))
        # A row for each some thousand documents: a small file, which Spark broadcasts by its size.
        nodes = cut(wide.select(F.col("path").alias("node"), F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("parts"), "low", "high", "low_h", "high_h"))
        if nodes.isEmpty():
            drop(nodes)
            return now, levels
        levels.append(nodes)
        now = replace(now, _descend(now, nodes))


def with_next(docs: DataFrame, *, id_col: str, text_col: str, derived: dict[str, Column] | None = None) -> DataFrame:
    """(id, text) with ``next_text``: that of the row with the next smaller id, after the last of the first.

    ``derived`` columns are computed from id and text after a row was dealt, once for each
    row, so that they are not shuffled; they get a ``next_`` form as well.  Rows are dealt to
    cells of neighbouring ids, so no window holds the table; the row that opens each cell is
    sent to the cell before it as well.
    """
    derived = derived or {}
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    slim, levels = _levels(keyed.select("id", "h"))
    first = F.max(F.struct("id", F.bitwise_not("h").alias("not_h"))).alias("first")
    heads = slim.groupBy("path").agg(first)
    ring = F.coalesce(F.lag("path").over(Window.orderBy("path")), F.max("path").over(Window.partitionBy(F.lit(1))))
    heads = cut(heads.select("path", F.col("first.id").alias("id"), F.bitwise_not("first.not_h").alias("h"), ring.alias("previous")))
    drop(slim)
    rows = keyed.withColumn("path", F.array(F.when(F.col("id").isNull(), 1).otherwise(0)))
    for nodes in levels:
        rows = _descend(rows, nodes)
    order = [F.col("id").desc_nulls_last(), "h", "text"]
    # One row for each cell; rows that tie at its head are cut to the first.
    guests = rows.alias("k").join(heads.alias("r"), F.expr("k.path = r.path and k.id <=> r.id and k.h = r.h")).select("k.id", "k.h", "k.text", F.col("previous").alias("path"))
    guests = guests.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy(*order))).where("nth = 1").drop("nth").withColumn("guest", F.lit(1))
    rows = rows.withColumn("guest", F.lit(0)).unionByName(guests).repartition("path").withColumns(derived)
    inside = Window.partitionBy("path").orderBy("guest", *order)
    followed = rows.withColumns({f"next_{c}": F.lead(c).over(inside) for c in ["text", *derived]})
    return followed.where("guest = 0").drop("guest", "path", "h")


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses.

    The edited text has its last third (floor of code points / 3) replaced by as many
    first code points of the next document's text, or all of them if it has fewer.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pairs = with_next(texts, id_col="id", text_col="text", derived={"own": sketch(F.col("text"), k)})
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    made = pairs.select("id", n.cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), "own", sketch(edited, k).alias("changed"), F.col("next_own").alias("following"))
    return made.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"), resemblance(F.col("own"), F.col("following"), k).alias("near_next"),
    )
