"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone.

Within a source every document has the same expected number of copies, target / size of
the source.  Documents are put in a fixed order, the expectation is summed along it, one
offset drawn from the source's name is added, and a document is emitted once for each
integer boundary that its own step crosses.  The order runs by size, so large documents
are spread evenly over the sample and the words taken stay near the target.

No window holds a whole source: documents are dealt to cells of a source by size class
and hash, cells have a bounded expected number of rows, and a document's position is the
rows of the cells before it plus its place in its own cell.  What is known of sources,
classes and cells comes from one narrow table of (source, size, draw) that is written once;
the tables made of it are small files, which Spark broadcasts by their size or, if they
are large, joins by shuffles.

Null and empty texts have size 0 and take no words.  Null sources form one source, last
in order.  Rows that tie in every ordering column are interchangeable.  Sources without
words have target 0.  An empty table gives no rows; extra columns are kept unless they
have a name that the operator sets, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

#: Characters that a word may not hold are ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a cell of a source is expected to hold at most.
CELL_ROWS = 4096


def word_count(text: Column) -> Column:
    """Words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _fraction(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, n, source_size, target) with one row per source.

    ``sizes`` has source and size of each document.  Sources in code point order, null
    last, weigh ``weights`` in turn and divide ``share`` times all words.  A target ends
    at ``most`` times its source's size; what is over goes to the others by weight: taken
    by ascending ceiling per weight, a source is full if its ceiling is no more than its
    part of what the fuller ones leave, and the first that is not full sets the level.
    """
    by_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    ceiling = by_source.withColumn("weight", cycle.cast("double")).withColumn("ceiling", F.col("source_size") * most)
    by_need = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    filled = ceiling.withColumn("level", level)
    last = F.max(F.when(F.col("ceiling") / F.col("weight") > F.col("level"), F.col("level"))).over(everything)
    filled = filled.withColumn("last", last)
    target = F.when(F.col("last").isNull(), F.col("ceiling")).otherwise(F.least(F.col("ceiling"), F.col("last") * F.col("weight")))
    return filled.select("source", "n", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``copies``, ``taken``, and ``keep``.

    ``copies`` never exceeds ``most`` rounded up; ``taken`` is copies times size.
    """
    keep = keep or []
    shown = {c: f"__{i}" for i, c in enumerate(dict.fromkeys([id_col, *keep]))}
    draw = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(*[F.col(c).alias(a) for c, a in shown.items()], F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), draw.alias("draw"))
    rows = rows.withColumn("size_class", F.floor(F.log2(F.col("size") + 1) * 8).cast("int"))
    facts = cut(rows if not keep else rows.select("source", "size", "size_class", "draw"))
    rows = facts if not keep else rows
    classes, cells = _plan(facts, source_targets(facts, weights, share, most))
    dealt = rows.alias("r").join(classes.alias("c"), F.expr("r.source <=> c.source and r.size_class = c.size_class")).select("r.*", "cells", "source_size", "target")
    dealt = dealt.withColumn("cell", _cell())
    inside = Window.partitionBy("source", "size_class", "cell").orderBy("size", "draw", *[F.col(a) for a in shown.values()][:1])
    placed = dealt.withColumn("place", F.row_number().over(inside))
    placed = placed.alias("r").join(cells.alias("s"), F.expr("r.source <=> s.source and r.size_class = s.size_class and r.cell = s.cell")).select("r.*", "start")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _fraction(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))))
    at = F.col("start") + F.col("place")
    copies = F.least(F.floor(at * rate + offset) - F.floor((at - 1) * rate + offset), F.ceil(F.lit(float(most)))).cast("long")
    done = placed.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    back = [F.col(a).alias(c) for c, a in shown.items() if c not in ("size", "source_size", "target", "copies", "taken")]
    return done.select(*back, "size", "source_size", "target", "copies", "taken")


def _cell() -> Column:
    return F.pmod(F.conv(F.substring("draw", 9, 8), 16, 10).cast("long"), F.col("cells"))


def _plan(facts: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each size class of a source its cells and target, and of each cell how many rows lie before it."""
    cells = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / CELL_ROWS)).cast("long")
    classes = cut(facts.groupBy("source", "size_class").agg(F.count(F.lit(1)).alias("rows"), cells.alias("cells")))
    earlier = Window.partitionBy("source").orderBy("size_class").rowsBetween(Window.unboundedPreceding, -1)
    known = classes.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    known = cut(known.alias("c").join(targets.alias("t"), F.expr("c.source <=> t.source")).select("c.source", "size_class", "cells", "before", "source_size", "target"))
    held = facts.alias("r").join(known.alias("c"), F.expr("r.source <=> c.source and r.size_class = c.size_class")).select("r.source", "r.size_class", "before", _cell().alias("cell"))
    held = held.groupBy("source", "size_class", "cell").agg(F.count(F.lit(1)).alias("rows"), F.min("before").alias("before"))
    earlier = Window.partitionBy("source", "size_class").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.withColumn("start", F.col("before") + F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    return known, cut(starts.select("source", "size_class", "cell", "start"))


def emit_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as it is taken, in the columns of ``docs``."""
    columns = docs.columns
    mixed = mix_sources(docs.select(F.struct(*[F.col(c) for c in columns]).alias("__row"), F.col(options.get("id_col", "doc_id")).alias("__id"), F.col(options.get("text_col", "text")).alias("__text"), F.col(options.get("source_col", "source")).alias("__source")), **(options | {"id_col": "__id", "text_col": "__text", "source_col": "__source", "keep": ["__row"]}))
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")
