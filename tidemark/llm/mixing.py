"""Mixing sources to target token counts by entropy balancing (operator 9).

Every document gets a rate, the number of copies it should have.  The rates are
those closest to one copy each (in relative entropy) whose words meet the
source's target, so a rate is ``exp(lambda x size)`` up to the largest number
of copies, with one multiplier per source.  Newton steps on the convex dual
find all multipliers at once; a step sums over a source's (source, size)
cells.  The rates are then rounded into whole copies: cells in falling size
share out the copies of their running rate total, which keeps the words of a
source within one large document of the target, and the best of a set of
rounding offsets brings them closer, as does flipping the rounding of one or two
cells.  All of it is DataFrame work.

Defined cases: a null source is a source of its own, the last; a null text has
size 0 and is never taken; a source without words has target 0; equal rows are
interchangeable; ids need not be unique; reruns give the same answer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, text_of
from tidemark.operators.skew import dense_index, global_running
from tidemark.session import materialise

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
#: Rows of one (source, size) cell that are ranked in one task, at most, and parts of a cell, at least.
RANKED_ROWS = 50_000
CELL_PARTS = 16
OFFSETS = 64
FLIPS = 2
#: Newton steps at most, and how many are taken before their state is stored and looked at.
NEWTON_STEPS, STEPS_STORED = 40, 10
TOLERANCE = 1e-7


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def _mark() -> Column:
    """What documents of one source and size are ordered by: a hash of the id, of the text where there is none."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64(text_of())).otherwise(F.xxhash64("doc_id")).alias("mark")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, mark) of every document, stored."""
    return materialise(docs.select("doc_id", "source", words(text_of()).alias("size"), _mark()))


def source_key(source: str = "source") -> Column:
    """Sorts by code point, null last, and is never null."""
    return F.when(F.col(source).isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), F.col(source)))


def source_targets(cells: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(key, source_size, target): shares of all words by weight, none above ``max_copies`` times its source.

    The weights repeat over the sources in order.  Sources reach their ceiling in the order of ceiling over weight; with
    the first k of them at their ceilings the rest share at a level, and the first level that the next source can take
    is the one.
    """
    totals = cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    placed = dense_index(totals, ["key"], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    sources = placed.select("key", "source_size", weight.alias("weight"))
    sources = sources.withColumn("ceiling", F.col("source_size") * float(max_copies))
    sources = sources.withColumn("full_at", F.col("ceiling") / F.col("weight"))
    measures = {"fixed": F.col("ceiling"), "taken": F.col("weight")}
    sources = materialise(global_running(sources, ["full_at", "key"], measures))
    every = sources.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    # With all before a source at their ceilings and this one and the rest sharing: one row for each k.
    level = (F.lit(float(every["words"] or 0)) - F.col("fixed_before")) / (F.lit(every["weight"] or 1.0) - F.col("taken_before"))
    levels = sources.select("full_at", "key", level.alias("level")).where("level <= full_at")
    found = levels.agg(F.min(F.struct("full_at", "key", "level"))["level"]).first()[0] or 0.0
    return sources.select("key", "source_size", F.least(F.col("weight") * found, "ceiling").alias("target"))


def _rate(multiplier: Column, x: Column, max_copies: int) -> Column:
    return F.least(F.exp(F.least(multiplier * x, F.lit(50.0))), F.lit(float(max_copies)))


def _newton_step(cells: DataFrame, max_copies: int) -> DataFrame:
    """One step of every source, written into each of its cells."""
    # In order of size, so that sums are the same on every run; all steps share one exchange and one sort.
    whole = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = F.col("size") / F.col("scale")
    rate = _rate(F.col("multiplier"), x, max_copies)
    tokens = F.col("n") * F.col("size")
    moving = F.when(rate < max_copies, tokens * rate * x).otherwise(0.0)
    at = cells.withColumns({"gap": F.sum(tokens * rate).over(whole) - F.col("target"), "slope": F.sum(moving).over(whole)})
    # At the ceiling itself only an unbounded multiplier is exact: half a word of slack ends the search.
    near = F.abs("gap") <= F.greatest(F.col("target") * TOLERANCE, F.lit(0.5))
    at = at.withColumns(
        {
            "near": near,
            "low": F.when(F.col("gap") < 0, F.col("multiplier")).otherwise(F.col("low")),
            "high": F.when(F.col("gap") > 0, F.col("multiplier")).otherwise(F.col("high")),
            "step": F.when(F.col("slope") > 0, F.col("multiplier") - F.col("gap") / F.col("slope")),
        }
    )
    middle = (
        F.when(F.col("low") == -math.inf, F.col("high") - F.greatest(F.lit(1.0), F.abs("high")))
        .when(F.col("high") == math.inf, F.col("low") + F.greatest(F.lit(1.0), F.abs("low")))
        .otherwise((F.col("low") + F.col("high")) / 2)
    )
    inside = (F.col("slope") > 0) & (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
    moved = F.when(F.col("near"), F.col("multiplier")).when(inside, F.col("step")).otherwise(middle)
    return at.withColumn("multiplier", moved).drop("gap", "slope", "step")


def multipliers(cells: DataFrame, targets: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(key, source_size, target, scale, multiplier) with the words of each source at its target.

    Sizes are measured in ``scale``, the size of the document in which a word
    of the source lies on average.  The dual's slope grows with the
    multiplier, so a Newton step that leaves the bracket is replaced by its
    middle.  A source's cells are its distinct sizes, of which there are at
    most the square root of twice its words.
    """
    by_size = cells.groupBy("key", "size").agg(F.sum("n").alias("n")).where(F.col("size") > 0)
    squares = F.sum(F.col("n") * F.col("size") * F.col("size").cast("double")).over(
        Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    state = by_size.join(targets, "key").select(
        "key", "size", "n", "source_size", "target",
        (squares / F.col("source_size")).alias("scale"),
        F.log(F.col("target") / F.col("source_size")).alias("multiplier"),
        F.lit(-math.inf).alias("low"),
        F.lit(math.inf).alias("high"),
        F.lit(False).alias("near"),
    )
    for _ in range(NEWTON_STEPS // STEPS_STORED):
        for _ in range(STEPS_STORED):
            state = _newton_step(state, max_copies)
        state = materialise(state)
        if state.where(~F.col("near")).isEmpty():
            break
    columns = ["source_size", "target", "scale", "multiplier"]  # the same in all cells of a source
    return state.groupBy("key").agg(*[F.first(c).alias(c) for c in columns])


def cell_copies(cells: DataFrame, solved: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(key, size, n, copies, source_size, target): whole copies of each (source, size) cell.

    Running totals go over bands of sizes, then within a band, so that a
    source with very many sizes is not one task.
    """
    by_size = cells.groupBy("key", "size").agg(F.sum("n").alias("n")).where(F.col("size") > 0)
    rated = by_size.join(solved, "key").select(
        "*",
        (F.col("n") * _rate(F.col("multiplier"), F.col("size") / F.col("scale"), max_copies)).alias("rate"),
        F.floor(F.log2("size")).alias("band"),
    )
    rated = materialise(rated)
    in_band = Window.partitionBy("key", "band").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    bands = Window.partitionBy("key").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rated.groupBy("key", "band")
        .agg(F.sum("rate").alias("band_rate"))
        .select("key", "band", F.coalesce(F.sum("band_rate").over(bands), F.lit(0.0)).alias("earlier"))
    )
    run = (
        rated.withColumn("inner", F.coalesce(F.sum("rate").over(in_band), F.lit(0.0)))
        .join(before, ["key", "band"])
        .withColumn("start", F.col("earlier") + F.col("inner"))
    )

    def copies(offset: Column) -> Column:
        # The same start gives the same floor on both sides of a cell border only up to rounding: keep within limits.
        share = F.floor(F.col("start") + F.col("rate") + offset) - F.floor(F.col("start") + offset)
        return F.least(F.greatest(share, F.floor("rate")), F.ceil("rate"), F.col("n") * max_copies)

    run = materialise(run)
    offsets = [F.lit((i + 0.5) / OFFSETS) for i in range(OFFSETS)]
    misses = run.groupBy("key").agg(
        *[F.sum(F.col("size") * copies(o)).alias(f"w{i}") for i, o in enumerate(offsets)],
        F.first("target").alias("target"),
    )
    # Struct order: the smallest miss, then the smallest offset.
    best = F.least(*[F.struct(F.abs(F.col(f"w{i}") - F.col("target")).alias("miss"), o.alias("offset")) for i, o in enumerate(offsets)])
    chosen = misses.select("key", best["offset"].alias("offset"))
    rounded = run.join(chosen, "key").select(
        "key", "size", "n", "rate", copies(F.col("offset")).alias("copies"), "source_size", "target"
    )
    for _ in range(FLIPS):
        rounded = _flip_one(materialise(rounded))
    return rounded.drop("rate")


def _flip_one(cells: DataFrame) -> DataFrame:
    """Rounds one cell of each source the other way, where that brings the source nearer to its target."""
    words_taken = cells.groupBy("key").agg(
        (F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("missing")
    )
    open_up = F.when(F.col("copies") + 1 <= F.ceil("rate"), 1)
    open_down = F.when(F.col("copies") - 1 >= F.floor("rate"), -1)
    move = F.when(F.col("missing") > 0, open_up).otherwise(open_down)
    moves = cells.join(words_taken, "key").withColumn("move", move).where(F.col("move").isNotNull())
    left = F.abs(F.col("missing") - F.col("move") * F.col("size"))
    best = (
        moves.where(left < F.abs("missing"))
        .groupBy("key")
        .agg(F.min(F.struct(left.alias("left"), "size", "move")).alias("best"))
        .select("key", F.col("best.size").alias("size"), F.col("best.move").alias("move"))
    )
    return cells.join(best, ["key", "size"], "left").select(
        "key", "size", "n", "rate", (F.col("copies") + F.coalesce("move", F.lit(0))).alias("copies"), "source_size", "target"
    )


def _parts(rows: DataFrame, parts: int) -> DataFrame:
    """Rows with their cell: source key, size and part.  Within a cell documents are ranked in parts, so no cell is one task's work."""
    return rows.withColumn("key", source_key()).withColumn("part", F.pmod("mark", F.lit(parts)))


def _shares(cells: DataFrame, max_copies: int) -> DataFrame:
    """Each part of a cell with its cell's copies and the rows of the cell's earlier parts."""
    targets = source_targets(cells, max_copies)
    solved = multipliers(cells, targets, max_copies)
    plan = cell_copies(cells, solved, max_copies).withColumnRenamed("n", "cell_rows")
    earlier = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = cells.withColumn("rank_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return counted.join(plan.drop("source_size", "target"), ["key", "size"], "left").join(
        targets.select("key", "source_size", "target"), "key"
    )


def _dealt(rows: DataFrame, sizes: DataFrame, max_copies: int, columns: list[str]) -> DataFrame:
    """``columns`` of the rows (doc_id, source, size, mark, ...), with ``copies``; ``sizes`` are the same rows, stored."""
    parts = max(math.ceil(sizes.count() / RANKED_ROWS), CELL_PARTS)
    cells = materialise(_parts(sizes, parts).groupBy("key", "size", "part").agg(F.count(F.lit(1)).alias("n")))
    order = Window.partitionBy("key", "size", "part").orderBy("mark", "doc_id")
    ranked = _parts(rows, parts).withColumn("rank", F.row_number().over(order))
    joined = ranked.join(_shares(cells, max_copies), ["key", "size", "part"])
    each = F.floor(F.col("copies") / F.col("cell_rows"))
    one_more = (F.col("rank_before") + F.col("rank") <= F.col("copies") % F.col("cell_rows")).cast("bigint")
    return joined.select(*columns, F.coalesce(each + one_more, F.lit(0)).cast("bigint").alias("copies"))


def mix(rows: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for stored rows of ``sized``."""
    return _dealt(rows, rows, max_copies, ["doc_id", "source", "size", "source_size", "target"])


def mixed_documents(docs: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """The mix itself: each document as often as it is taken, all columns."""
    # The row travels as one value, so that its columns may have any names.
    whole = docs.select("doc_id", "source", words(text_of()).alias("size"), _mark(), F.struct("*").alias("whole"))
    taken = _dealt(whole, sized(docs), max_copies, ["whole"]).where("copies > 0")
    return taken.select("whole", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("whole.*")
