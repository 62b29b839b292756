"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Rank keys are cut into this many cells per level; two levels leave a handful of rows for the exact cut.
CELLS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``source, source_size, target`` for one row per source in ``sizes(source, source_size)``.

    Sources in code-point order, null last, take the weights in turn. No target exceeds ``most`` times its source; the
    excess goes to the others by weight until none is above. That fixed point is a water level: every target is the
    smaller of its cap and ``level * weight``. With the sources in order of cap per weight, the level is what the sources
    below leave over the weights from here on, at the first source whose own cap it does not exceed; from there on that
    quotient only falls, so it is the largest such one. The windows run over one row per source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    by_ratio = Window.partitionBy(F.lit(1)).orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    upward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sizes.withColumn("_w", F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_below", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_all") - F.col("_below")) / F.sum("_w").over(upward))
        .withColumn(
            "_level", F.coalesce(F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything), F.lit(0.0))
        )
        .select("source", "source_size", F.least("_cap", F.col("_level") * F.col("_w")).alias("target"))
    )


def _uniform(seed: int) -> Column:
    """A number in (0, 1) that depends on the id, the row's number among its likes and the seed alone, so that reruns agree."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}:"), F.col("_no").cast("string")))
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def _ranked(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """The Pareto rank of each row for one copy more than the certain ones."""
    name = F.col("source")
    joined = rows.join(sources.withColumnRenamed("source", "_source"), name.eqNullSafe(F.col("_source")), "left")
    chance = F.least(F.lit(1.0), F.col("_slope") * F.sqrt(F.col("size").cast("double")))
    odds = F.col("_u") / (F.lit(1.0) - F.col("_u"))
    return (
        joined.withColumn("_u", _uniform(seed))
        .withColumn("_chance", chance)
        # q / (1 + q) of q = random odds / inclusion odds: the same order, within (0, 1).
        .withColumn("_rank", odds * (F.lit(1.0) - F.col("_chance")) / (odds * (F.lit(1.0) - F.col("_chance")) + F.col("_chance")))
        .withColumn("_c1", F.floor(F.col("_rank") * CELLS))
        .withColumn("_c2", F.floor((F.col("_rank") * CELLS - F.col("_c1")) * CELLS))
        .drop("_u", "_chance", "_source")
    )


def _drawn() -> Column:
    """Whether a ranked row, with its source's bounds, lies before the cut."""
    before = (F.col("_c1") < F.col("_d1")) | ((F.col("_c1") == F.col("_d1")) & (F.col("_c2") < F.col("_d2")))
    at = (F.col("_c1") == F.col("_d1")) & (F.col("_c2") == F.col("_d2")) & (F.struct("_rank", "doc_id", "_no") <= F.col("_cut"))
    return F.coalesce((F.col("size") > 0) & (F.col("_rest") > 0) & (before | at), F.lit(False))


def _copies(drawn: Column) -> Column:
    return F.when(F.col("size") > 0, F.col("_whole") + drawn.cast("long")).otherwise(F.lit(0)).cast("long")


def _classes(rows: DataFrame) -> DataFrame:
    """``doc_id, source, size, _rows``: rows that the mix cannot tell apart are one class; most classes are one row."""
    return materialise(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("_rows")), "mix-sizes")


def _each(classes: DataFrame) -> DataFrame:
    """One row per row again, numbered within its class."""
    return classes.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))).alias("_no"))


def _bounds(classes: DataFrame, weights: tuple[int, ...], most: float, seed: int) -> DataFrame:
    """Per source: target, certain copies, what is left for the draw, the slope of the inclusion odds and the cut."""
    known = classes.groupBy("source", "size").agg(F.sum("_rows").alias("_n"))
    known = known.withColumn("_words", F.col("size") * F.col("_n")).withColumn("_root", F.floor(F.sqrt(F.col("size").cast("double")) * 1024))
    known = materialise(known.withColumn("_steep", F.col("_root").cast("decimal(18,0)") * F.col("_words").cast("decimal(18,0)")), "mix-lengths")
    targets = source_targets(known.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, most)
    t = F.col("target")
    sources = targets.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(t / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    sources = materialise(sources.withColumn("_rest", F.greatest(F.lit(0.0), t - F.col("_whole") * F.col("source_size"))), "mix-targets")
    # The slope for which the expected words are what is left, given that no chance exceeds 1: sizes above some size are certain.
    larger = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = (
        known.filter("size > 0")
        .withColumn("_over", F.coalesce(F.sum("_words").over(larger), F.lit(0)))
        .withColumn("_under", F.sum("_steep").over(smaller).cast("double"))
        .join(sources.select(F.col("source").alias("_s"), "_rest"), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("_level", F.greatest(F.lit(0.0), F.col("_rest") - F.col("_over")) * 1024.0 / F.col("_under"))
        .filter(F.col("_level") * F.col("_root") <= 1024.0)
        .groupBy("source")
        .agg(F.max_by("_level", "size").alias("_slope"))
    )
    sources = sources.join(levels.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    sources = materialise(sources.withColumn("_slope", F.coalesce("_slope", F.lit(0.0))), "mix-sources")
    ranked = _ranked(_each(classes), sources, seed).filter("size > 0 and _rest > 0")
    first = _cell(ranked, [], "_c1")
    inside = _within(ranked, first, ["_c1"])
    second = _cell(inside, ["_c1", "_before"], "_c2")
    last = _within(inside.drop("_before"), second, ["_c1", "_c2"])
    order = Window.partitionBy("source").orderBy("_rank", "doc_id", "_no")
    reach = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = (
        last.withColumn("_at", F.col("_before") + F.coalesce(reach, F.lit(0)))
        .filter(F.col("_at") + F.col("size") / 2.0 <= F.col("_rest"))
        .groupBy("source")
        .agg(F.max(F.struct("_rank", "doc_id", "_no")).alias("_cut"))
    )
    bounds = (
        sources.alias("s")
        .join(second.select(F.col("source").alias("_n"), F.col("_c1").alias("_d1"), F.col("_c2").alias("_d2")), F.col("source").eqNullSafe(F.col("_n")), "left")
        .join(cut.select(F.col("source").alias("_m"), "_cut"), F.col("source").eqNullSafe(F.col("_m")), "left")
        .drop("_n", "_m")
    )
    return materialise(bounds, "mix-cuts")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 17) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies``: how often the mix takes each document whole.

    A source's target over its size is the number of copies each of its documents should have. The whole part is
    certain. What is left of the target is drawn once per document, with inclusion probability rising with the square
    root of its size, by Pareto order sampling: documents in the order of their random odds over their inclusion odds,
    taken until the words reach what is left. Where a probability would exceed 1 the document is certain, and the others'
    are raised so that the expected words stay what is left. The sample is fixed in words, not only on average: a source
    misses its target by half a document at most.

    The order is cut without sorting a source: words per cell of the rank give the cell where the target falls, twice,
    and only the rows of that innermost cell are sorted. A source that holds a third of all rows is one partial
    aggregate per task. Texts are read once; what follows works on ids and sizes.

    Args:
        docs: needs ``doc_id, text, source``; other columns are ignored.
        weights: in turn, for the sources in code-point order, null last.
        most: no source, and no document, is taken more often than this.
        seed: another seed, another sample.

    Defined cases: a null or blank text has size 0 and 0 copies. A null source is a source of its own. Rows that repeat
    an id are drawn one by one: those of equal source and size are counted as one class before the shuffle, and numbered.
    A table without words has targets and copies of 0. An empty table gives an empty result.
    """
    classes = _classes(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    final = _ranked(_each(classes), _bounds(classes, weights, most, seed), seed)
    return final.select("doc_id", "source", "size", "source_size", "target", _copies(_drawn()).alias("copies"))


def _cell(rows: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """Per source, the cell in which the words taken in rank order reach the target, and the words before it."""
    known = ["_before"] if "_before" in keys else []
    sums = rows.groupBy("source", "_rest", *keys, cell).agg(F.sum("size").alias("_words"))
    order = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_words").over(order), F.lit(0)) + (F.col("_before") if known else F.lit(0))
    return (
        sums.withColumn("_start", start)
        .filter(F.col("_start") <= F.col("_rest"))
        .withColumn("_last", F.row_number().over(Window.partitionBy("source").orderBy(F.col(cell).desc())))
        .filter("_last = 1")
        .select("source", *[k for k in keys if k != "_before"], cell, F.col("_start").alias("_before"))
    )


def _within(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each source's cell, with the words before it."""
    right = cells.select(F.col("source").alias("_cs"), *[F.col(k).alias(f"_k{k}") for k in keys], "_before")
    match = F.col("source").eqNullSafe(F.col("_cs"))
    for k in keys:
        match = match & (F.col(k) == F.col(f"_k{k}"))
    return rows.join(right, match).drop("_cs", *[f"_k{k}" for k in keys])


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 17) -> DataFrame:
    """The mixed table itself: each document as many times as :func:`mix_plan` takes it, with the columns of ``docs``.

    The draw is decided by bounds per source, so that no text is joined or shuffled; only rows that repeat an id, source and
    size are written aside, as the numbers that tell them apart depend on where they lie.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), whole)
    classes = _classes(sized.drop("_row"))
    bounds = _bounds(classes, weights, most, seed)
    again = materialise(classes.filter("_rows > 1 and size > 0").withColumnsRenamed({"doc_id": "_i", "source": "_s", "size": "_z"}), "mix-repeated")
    rows = sized.withColumn("_no", F.lit(1).cast("long"))
    if not again.isEmpty():
        like = F.col("doc_id").eqNullSafe(F.col("_i")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
        rows = rows.join(again.drop("_rows"), like, "left_anti").unionByName(_numbered(sized.join(again.drop("_rows"), like, "left_semi")))
    planned = _ranked(rows, bounds, seed).withColumn("copies", _copies(_drawn()))
    repeat = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")
    return planned.filter("copies > 0").select("_row", repeat).select("_row.*")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with their number within their class: the rows of the class in earlier parts, and the place in the own part."""
    key = ["doc_id", "source", "size"]
    held = materialise(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "mix-rows")
    parts = held.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(c).alias(f"_k{c}") for c in key], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"))
    places = held.select(*key, "_part", "_at", F.row_number().over(Window.partitionBy(*key, "_part").orderBy("_at")).alias("_place"))
    same = F.col("_part") == F.col("_p")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_k{c}"))
    numbers = places.join(parts, same).select(F.col("_at").alias("_a"), (F.col("_n") + F.col("_place")).alias("_no"))
    return held.join(numbers, F.col("_at") == F.col("_a")).select(*key, "_row", F.col("_no").cast("long").alias("_no"))
