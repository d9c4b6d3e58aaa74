"""Mixing sources to target weights by capped water-filling.

A source gets its weight's share of the budget, but never more than a number of epochs of
what it holds; what it cannot use goes to the others by their weights, until no source
is above its cap. A source is then taken in whole repetitions and one that is
cut: rows have a seeded place in their source, all before the cut are taken once more, the
row at the cut in part. The cut is found by binned sums, bin within bin, so that no
source is ever sorted or held by one task. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import materialise

SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
#: A place has 52 bits (13 hex digits), taken 13 at a time: a round sees 8,192 bins of a source.
ROUND_BITS, ROUNDS = 13, 4
#: Up to so many sources their table is broadcast; a larger one is joined in salted parts.
BROADCAST_SOURCES = 100_000
SALTS = 64


def word_count(text: Column) -> Column:
    """Words between white space, without an array of them."""
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORDS, "x"), SPACES, "")
    return F.octet_length(marked).cast("long")


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """``source, weight``: the distinct values of the one column of ``sources`` in order of code
    points, NULL last, with the weights of ``cycle`` in turn.

    Values are numbered inside ranges, and the ranges' counts are added up.
    """
    name = sources.columns[0]
    ordered = sources.select(F.col(name).alias("source")).distinct().repartitionByRange(F.col("source").asc_nulls_last())
    ordered = materialise(ordered.withColumn("range", F.spark_partition_id()), "sources")
    sizes = ordered.groupBy("range").count()
    offsets = sizes.select("range", (F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("range")) - F.col("count")).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    numbered = ordered.withColumn("nth", nth).join(F.broadcast(offsets), "range")
    place = ((F.col("offset") + F.col("nth")) % len(cycle)).cast("int")
    return numbered.select("source", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), place + 1).alias("weight"))


def _beside(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Rows with the columns of their source (``source`` of the right side is dropped)."""
    right = sources.withColumnRenamed("source", "its_source")
    if few:
        return rows.join(F.broadcast(right), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    right = right.withColumn("its_salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    same = F.col("source").eqNullSafe(F.col("its_source")) & ((F.col("u") % SALTS).cast("int") == F.col("its_salt"))
    return rows.join(right, same).drop("its_source", "its_salt")


def _water_level(sources: DataFrame, budget: float) -> float:
    """Words per unit of weight, once every source above its cap is clamped to it.

    Each round adds up what clamped sources take and what weight is left; it ends when no
    further source is clamped. Three numbers a round reach the driver.
    """
    level, clamped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("cap") if clamped >= 0 else F.lit(False)
        row = sources.agg(
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("taken"),
            F.count(F.when(full, 1)).alias("clamped"),
        ).first()
        if not row.open:
            return float("inf") if row.clamped else 0.0
        if row.clamped == clamped:
            return level
        level, clamped = max(0.0, budget - row.taken) / row.open, row.clamped


def _cuts(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """For each source with a cut: ``cut`` (the place where its ``need`` is met), the words
    before that place and those at it."""
    cuts = sources.where("need > 0").select("source", "need", F.lit(0).cast("long").alias("cut"), F.lit(0).cast("long").alias("below"))
    for nth in range(ROUNDS):
        shift = ROUND_BITS * (ROUNDS - 1 - nth)
        inside = _beside(rows, cuts, few).where(F.shiftright("u", shift + ROUND_BITS) == F.col("cut"))
        bins = inside.groupBy("source", "need", "below", F.shiftright("u", shift).alias("bin")).agg(F.sum("size").alias("held"))
        upto = F.col("below") + F.sum("held").over(Window.partitionBy("source").orderBy("bin"))
        passing = bins.withColumn("upto", upto).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("held") < F.col("need")))
        cuts = passing.select("source", "need", F.col("bin").alias("cut"), (F.col("upto") - F.col("held")).alias("below"), "held")
        cuts = materialise(cuts, "cuts")
    return cuts.select("source", "cut", "below", "held")


def mix_sources(
    docs: DataFrame,
    weights: DataFrame,
    budget: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 0,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """How much of every document goes into a mix of ``budget`` times all words.

    ``weights`` has ``source, weight`` (positive, one row per source; a source that is
    not there, or has a weight of NULL, weighs 0). Returns one row per document: ``doc_id`` (the
    id), ``source, size`` (words), ``source_size``, ``target`` (words the mix wants of its source), ``repeats``
    (whole repetitions) and ``taken`` (words in all, repetitions counted). A source's words
    come within one word for each row at the cut of its target, and no document is
    taken more than ``max_epochs`` times, rounded up to whole repetitions.

    NULL sources are one source. A NULL or empty text has size 0 and nothing is taken of
    it. A row's place comes from ``seed`` and its id (of a NULL id: its text), so repeated runs agree;
    rows with the same place are taken alike, each in part if the cut is at them. A budget
    above all caps takes every cap. An empty table gives an empty table; other columns are not read.
    """
    size = word_count(F.col(text))
    own = F.coalesce(F.col(id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own)), 1, 13), 16, 10).cast("long")
    rows = materialise(docs.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), place.alias("u")), "sizes")

    its = weights.select(F.col("source").alias("its_source"), F.col("weight").cast("double").alias("weight"))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sums = sums.join(its, F.col("source").eqNullSafe(F.col("its_source")), "left").drop("its_source")
    sums = sums.withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "cap": F.col("source_size") * F.lit(float(max_epochs))})
    sums = materialise(sums, "sources")
    total, count = sums.agg(F.sum("source_size"), F.count("*")).first()
    few = count <= BROADCAST_SOURCES

    level = _water_level(sums.where("weight > 0"), budget * (total or 0))
    wanted = F.when(F.col("weight") <= 0, 0.0).when(F.col("weight") * F.lit(level) >= F.col("cap"), F.col("cap")).otherwise(F.col("weight") * F.lit(level))
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = sums.withColumn("target", wanted).withColumn("repeats", repeats)
    need = F.round("target").cast("long") - F.col("repeats") * F.col("source_size")
    plan = materialise(plan.withColumn("need", F.greatest(need, F.lit(0).cast("long"))).select("source", "source_size", "target", "repeats", "need"), "plan")

    cuts = _cuts(rows, plan, few).withColumnRenamed("source", "cut_source")
    plan = plan.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    part = F.col("size").cast("decimal(19,0)") * (F.col("need") - F.col("below")).cast("decimal(19,0)")
    extra = (
        F.when(F.col("cut").isNull() | (F.col("u") > F.col("cut")), F.lit(0).cast("long"))
        .when(F.col("u") < F.col("cut"), F.col("size"))
        .otherwise(F.floor(part / F.col("held")).cast("long"))
    )
    mixed = _beside(rows, materialise(plan, "plan"), few)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size") + extra).alias("taken"))
