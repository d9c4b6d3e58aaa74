"""Shards as the leaves of a k-d tree over the metadata of documents.

A node that has to become several shards is split in two at a weighted median, along the
dimension in which it is widest; weights are bytes. All nodes of a level are split
together: the rows are counted into bins between each node's bounds, and the bin that
holds the median into bins again. Only DataFrame functions are used, no node's rows
meet in one task, and a task sees at most the bins of a node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import materialise

BINS = 4096
#: Rounds of binning along the dimension, among equal places by text, inside one text by row.
ROUNDS = {"place": 2, "copy": 2, "row": 3}
#: Copies of one text stay together unless they are more than this share of a shard.
GROUP_SHARE = 0.05
ROW_BYTES = 16
#: Up to so many nodes the (one row per node) table of cuts is broadcast.
BROADCAST_NODES = 100_000
SLOT_ROWS = 20_000


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text and what a row takes besides."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


def _unit(value: Column) -> Column:
    """A 64-bit hash as a number of 52 bits, which a double holds exactly."""
    return F.shiftrightunsigned(value, 12).cast("double")


def metadata_dimensions(docs: DataFrame, id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """Language and source (as hashes), length on a log scale, and the id."""
    names = [n for n in ("lang", "source") if n in docs.columns]
    out = {n: F.when(F.col(n).isNull(), F.lit(0.0)).otherwise(_unit(F.xxhash64(n))) for n in names}
    out["length"] = F.log(size_of(F.col(text)).cast("double"))
    out["position"] = F.coalesce(F.col(id).cast("double"), F.lit(0.0))
    return out


def _near(nodes: DataFrame, shards: int) -> DataFrame:
    return F.broadcast(nodes) if shards <= BROADCAST_NODES else nodes


def _widest(rows: DataFrame, dimensions: int, spans: list[float], shards: int) -> DataFrame:
    """Nodes that are still several shards, with weight, bounds along the widest
    dimension (against the width of the whole table) and the weight that goes left."""
    places = range(dimensions)
    bounds = [f(f"d{k}").alias(f"{n}{k}") for k in places for n, f in (("low", F.min), ("high", F.max))]
    nodes = rows.where("leaves > 1").groupBy("node", "leaves").agg(F.sum("size").alias("weight"), *bounds)
    width = [(F.col(f"high{k}") - F.col(f"low{k}")) / F.lit(spans[k] or 1.0) for k in places]
    best = F.greatest(*width) if dimensions > 1 else width[0]
    pick = reduce(lambda rest, k: F.when(width[k] >= best, F.lit(k)).otherwise(rest), reversed(places), F.lit(0))
    nodes = nodes.withColumn("axis", pick).withColumn("left_leaves", F.floor(F.col("leaves") / 2).cast("int"))
    chosen = lambda n: F.element_at(F.array(*[F.col(f"{n}{k}") for k in places]), F.col("axis") + 1)
    return nodes.select(
        "node",
        "axis",
        "left_leaves",
        (F.col("weight") / F.col("leaves")).alias("share"),
        (F.col("weight") * F.col("left_leaves") / F.col("leaves")).alias("target"),
        F.lit(0).cast("long").alias("before"),
        F.col("weight").alias("held"),
        chosen("low").alias("place_low"),
        chosen("high").alias("place_high"),
    )


def _narrow(rows: DataFrame, nodes: DataFrame, key: str, value: Column, among: Column, shards: int) -> DataFrame:
    """Replace each node's bounds of ``key`` by those of the bin in which the weight
    reaches the target. ``among``: the rows that lie within the node's bounds so far."""
    low, high = F.col(f"{key}_low"), F.col(f"{key}_high")
    step = F.greatest((high - low) / F.lit(BINS), F.lit(1e-300))
    bin_ = F.least(F.floor((value - low) / step), F.lit(BINS - 1)).cast("int")
    inside = rows.join(_near(nodes, shards), "node").where(among & value.between(low, high))
    # a node's own columns go along as keys, so that the nodes are worked out only once
    bins = inside.groupBy(*nodes.columns, bin_.alias("bin")).agg(F.sum("size").alias("bin_held"), F.min(value).alias("first"), F.max(value).alias("last"))
    sums = bins.withColumn("upto", F.sum("bin_held").over(Window.partitionBy("node").orderBy("bin")))
    below = F.col("before") + F.col("upto") - F.col("bin_held")
    passing = sums.where((below < F.col("target")) & (below + F.col("bin_held") >= F.col("target")))
    others = [c for c in nodes.columns if c not in (f"{key}_low", f"{key}_high", "before", "held")]
    return passing.select(*others, below.alias("before"), F.col("bin_held").alias("held"), F.col("first").alias(f"{key}_low"), F.col("last").alias(f"{key}_high"))


def _split(rows: DataFrame, dimensions: int, spans: list[float], shards: int) -> DataFrame:
    """One level down: every node with several leaves becomes two."""
    place = F.element_at(F.array(*[F.col(f"d{k}") for k in range(dimensions)]), F.col("axis") + 1)
    at_place = place.between(F.col("place_low"), F.col("place_high"))
    at_copy = at_place & F.col("copy").between(F.col("copy_low"), F.col("copy_high"))
    nodes = _widest(rows, dimensions, spans, shards)
    for _ in range(ROUNDS["place"]):
        nodes = _narrow(rows, nodes, "place", place, F.lit(True), shards)
    nodes = nodes.withColumns({"copy_low": F.lit(0.0), "copy_high": F.lit(float(1 << 52))})
    for _ in range(ROUNDS["copy"]):
        nodes = _narrow(rows, nodes, "copy", F.col("copy"), at_place, shards)
    # a small group is one point, which goes left or right as a whole
    nodes = nodes.withColumns(
        {"whole": F.col("held") <= F.lit(GROUP_SHARE) * F.col("share"), "row_low": F.lit(0.0), "row_high": F.lit(float(1 << 52))}
    )
    row = F.when(F.col("whole"), F.lit(0.0)).otherwise(F.col("row"))
    for _ in range(ROUNDS["row"]):
        nodes = _narrow(rows, nodes, "row", row, at_copy, shards)
    cut = F.when(F.col("before") + F.col("held") / 2 <= F.col("target"), F.col("row_high")).otherwise(F.col("row_low") - 1)
    cuts = nodes.select("node", "axis", "left_leaves", "place_low", "place_high", "copy_low", "copy_high", "whole", cut.alias("cut"))
    left = (place < F.col("place_low")) | (
        at_place & ((F.col("copy") < F.col("copy_low")) | (F.col("copy").between(F.col("copy_low"), F.col("copy_high")) & (row <= F.col("cut"))))
    )
    out = rows.join(_near(cuts, shards), "node", "left")
    stays = F.col("left_leaves").isNull() | left
    return out.select(
        *[c for c in rows.columns if c not in ("node", "leaves")],
        F.when(stays, F.col("node")).otherwise(F.col("node") + F.col("left_leaves")).alias("node"),
        F.when(F.col("left_leaves").isNull(), F.col("leaves")).when(left, F.col("left_leaves")).otherwise(F.col("leaves") - F.col("left_leaves")).alias("leaves"),
    )


def _numbered(rows: DataFrame, shards: int, total: int) -> DataFrame:
    """Gapless ``slot`` in every shard: shards are cut into buckets by hash, rows are
    numbered in their bucket, and the buckets' sizes are added up."""
    buckets = max(4, -(-total // (shards * SLOT_ROWS)))
    rows = rows.withColumn("bucket", F.floor(F.col("row") / F.lit(float(1 << 52)) * F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("shard", "bucket").count()
    starts = sizes.select("shard", "bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("start"))
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row", "doc_id", "copy", "size")) - 1
    return rows.withColumn("nth", nth).join(starts, ["shard", "bucket"]).withColumn("slot", F.col("start") + F.col("nth"))


def _row_place(id: str) -> Column:
    """A place for every row: 26 bits of a hash of its id, then 26 of its place in the input, so that rows
    that are equal throughout can be told apart."""
    own = F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.col(id)), 38), 26)
    return (high + F.shiftrightunsigned(own, 38)).cast("double")


def shard_documents(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    dimensions: dict[str, Column] | None = None,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Put every row into one of ``shards`` leaves, or into as many as leave at most about
    ``target_bytes`` in each; returns ``doc_id`` (the id), ``size, text_crc32, shard, slot``.

    ``dimensions`` are numeric columns (default: language, source, length, id); NULL
    counts as 0. Shards differ in bytes by about the row, or the group of equal texts, at
    a cut. Equal texts take the least place of any of them in each dimension and stay in
    one shard, unless they are more than a twentieth of one; then they are cut by a
    hash of the id. Rows that are equal throughout stay together. A NULL text is empty. With fewer
    rows than shards some shards stay empty; an empty table gives an empty table.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either the number of shards or their size")
    given = dimensions or metadata_dimensions(docs, id, text)
    names = [f"d{k}" for k in range(len(given))]
    content = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        F.col(id).alias("doc_id"),
        size_of(F.col(text)).alias("size"),
        F.crc32(content).alias("text_crc32"),
        _unit(F.xxhash64(content)).alias("copy"),
        _row_place(id).alias("row"),
        *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in zip(names, given.values(), strict=True)],
    )
    base = materialise(base, "metadata")
    copies = base.groupBy("copy").agg(F.count("*").alias("n"), *[F.min(n).alias(f"least_{n}") for n in names]).where("n > 1").drop("n")
    copies = materialise(copies, "copies")
    rows = base.join(copies, "copy", "left").select(
        "doc_id", "size", "text_crc32", "copy", "row", *[F.coalesce(f"least_{n}", n).alias(n) for n in names]
    )
    summary = base.agg(F.count("*"), F.sum("size"), *[F.max(n) - F.min(n) for n in names]).first()
    total, weight, spans = summary[0], summary[1] or 0, [float(x or 0.0) for x in summary[2:]]
    shards = shards or max(1, -(-weight // target_bytes))
    rows = rows.withColumns({"node": F.lit(0).cast("int"), "leaves": F.lit(int(shards)).cast("int")})
    rows = materialise(rows, "level")
    for _ in range((shards - 1).bit_length()):
        rows = materialise(_split(rows, len(names), spans, shards), "level")
    return _numbered(rows.withColumnRenamed("node", "shard"), shards, total).select("doc_id", "size", "text_crc32", "shard", "slot")
