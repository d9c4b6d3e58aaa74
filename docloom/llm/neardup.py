"""Near duplicates by weighted Jaccard similarity of word shingles: BagMinHash signatures.

A text is the multiset of its five-word shingles. Each shingle starts Poisson processes,
one for each dyadic interval of weights (0 to 1, 1 to 2, 2 to 4, ...), with a rate as large
as the interval. A point has a time, a register and a weight, and counts if its weight
is below the shingle's multiplicity. A register keeps its earliest point, so two texts
agree in a register with just their weighted Jaccard similarity. Points are drawn in
order of time and a process stops when it is later than all registers of its text.

Texts that agree in a band of registers are candidates for one another; what hangs together
by candidates is a cluster. The multisets of a cluster are compared exactly, in blocks of
bounded size, and a block returns the groups it found, never its pairs. In clusters of very
many blocks the members of a band's bucket meet its smallest id first, and, once the linked
ones form groups, only members of different groups meet, again in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import blocks as B
from docloom.llm import words as W
from docloom.session import materialise

SHINGLE = 5
REGISTERS, ROWS = 128, 4
SIMILARITY = (4, 5)
#: Ids of documents to compare that are sent to all tasks; more go through a join.
BROADCAST_IDS = 1_000_000
_PIECE = 2 << 20
_POINTS = 1 << 18
#: Part of a cluster: so many texts, and so many bytes of their multisets, at most.
PART_TEXTS, PART_BYTES = 250, 4 << 20
#: Parts of a cluster up to which all its blocks (pairs of parts) are compared.
PARTS = 32
#: Parts of a larger cluster are so many times larger in texts, and in bytes.
_MORE_TEXTS, _MORE_BYTES = 4, 2


def shingles(raw: W.Text) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hash and text of every shingle. A text of fewer words is one shingle."""
    words = W.split_words(raw)
    hashes = W.hash_spans(raw.data, words.start, words.end)
    place = np.flatnonzero(W.inside_text(words, SHINGLE))
    values, text = [W.window_hashes(hashes, SHINGLE)[place]], [words.text[place]]
    for size in range(1, SHINGLE):
        short = np.flatnonzero(words.counts == size)
        values.append(W.mix(W.window_hashes(hashes, size)[words.first[short]], size))
        text.append(short)
    return np.concatenate(values), np.concatenate(text)


def occurrences(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with multiplicity: text, shingle, count; sorted by both."""
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    fresh = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (text[1:] != text[:-1])])) if len(values) else np.empty(0, np.int64)
    return text[fresh], values[fresh], np.diff(np.append(fresh, len(values)))


def bag_signatures(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """Earliest time in each register of each text; infinite for a text without shingles."""
    times = np.full((texts, registers), np.inf)
    flat = times.ravel()
    row, seed, low, width, most = [], [], [], [], []
    level, top = 0, int(count.max(initial=0))
    while (start := 0 if not level else 1 << (level - 1)) < top:
        here = np.flatnonzero(count > start)
        row.append(text[here])
        seed.append(W.mix(shingle[here], 100 + level))
        low.append(np.full(len(here), start))
        width.append(np.full(len(here), max(1, start)))
        most.append(count[here])
        level += 1
    if not row:
        return times
    row, seed, low, width, most = (np.concatenate(x) for x in (row, seed, low, width, most))
    now, drawn = np.zeros(len(row)), 0
    while len(row):
        # few processes that go on for long draw many points at a time
        points = max(1, min(64, _POINTS // len(row)))
        steps = W.mix(seed[:, None] + (np.arange(drawn, drawn + points, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :])
        drawn += points
        gaps = -np.log1p(-(steps >> np.uint64(11)).astype(np.float64) / float(1 << 53)) / width[:, None]
        # added one by one, so that a point's time does not depend on how many are drawn at once
        gaps[:, 0] += now
        time = np.cumsum(gaps, axis=1)
        place = W.mix(steps, 5)
        register = (place % np.uint64(registers)).astype(np.int64)
        weight = low[:, None] + ((place >> np.uint64(32)).astype(np.float64) / float(1 << 32) * width[:, None]).astype(np.int64)
        counts = weight < most[:, None]
        np.minimum.at(flat, (row[:, None] * registers + register)[counts], time[counts])
        now = time[:, -1]
        on = np.flatnonzero(now < times.max(axis=1)[row])
        row, seed, low, width, most, now = (x[on] for x in (row, seed, low, width, most, now))
    return times


def _signed(batch: pa.RecordBatch, id: str, text: str) -> pa.RecordBatch:
    """Text hashes, band keys and sketch of each row; equal texts are worked on once."""
    raw = W.text_bytes(batch.column(text))
    whole = W.hash_spans(raw.data, raw.offsets[:-1], raw.offsets[1:])
    _, first, which = np.unique(whole, return_index=True, return_inverse=True)
    kept = raw if len(first) == len(whole) else W.text_bytes(batch.column(text).take(pa.array(first)))
    if len(first) == len(whole):
        which = np.arange(len(whole))
    times = bag_signatures(*occurrences(*shingles(kept)), len(kept.offsets) - 1)
    bits = W.mix(times.view(np.uint64))
    bands = bits.reshape(len(bits), -1, ROWS)
    keys = bands[:, :, 0].copy()
    for k in range(1, ROWS):
        keys = W.mix(keys * np.uint64(0xD1342543DE82EF95) + bands[:, :, k])
    keys = W.mix(keys + np.arange(keys.shape[1], dtype=np.uint64)[None, :]).view(np.int64)
    full = np.isfinite(times[:, 0])
    keys, full = keys[which], full[which]
    sizes = np.where(full, keys.shape[1], 0)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(keys[full].ravel()))
    sketch = (bits & np.uint64(0xFF)).astype(np.uint8)[which]
    return pa.RecordBatch.from_arrays(
        [batch.column(id), pa.array(whole.view(np.int64)), pa.array(W.mix(whole ^ np.diff(raw.offsets).astype(np.uint64), 9).view(np.int64)), lists, pa.array([x.tobytes() for x in sketch], pa.binary())],
        names=["doc", "text_1", "text_2", "keys", "sketch"],
    )


def sign(docs: DataFrame, id: str, text: str) -> DataFrame:
    def run(batches):
        for batch in B.cut_batches(batches, text, _PIECE):
            yield _signed(batch, id, text)

    return materialise(docs.select(id, text).mapInArrow(run, "doc long, text_1 long, text_2 long, keys array<long>, sketch binary"), "signatures")


def _multisets(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``doc`` and its multiset of shingles, as a sorted array of 64-bit numbers in which
    the second, third, ... occurrence of a shingle is a number of its own."""

    def run(batches):
        for batch in B.cut_batches(batches, text, _PIECE):
            owner, value, count = occurrences(*shingles(W.text_bytes(batch.column(text))))
            nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            owner, value = np.repeat(owner, count), W.mix(np.repeat(value, count) + nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
            value = value[np.lexsort((value, owner))]
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            bags = [value[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id), pa.array(bags, pa.binary())], names=["doc", "bag"])

    return docs.select(id, text).mapInArrow(run, "doc long, bag binary")


def similar(left: np.ndarray, right: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> bool:
    """Is the weighted Jaccard similarity of two (sorted, distinct) arrays enough?"""
    a, b = similarity
    most = min(len(left), len(right))
    if b * most < a * max(len(left), len(right)):
        return False
    both = len(left) + len(right) - len(np.union1d(left, right))
    return b * both >= a * (len(left) + len(right) - both)


def verify(pairs: DataFrame, docs: DataFrame, id: str, text: str) -> DataFrame:
    """Those of the pairs ``a, b`` that are similar."""
    pairs = materialise(pairs, "pairs")
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("_wanted")).distinct(), "wanted")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    few = docs.select(id, text).join(wanted, F.col(id) == F.col("_wanted"), "left_semi")
    bags = materialise(_multisets(few, id, text), "bags")
    both = pairs.join(bags.select(F.col("doc").alias("a"), F.col("bag").alias("bag_a")), "a").join(bags.select(F.col("doc").alias("b"), F.col("bag").alias("bag_b")), "b")

    def run(batches):
        for batch in batches:
            good = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("bag_a"), batch.column("bag_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return materialise(both.select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a long, b long"), "links")


def linked_groups(bags: list[np.ndarray], part: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The first member of each one's group. Members are linked by similarity; those of one
    part are only compared if there is no other part, those of one label never. Overlaps are counted by matrix products
    over the shingles that occur twice or more."""
    sizes = np.array([len(b) for b in bags], np.int64)
    owner = np.repeat(np.arange(len(bags)), sizes)
    values, which, counts = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True) if len(owner) else (np.empty(0), owner, owner)
    place = np.cumsum(counts > 1) - 1
    shared = counts[which] > 1
    column, row = place[which[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((len(bags), len(bags)), np.float64)
    for low in range(0, int((counts > 1).sum()), 2048):
        a, b = np.searchsorted(column, (low, low + 2048))
        dense = np.zeros((len(bags), 2048), np.float32)
        dense[row[a:b], column[a:b] - low] = 1
        both += dense @ dense.T
    a, b = SIMILARITY
    linked = b * both >= a * (sizes[:, None] + sizes[None, :] - both)
    if len(np.unique(part)) > 1:
        linked &= part[:, None] != part[None, :]
    if label is not None:
        linked &= label[:, None] != label[None, :]
    first = np.full(len(bags), -1)
    for start in range(len(bags)):
        if first[start] < 0:
            reached = frontier = np.arange(len(bags)) == start
            while frontier.any():
                frontier = linked[frontier].any(axis=0) & ~reached
                reached = reached | frontier
            first[reached] = start
    return first


def _compared(table: pa.Table) -> pa.Table:
    """Links from each member of a block to the first of its group; with a ``name``, groups
    known before, those of one name are not compared."""
    doc = table.column("doc").to_numpy()
    order = np.argsort(doc)
    bags = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("bag")]
    name = table.column("name").to_numpy()[order] if "name" in table.column_names else None
    first = linked_groups([bags[k] for k in order], table.column("part").to_numpy()[order], name)
    doc = doc[order]
    other = np.flatnonzero(first != np.arange(len(doc)))
    return pa.table({"a": doc[other], "b": doc[first[other]]})


def _cluster_links(clusters: DataFrame, docs: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Links that span the groups of all clusters (``node, label``) but the largest, and
    the multisets of those (``doc, cluster, bag``)."""
    held = materialise(clusters.withColumnRenamed("node", "doc"), "clustered")
    ids = held.select(F.col("doc").alias("_wanted"))
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    bags = materialise(_multisets(docs.select(id, text).join(wanted, F.col(id) == F.col("_wanted"), "left_semi"), id, text).join(held, "doc"), "bags")
    sizes = bags.groupBy("label").agg(F.ceil(F.greatest(F.count("*") / PART_TEXTS, F.sum(F.length("bag")) / PART_BYTES)).cast("int").alias("parts"))
    sizes = materialise(sizes, "parts")
    few, many = sizes.where(F.col("parts") <= PARTS), sizes.where(F.col("parts") > PARTS)
    part = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
    cut = bags.join(few, "label").withColumn("part", part)
    beside = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    # a part meets every other part, and itself where it is the only one or at its own place
    blocks = cut.select("label", "doc", "bag", "part", beside).select(
        "label", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "doc", "bag", "part"
    )

    links = materialise(blocks.groupBy("label", "left", "right").applyInArrow(_compared, "a long, b long"), "links")
    return links, bags.join(many, "label").select("doc", F.col("label").alias("cluster"), "bag")


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every linked node; the label is the smallest node of its component.

    In every round each node takes its smallest neighbour, is sent on along what that one
    took (four steps), and the links are drawn between what nodes have become; links that
    become loops go. Links shrink fast, and chains to a quarter in each round. Nothing
    reaches the driver but whether links are left.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    edges = materialise(edges, "edges")
    labels = None
    while True:
        taken = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        roots = edges.select(F.col("a").alias("node"), F.col("a").alias("parent"))
        parents = taken.unionByName(roots).groupBy("node").agg(F.min("parent").alias("parent"))
        for _ in range(2):
            parents = materialise(parents, "parents")
            further = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
            parents = parents.join(further, "parent").select("node", F.col("next").alias("parent"))
        parents = materialise(parents, "parents")
        if labels is None:
            labels = parents.withColumnRenamed("parent", "label")
        else:
            moved = parents.select(F.col("node").alias("label"), "parent")
            labels = materialise(labels.join(moved, "label", "left").select("node", F.coalesce("parent", "label").alias("label")), "labels")
        drawn = edges.join(parents.select(F.col("node").alias("a"), F.col("parent").alias("to_a")), "a")
        drawn = drawn.join(parents.select(F.col("node").alias("b"), F.col("parent").alias("to_b")), "b").where("to_a != to_b")
        edges = materialise(drawn.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        if not edges.limit(1).count():
            return labels


def _blocks(buckets: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks (``cluster, key, left, right``) in which any two members of one bucket and of
    different groups meet: ``doc``, its group as ``name``, and its ``part``.

    The largest group of a bucket and all others are each cut by hash into parts of bounded
    size; parts of the others meet each other and those of the largest. Buckets with equal
    members are taken once. Where that moves fewer bytes, the whole cluster is one bucket.
    """
    by = ["cluster", "whole", "key"]
    pairs = buckets.join(members, "doc").select("cluster", F.lit(False).alias("whole"), "key", "doc", "size")
    pairs = pairs.unionByName(members.select("cluster", F.lit(True).alias("whole"), F.col("cluster").alias("key"), "doc", "size"))
    named = pairs.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("name", F.coalesce("label", "doc")).drop("label")
    named = materialise(named, "named")
    groups = named.groupBy(*by, "name").agg(
        F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y")
    )
    sides = groups.groupBy(by).agg(
        F.max(F.struct("n", "name", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")
    )
    sides = sides.where("n > top.n").dropDuplicates(["cluster", "whole", "n", "x", "y"])

    def parts(n, size):
        return F.ceil(F.greatest(n / (_MORE_TEXTS * PART_TEXTS), size / (_MORE_BYTES * PART_BYTES), F.lit(1))).cast("int")

    rest = F.col("size") - F.col("top.size")
    sides = sides.select(
        *by,
        F.col("top.name").alias("top"),
        parts(F.col("top.n"), F.col("top.size")).alias("tops"),
        parts(F.col("n") - F.col("top.n"), rest).alias("others"),
        F.col("top.size").alias("top_size"),
        rest.alias("rest"),
    )
    sides = materialise(sides, "sides")
    moved = F.col("rest") * (F.col("others") + F.col("tops")) + F.col("top_size") * F.col("others")
    way = sides.groupBy("cluster").agg(F.sum(F.when(F.col("whole"), moved)).alias("once"), F.sum(F.when(~F.col("whole"), moved)).alias("often"))
    way = way.where("often > 0").select("cluster", (F.col("once") < F.col("often")).alias("whole"))
    rows = named.join(sides.join(way, ["cluster", "whole"]).drop("top_size", "rest"), by)
    top = F.col("name") == F.col("top")
    part = F.when(top, F.col("others") + F.pmod(F.xxhash64("doc"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("doc"), F.col("others"))).cast("int")
    beside = F.explode(F.sequence(F.lit(0), F.col("others") - 1 + F.when(top, 0).otherwise(F.col("tops"))))
    rows = rows.select("cluster", "key", "doc", "name", part.alias("part"), beside.alias("other"))
    return rows.select("cluster", "key", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "doc", "name", "part")


def _links_by_buckets(buckets: DataFrame, huge: DataFrame, docs: DataFrame, id: str, text: str) -> DataFrame:
    """Links that span the groups of clusters too large for blocks of the whole: members of
    a bucket meet its center, and then all members of other groups."""
    members = materialise(huge.select("doc", "cluster", F.length("bag").cast("long").alias("size")), "members")
    buckets = materialise(buckets.join(members.select("doc"), "doc"), "huge")
    met = buckets.where("doc != center").select(F.col("doc").alias("a"), F.col("center").alias("b")).distinct()
    links = verify(met, docs, id, text)
    blocks = _blocks(buckets.select("key", "doc"), members, components(links)).join(huge.select("doc", "bag"), "doc")
    found = blocks.groupBy("cluster", "key", "left", "right").applyInArrow(_compared, "a long, b long")
    return links.unionByName(materialise(found, "links"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` (the id) of every row with ``copy_of``, the smallest id with the same text,
    and ``class_id``, the smallest id of its group: texts linked, directly or through
    others, by a weighted Jaccard similarity of at least 0.8 of their five-word shingles.

    Ids are integers and belong to one row each; rows of equal id and text give equal
    rows. A text of one to four words is one shingle; one without words (NULL counts as
    empty) is in a group with equal texts only. A NULL id is no text's smallest id: a text
    that only such rows have gets NULL. Other columns are not carried over. An empty table
    gives an empty table.
    """
    signed = sign(docs.withColumn(id, F.col(id).cast("long")), id, text)
    texts = signed.groupBy("text_1", "text_2").agg(F.min("doc").alias("doc"), F.any_value("keys").alias("keys"))
    texts = materialise(texts, "texts")
    banded = texts.select("doc", F.explode("keys").alias("key"))
    centers = materialise(banded.groupBy("key").agg(F.min("doc").alias("center"), F.count("*").alias("n")).where("n > 1").drop("n"), "centers")
    buckets = materialise(banded.join(centers, "key"), "buckets")
    typed = docs.withColumn(id, F.col(id).cast("long"))
    candidates = materialise(buckets.where("doc != center").select(F.col("doc").alias("a"), F.col("center").alias("b")).distinct(), "candidates")
    links, huge = _cluster_links(components(candidates), typed, id, text)
    if huge.limit(1).count():
        links = links.unionByName(_links_by_buckets(buckets, huge, typed, id, text))
    labels = components(links)
    classes = texts.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("text_1", "text_2", F.col("doc").alias("copy_of"), F.coalesce("label", "doc").alias("class_id"))
    classes = materialise(classes, "classes")
    return signed.join(classes, ["text_1", "text_2"]).select(F.col("doc").alias("doc_id"), "copy_of", "class_id")
