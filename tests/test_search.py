"""Nearest-neighbour search against brute force, with ties, hot groups and bad input."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import vectors
from docloom.operators import blocks, index, search

DIM = 8


def frame(spark, points, name="id"):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, f"{name} bigint, vector array<float>").repartition(4)


def brute(questions, points, k, exclude=False, allowed=lambda q, i: True):
    out = {}
    for q, question in enumerate(np.asarray(questions, np.float32).astype(float)):
        pairs = []
        for i, point in enumerate(np.asarray(points, np.float32).astype(float)):
            if allowed(q, i) and not (exclude and q == i):
                pairs.append((round(float(((question - point) ** 2).sum()), blocks.DECIMALS), i))
        out[q] = [i for _, i in sorted(pairs)[:k]]
    return out


def found(hits):
    out = {}
    for row in hits.orderBy("qid", "rank").collect():
        out.setdefault(row.qid, []).append(row.id)
    return out


@pytest.fixture(scope="module")
def points():
    """300 rows, a third of them copies of one vector, and clusters around others."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(5, DIM)) * 4
    spread = centres[rng.integers(0, 5, 200)] + rng.normal(size=(200, DIM))
    copies = np.repeat(spread[:1], 100, axis=0)
    both = np.concatenate([spread, copies])
    return both[rng.permutation(len(both))]


@pytest.fixture(scope="module")
def built(spark, points):
    return index.build_index(frame(spark, points), dim=DIM, nlist=6)


@pytest.mark.parametrize("exclude", [False, True])
def test_scan_equals_brute_force(spark, points, exclude):
    rows = frame(spark, points)
    hits = search.nearest(rows.withColumnRenamed("id", "qid"), rows, 7, dim=DIM, exclude_same_id=exclude)
    assert found(hits) == brute(points, points, 7, exclude)


@pytest.mark.parametrize("exclude,nprobe", [(False, 1), (True, 2), (True, 6)])
def test_pruned_equals_brute_force(spark, points, built, exclude, nprobe, monkeypatch):
    monkeypatch.setattr(search, "ROWS_PER_BLOCK", 30)
    monkeypatch.setattr(search, "QUESTIONS_PER_BLOCK", 40)
    rows = frame(spark, points)
    hits = search.nearest_pruned(
        rows.withColumnRenamed("id", "qid"), rows, 7, dim=DIM, exclude_same_id=exclude, nprobe=nprobe, index=built
    )
    assert found(hits) == brute(points, points, 7, exclude)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_tiny_tables_give_the_same_either_way(spark, n):
    points = np.eye(DIM)[:n]
    rows = frame(spark, points) if n else spark.createDataFrame([], "id bigint, vector array<float>")
    questions = frame(spark, np.eye(DIM)[:4], "qid")
    want = brute(np.eye(DIM)[:4], points, 2) if n else {}
    for limit in (1, 1000):
        assert found(search.nearest(questions, rows, 2, dim=DIM, max_broadcast_questions=limit)) == want
    assert found(search.nearest_pruned(questions, rows, 2, dim=DIM)) == want


def test_a_model_behind_the_vectors_runs_once_per_row(spark):
    calls = spark.sparkContext.accumulator(0)

    def factory():
        def encode(texts):
            calls.add(len(texts))
            return np.array([[float(t), 1.0] for t in texts], np.float32)

        return encode

    from docloom.operators import models

    def embedded(name):
        return models.embed(spark.range(40).select(F.col("id").alias(name), F.col("id").cast("string").alias("text"), (F.col("id") % 2).alias("doc")), factory, dim=2)

    asked, rows = embedded("qid"), embedded("id")
    assert search.nearest(asked, rows, 2, dim=2, max_broadcast_questions=7).count() == 80 and calls.value == 80
    calls.value = 0
    assert search.nearest_within(asked, rows, "doc", 2, dim=2).count() == 80 and calls.value == 80
    calls.value = 0
    index.build_index(rows, dim=2, nlist=3)
    assert calls.value == 40


def test_questions_in_turns(spark, points):
    rows = frame(spark, points)
    hits = search.nearest(rows.withColumnRenamed("id", "qid"), rows, 3, dim=DIM, max_broadcast_questions=10)
    assert found(hits) == brute(points, points, 3)


@pytest.mark.parametrize("limit", [0, 1000])
def test_all_lists_equal_exact(spark, points, built, limit):
    questions = frame(spark, points[:50], "qid")
    hits = search.nearest_by_lists(questions, built, 4, nprobe=6, max_broadcast_questions=limit)
    assert found(hits) == brute(points[:50], points, 4)


def test_both_ways_through_lists_agree(spark, points, built):
    questions = frame(spark, points[:60], "qid")
    ways = [
        found(search.nearest_by_lists(questions, built, 4, nprobe=2, max_broadcast_questions=limit)) for limit in (0, 1000)
    ]
    assert ways[0] == ways[1]


def test_list_invariants(spark, points, built):
    assert built.rows.count() == len(points) == built.rows.select("id").distinct().count()
    assert index.index_size(built).agg(F.sum("n_rows")).head()[0] == len(points)
    for row in built.rows.collect():
        point = np.array(row.vector)
        to_all = np.sqrt(((built.centroids - point) ** 2).sum(axis=1))
        assert to_all[row.list_id] <= to_all.min() + 1e-6
        assert to_all[row.list_id] <= built.radii[row.list_id] + 1e-6


def test_recall_grows_with_probes(spark, points, built):
    questions = frame(spark, points, "qid")
    exact = brute(points, points, 5)

    def recall(nprobe):
        hits = found(search.nearest_by_lists(questions, built, 5, nprobe=nprobe))
        return np.mean([len(set(hits[q]) & set(exact[q])) / 5 for q in exact])

    assert 0.5 < recall(1) <= recall(3) <= recall(6) == 1.0


@pytest.mark.parametrize("limit", [0, 1000])
def test_within_one_document(spark, points, limit):
    label = F.when(F.col("id") % 3 != 0, F.lit(7)).when(F.col("id") % 2 == 0, F.lit(8))
    rows = frame(spark, points).withColumn("doc", label)
    questions = rows.withColumnRenamed("id", "qid")

    def doc(i):
        return 7 if i % 3 else 8 if i % 2 == 0 else None

    hits = search.nearest_within(
        questions, rows, "doc", 3, dim=DIM, exclude_same_id=True, max_broadcast_questions=limit
    )
    assert found(hits) == brute(points, points, 3, True, lambda q, i: doc(q) is None or doc(q) == doc(i))


def test_ties_go_to_the_smaller_id(spark):
    points = [[1.0] * DIM] * 50 + [[0.0] * DIM]
    hits = search.nearest(frame(spark, [[1.0] * DIM], "qid"), frame(spark, points), 5, dim=DIM)
    assert found(hits) == {0: [0, 1, 2, 3, 4]}


def test_k_above_row_count_and_text_ids(spark):
    points = np.eye(DIM)[:3]
    rows = frame(spark, points).withColumn("id", F.concat(F.lit("chunk-"), "id"))
    hits = search.nearest(frame(spark, [points[1]], "qid"), rows, 10, dim=DIM)
    assert found(hits) == {0: ["chunk-1", "chunk-0", "chunk-2"]}


def test_no_questions(spark, points):
    rows = frame(spark, points)
    assert search.nearest(rows.where("id < 0").withColumnRenamed("id", "qid"), rows, dim=DIM).count() == 0


@pytest.mark.parametrize("bad", [[1.0, 2.0], None, [None] * DIM])
def test_bad_vectors_raise(spark, bad):
    rows = spark.createDataFrame([(0, [0.0] * DIM), (1, bad)], "id bigint, vector array<float>")
    with pytest.raises(Exception, match="vector"):
        search.nearest(frame(spark, [[0.0] * DIM], "qid"), rows, dim=DIM).collect()


def test_bad_parameters(spark, built):
    questions = frame(spark, [[0.0] * DIM], "qid")
    with pytest.raises(ValueError):
        search.nearest_by_lists(questions, built, nprobe=0)
    with pytest.raises(ValueError):
        index.train_centroids(questions, 1024, nlist=10**6)


def test_pair_distance(spark):
    table = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<float>, b array<float>")
    assert tuple(table.select(vectors.l2_sq(F.col("a"), F.col("b")), vectors.l2(F.col("a"), F.col("b"))).head()) == (25.0, 5.0)
    with pytest.raises(Exception, match="dimension"):
        table.select(vectors.l2_sq(F.col("a"), F.slice("b", 1, 1))).collect()


def test_first_copies_keep_smallest_ids():
    rows = np.array([[1.0], [2.0], [1.0], [1.0], [2.0]])
    kept = blocks.first_copies(np.array([9, 8, 7, 6, 5]), rows, 2)
    assert sorted(np.array([9, 8, 7, 6, 5])[kept]) == [5, 6, 7, 8]


def test_a_block_of_ties_needs_little_memory():
    """Two million pairs at one distance, compared a part at a time."""
    rows = np.random.default_rng(3).choice([-0.125, 0.125], size=(10_000, 64))
    ids = np.arange(10_000)[::-1].copy()
    tracemalloc.start()
    q, r, d = blocks.nearest_in_block(np.arange(200), np.zeros((200, 64)), ids, rows, 5, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert q.tolist() == np.repeat(np.arange(200), 5).tolist() and (d == 1.0).all()
    assert ids[r].reshape(200, 5).tolist() == [[0, 1, 2, 3, 4]] * 200
    assert peak < 100_000_000


def test_index_append_and_schema_check(spark, points, tmp_path):
    path = str(tmp_path / "index")
    rows = frame(spark, points)
    index.build_index(rows, dim=DIM, nlist=4, path=path)
    with pytest.raises(ValueError, match="already"):
        index.build_index(rows, dim=DIM, nlist=4, path=path)
    held = index.open_index(spark, path)
    more = index.append_to_index(rows.withColumn("id", F.col("id") + 1000), path)
    assert more.rows.count() == 2 * len(points) == more.sizes.agg(F.sum("n_rows")).head()[0]
    assert index.index_size(held).agg(F.sum("n_rows")).head()[0] == len(points) == held.rows.count()
    with pytest.raises(ValueError, match="schema"):
        index.append_to_index(rows.withColumn("other", F.lit(1)), path)


def test_hydrate_drops_empty_text_after_the_cut(spark):
    hits = spark.createDataFrame([(0, 1, 0.1, 1), (0, 2, 0.2, 2), (0, 3, 0.3, 3)], "qid bigint, id bigint, l2_sq double, rank bigint")
    texts = spark.createDataFrame([(1, "a", ""), (2, "b", "text"), (4, "c", "other")], "id bigint, filename string, text string")
    assert [r.id for r in search.hydrate(hits, texts).collect()] == [2]
