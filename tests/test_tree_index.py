"""Two levels of centroids: recall, beams, appends and limits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import index, search, tree_index

DIM = 8


def frame(spark, points, name="id"):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, f"{name} bigint, vector array<float>").repartition(4)


@pytest.fixture(scope="module")
def points():
    """3,000 rows around 60 centres, and as many copies of one vector again by half."""
    rng = np.random.default_rng(3)
    near = rng.normal(size=(60, DIM))[rng.integers(0, 60, 3000)] * 5 + rng.normal(size=(3000, DIM))
    return np.concatenate([near, np.repeat(near[:1], 1500, axis=0)])


@pytest.fixture(scope="module")
def built(spark, points):
    return tree_index.build_tree_index(frame(spark, points), dim=DIM, nlist=100)


def pairs(hits):
    return {(r.qid, r.id) for r in hits.select("qid", "id").collect()}


def test_every_row_is_in_the_nearest_list_of_its_cell(spark, points, built):
    assert built.rows.count() == len(points) == built.lists.agg(F.sum("n_rows")).first()[0]
    lists = {r.list_id: (r.cell, np.array(r.centroid)) for r in built.lists.collect()}
    assert len(built.cells) == 10 and len(lists) > 40
    for row in built.rows.sample(0.05, 1).collect():
        vector = np.array(row.vector)
        assert row.cell == np.argmin(((built.cells - vector) ** 2).sum(axis=1)) == lists[row.list_id][0]
        own = ((lists[row.list_id][1] - vector) ** 2).sum()
        assert all(own <= ((c - vector) ** 2).sum() + 1e-6 for cell, c in lists.values() if cell == row.cell)


def test_recall_against_exact_search(spark, points, built):
    """Every hundredth row as a question, against all rows."""
    asked = frame(spark, points).where("id % 100 = 0 AND id < 3000").withColumnRenamed("id", "qid")
    exact = pairs(search.nearest(asked, frame(spark, points), k=10, dim=DIM))
    found = {n: len(pairs(search_by(asked, built, n)) & exact) / len(exact) for n in (2, 10)}
    assert found[10] >= 0.9 and found[10] >= found[2]
    everything = search_by(asked, built, 1000, beam=100)
    assert pairs(everything) == exact


def search_by(asked, built, nprobe, beam=4):
    return tree_index.nearest_by_tree(asked, built, k=10, nprobe=nprobe, beam=beam)


def test_more_lists_than_a_flat_index_takes(spark, points, monkeypatch):
    monkeypatch.setattr(index, "MAX_CENTROID_FLOATS", 50 * DIM)
    with pytest.raises(ValueError, match="exceed"):
        index.build_index(frame(spark, points[:300]), dim=DIM, nlist=100)
    assert tree_index.build_tree_index(frame(spark, points[:300]), dim=DIM, nlist=100).rows.count() == 300
    with pytest.raises(ValueError, match="third level"):
        tree_index.branches(10**12, 1024)


def test_cells_in_small_blocks_and_appends(spark, points, tmp_path, monkeypatch):
    monkeypatch.setattr(tree_index, "ROWS_PER_BLOCK", 40)
    path = str(tmp_path / "tree")
    first = frame(spark, points[:900])
    one = tree_index.build_tree_index(first, dim=DIM, nlist=30, path=path)
    for _ in range(2):
        two = tree_index.append_to_tree_index(first.withColumn("id", F.col("id") + 1000), path, "more")
    assert two.rows.count() == 1800 and one.rows.count() == 900
    same = two.rows.groupBy((F.col("id") % 1000).alias("n")).agg(F.countDistinct("list_id").alias("lists"), F.count("*").alias("rows"))
    assert same.where("lists != 1 OR rows != 2").count() == 0
    asked = first.where("id < 20").withColumnRenamed("id", "qid")
    exact = pairs(search.nearest(asked, two.rows.select("id", "vector"), k=4, dim=DIM))
    assert pairs(tree_index.nearest_by_tree(asked, two, k=4, nprobe=999, beam=99)) == exact
    with pytest.raises(ValueError, match="already"):
        tree_index.build_tree_index(first, dim=DIM, nlist=30, path=path)
    with pytest.raises(ValueError, match="rows"):
        tree_index.build_tree_index(first.limit(0), dim=DIM, nlist=30)
