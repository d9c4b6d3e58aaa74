"""Index appends that stop half-way, are repeated, meet each other or are compacted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import index, search
from docloom.sources import commits

DIM = 4


def rows(spark, low, high):
    cells = [F.round(F.sin(F.col("id") * k), 4).cast("float") for k in range(1, DIM + 1)]
    return spark.range(low, high).select("id", F.array(*cells).alias("vector"))


def hits_of(spark, built, n):
    asked = rows(spark, 0, 5).withColumnRenamed("id", "qid")
    return search.nearest_by_lists(asked, built, k=n, nprobe=len(built.centroids))


class Stopped(Exception):
    pass


@pytest.fixture
def path(spark, tmp_path):
    path = str(tmp_path / "index")
    index.build_index(rows(spark, 0, 250), dim=DIM, nlist=4, path=path)
    return path


@pytest.mark.parametrize("where", ["commit", "read_or_none"])
def test_interrupted_and_repeated_append(spark, path, monkeypatch, where):
    """Stopped after its rows were written (and before or after its list summary)."""

    def stop(*args, **kwargs):
        raise Stopped

    with monkeypatch.context() as patch:
        if where == "commit":
            patch.setattr(commits, "commit", stop)
        else:
            patch.setattr(index.commits, "read_or_none", lambda spark, *paths, **k: stop() if "schema" in k and "commits" not in paths[0] else real(spark, *paths, **k))
        with pytest.raises(Stopped):
            index.append_to_index(rows(spark, 250, 500), path, "night")
    half = index.open_index(spark, path)
    assert half.rows.count() == 250 == half.sizes.agg(F.sum("n_rows")).head()[0]
    for _ in range(2):  # the second one finds its commit
        done = index.append_to_index(rows(spark, 250, 500), path, "night")
        assert done.rows.count() == 500 == done.sizes.agg(F.sum("n_rows")).head()[0]
    hits = hits_of(spark, done, 500)
    assert hits.count() == 2500 == hits.select("qid", "id").distinct().count()
    pruned = search.nearest_pruned(rows(spark, 0, 9).withColumnRenamed("id", "qid"), done.rows, k=3, dim=DIM, index=done, nprobe=1)
    exact = search.nearest(rows(spark, 0, 9).withColumnRenamed("id", "qid"), rows(spark, 0, 500), k=3, dim=DIM)
    assert sorted(tuple(r) for r in pruned.select("qid", "id", "rank").collect()) == sorted(tuple(r) for r in exact.select("qid", "id", "rank").collect())


real = commits.read_or_none


def test_two_attempts_at_one_append_count_once(spark, path):
    """Both were under way before either had committed."""
    before = index.open_index(spark, path)
    for _ in range(2):
        index._add(index.assign_lists(rows(spark, 250, 300), before.centroids, DIM), path, "twice", before.version)
    assert index.open_index(spark, path).rows.count() == 300


def test_readers_keep_their_version(spark, path):
    held = index.open_index(spark, path)
    index.append_to_index(rows(spark, 250, 260), path)
    index.append_to_index(rows(spark, 260, 270), path)
    compact = index.compact_index(spark, path)
    assert (held.rows.count(), held.sizes.agg(F.sum("n_rows")).head()[0]) == (250, 250)
    assert len(compact.version.parts) == 1 and compact.rows.count() == 270
    counted = {r.list_id: r["count"] for r in compact.rows.groupBy("list_id").count().collect()}
    assert {r.list_id: r.n_rows for r in index.index_size(compact).collect()} == {k: counted.get(k, 0) for k in range(4)}
    again = index.open_index(spark, path, held.version)
    assert again.rows.count() == 250
    assert np.allclose(again.radii, held.radii)


def test_an_append_during_a_compaction_stays(spark, path):
    index.append_to_index(rows(spark, 250, 260), path)
    old = index.open_index(spark, path)
    index.append_to_index(rows(spark, 260, 270), path)
    for _ in range(2):  # two compactions of the same parts; the second has no effect
        index._add(old.rows, path, commits.new_part("compact"), old.version, replaces=old.version.parts)
    now = index.open_index(spark, path)
    assert now.rows.count() == 270 == now.rows.select("id").distinct().count()
    assert len(now.version.parts) == 2


def test_interrupted_build_may_be_repeated(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "new")
    with monkeypatch.context() as patch:
        patch.setattr(commits, "commit", lambda *a, **k: (_ for _ in ()).throw(Stopped()))
        with pytest.raises(Stopped):
            index.build_index(rows(spark, 0, 50), dim=DIM, nlist=3, path=path)
    with pytest.raises(ValueError, match="no index"):
        index.open_index(spark, path)
    built = index.build_index(rows(spark, 0, 50), dim=DIM, nlist=2, path=path)
    assert len(built.centroids) == 2 and index.open_index(spark, path).rows.count() == 50
    with pytest.raises(ValueError, match="already"):
        index.build_index(rows(spark, 0, 50), dim=DIM, nlist=2, path=path)


def test_empty_append(spark, path):
    more = index.append_to_index(rows(spark, 0, 0), path, "nothing")
    assert more.rows.count() == 250 and "nothing" in more.version.commit_ids
    assert index.append_to_index(rows(spark, 250, 251), path).rows.count() == 251


def test_lists_are_pruned_in_every_part(spark, path):
    more = index.append_to_index(rows(spark, 250, 300), path)
    plan = hits_of(spark, more, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list_id" in plan
