"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from docloom import catalog
from docloom.operators import index, models, search
from docloom.session import materialise, read_table, spread, work_path

catalog.load()
BATCH = sorted(name for name in catalog.QUERIES if not name.startswith("stream_"))


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_joins_and_no_repeated_model_calls(spark, directory, name):
    plan = plan_of(catalog.QUERIES[name](spark, directory))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert len(re.findall("ArrowEvalPython", plan)) <= 1


@pytest.mark.parametrize(
    "name,columns",
    [
        ("knn_exact", {"vec_id", "embedding"}),
        ("latest_status", {"event_id", "ts", "user_id", "event_type"}),
        ("chunk_pages", {"page_id", "html"}),
        ("document_count", set()),
        ("error_report", {"ts", "event_type"}),
    ],
)
def test_scans_read_needed_columns_only(spark, directory, name, columns):
    plan = plan_of(catalog.QUERIES[name](spark, directory))
    read = {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)", plan) for c in s.split(",") if c}
    assert read == columns


def test_texts_are_read_from_the_lists_of_hits_only(spark, directory):
    rows = read_table(spark, directory, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit("f").alias("filename"), F.lit("t").alias("text")
    )
    built = index.build_index(rows, dim=64, nlist=8)
    questions = rows.select(F.col("id").alias("qid"), "vector")
    hits = search.nearest_by_lists(questions, built, nprobe=2)
    assert "PartitionFilters: [list_id" in plan_of(hits)
    hydrated = search.hydrate(hits, built.rows.select("id", "list_id", "filename", "text"))
    assert "dynamicpruning" in plan_of(hydrated)


def test_spread_leaves_large_tables_alone(spark, directory, monkeypatch):
    small = read_table(spark, directory, "documents")
    assert "REPARTITION" in plan_of(spread(small, "doc_id"))
    many = small.repartition(50, "doc_id").select("doc_id", "text")
    path = work_path(spark, "many")
    many.write.parquet(path)
    table = spark.read.parquet(path)
    assert table.rdd.getNumPartitions() < 50  # small files are read together
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 1)
    assert "REPARTITION" not in plan_of(spread(table, "doc_id"))


def test_materialised_tables_are_cut_from_their_lineage(spark):
    table = models.embed(spark.range(3).select(F.lit("a").alias("text")), models.hashed_tokens(2), dim=2)
    assert "ArrowEvalPython" not in plan_of(materialise(table, "cut"))
