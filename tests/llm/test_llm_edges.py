"""NULLs, empty and very long texts, repeated rows, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import backoff, contamination, neardup, quality, queries, repetition, sequences, sharding, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, bucket int, block int, size string, _hit int, _hit_ int"
LONG = "very long words " * 40_000 + "x" * 300_000
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", "s", 4),
    (4, LONG, "en", "s", len(LONG)),
    (5, "the same text " * 9, "en", "s", 1),
    (5, "the same text " * 9, "en", "s", 1),
    (6, "the same text " * 9, "de", "t", 1),
    (None, "no id but words of its own", "en", None, 26),
    (None, None, None, None, None),
    (7, "é\u0000ü 漢字 " + "\U0001f600 " * 30, "xx", "s", 70),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*r, "mine", "mine", 1, 2, "mine", 3, 4) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "the same text the same text the same text the same text"), (2, None)], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 0, 0), (4, 1, 0), (5, 1, 0), (None, 1, 0), (6, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


def operators(benchmark, labels):
    return {
        "substrings": substrings.remove_repeats,
        "repetition": repetition.judge,
        "contamination": lambda d: contamination.find_contamination(d, benchmark),
        "backoff": backoff.score_documents,
        "quality": lambda d: quality.score_quality(d, labels, F.lit(True)),
        "sharding": lambda d: sharding.shard_documents(d, shards=4),
        "neardup": lambda d: neardup.near_duplicates(d),
        "packing": lambda d: sequences.pack_sequences(d, queries.vocabulary),
    }


NAMES = sorted(operators(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_edge_rows(edges, benchmark, labels, name):
    out = operators(benchmark, labels)[name](edges)
    rows = out.collect()
    if name == "packing":
        assert sorted(sum(r.length for r in rows if r.doc_id == k) for k in (1, 2, 3)) == [1, 1, 1]
    else:
        assert len(rows) == len(ROWS)
    assert len({c.lower() for c in out.columns}) == len(out.columns)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(edges, benchmark, labels, name):
    assert operators(benchmark, labels)[name](edges.limit(0)).collect() == []


def test_results_on_edge_rows(edges, benchmark):
    cut = {r.doc_id: r for r in substrings.remove_repeats(edges).collect() if r.doc_id}
    assert cut[1].text is None and (cut[5].n_words, cut[5].n_removed, cut[6].n_removed, cut[6].text) == (27, 0, 27, " ")
    classes = {(r.doc_id, r.class_id) for r in neardup.near_duplicates(edges).collect()}
    assert {(1, 1), (2, 1), (3, 3), (5, 5), (6, 5)} <= classes
    hits = {r.doc_id: r for r in contamination.find_contamination(edges, benchmark).collect()}
    assert hits[5].contaminated and not hits[1].contaminated and not hits[4].contaminated


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_edge_rows(spark, directory, edges, stage):
    docs = edges.select("doc_id", "text", "lang", "source", "n_chars", "n_words", "score", F.lit("mine").alias("kept"), F.lit(5).alias("_hit"), F.lit(6).alias("given_0"))
    for table in (docs, docs.limit(0)):
        out = corpus_pipeline.STAGES[stage][1](spark, table, directory)
        out.collect()
        if stage < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert {(r.n_words, r.score, r.kept, r._hit, r.given_0) for r in out.collect()} <= {("mine", "mine", "mine", 5, 6)}
