"""Text functions against plain Python written for these tests."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom import fixed_values as fv
from docloom.functions import chat, files, text

SPACES = [chr(c) for c in range(0x110000) if chr(c).isspace()]


def apply(spark, column, values, kind="string"):
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[1] for row in table.select("i", column(F.col("v")).alias("r")).orderBy("i").collect()]


def plain_strip_html(value):
    return "" if value is None else " ".join(re.sub("<[^>]+>", " ", value).split())


def plain_clean(value):
    dropped = {*range(0, 9), 11, 12, *range(14, 32), *range(127, 160)}
    return " ".join("".join(c for c in value if ord(c) not in dropped).split())


def plain_chunks(value, size, overlap, minimum):
    step = max(1, size - overlap)
    windows = [value[i : i + size].strip() for i in range(0, len(value), step)]
    return [w for w in windows if len(w) >= minimum]


def test_whitespace_is_complete():
    assert sorted(fv.WHITESPACE_CHARACTERS) == sorted(SPACES) and len(SPACES) == 29


def test_strip_html(spark):
    values = [None, "", "<>", "a<b", "<script>x</script>", "<p\nclass='a'>two</p\n>lines", "&amp;<br/>x", "  <a> </a> "]
    values += [f"a{space}{space}b<i>{space}" for space in SPACES]
    assert apply(spark, text.strip_html, values) == [plain_strip_html(v) for v in values]


def test_clean_text(spark):
    values = ["\x00a\x07b", "x\x85y", "x\x1cy", "x\xa0y", "a\t\n\r b", "\x7f\x9f", "tab\x0bfeed\x0cend", ""]
    assert apply(spark, text.clean_text, values) == [plain_clean(v) for v in values]


@pytest.mark.parametrize("size,overlap,minimum", [(800, 120, 60), (10, 3, 2), (5, 4, 1), (5, 9, 1), (7, 0, 0), (1, 0, 1)])
def test_chunks(spark, size, overlap, minimum):
    lengths = [0, 1, 2, 9, 10, 11, 59, 60, 680, 681, 739, 740, 800, 801, 1480, 3000]
    values = [("ab \U0001f600é\n cd" * 500)[:n] for n in lengths]
    values += [" " * 900 + "x" * 100, "x" * 700 + " " * 900, "\U0001f600" * 1700, "　" * 70 + "y"]
    got = apply(spark, lambda c: text.chunk_text(c, size, overlap, minimum), values)
    assert got == [plain_chunks(v, size, overlap, minimum) for v in values]


def test_plain_chunks(spark):
    values = ["", "a", "b" * 462, "b" * 463, "é" * 512, "é\n" * 700, " " * 600]
    got = apply(spark, text.chunk_plain, values)
    assert got == [[v[i : i + 512] for i in range(0, len(v), 462)] for v in values]


def test_chunk_sizes_are_checked():
    with pytest.raises(ValueError):
        text.chunk_plain(F.lit("x"), 50, 50)
    with pytest.raises(ValueError):
        text.chunk_text(F.lit("x"), 0)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.text(max_size=200).filter(lambda t: "\x00" not in t), min_size=1, max_size=20))
def test_any_text(spark, values):
    assert apply(spark, text.strip_html, values) == [plain_strip_html(v) for v in values]
    assert apply(spark, text.clean_text, values) == [plain_clean(v) for v in values]
    got = apply(spark, lambda c: text.chunk_text(c, 40, 15, 6), values)
    assert got == [plain_chunks(v, 40, 15, 6) for v in values]


def test_joins(spark):
    assert apply(spark, text.join_tokens, [[["a", "b"], [], ["c "]], [[]], []], "array<array<string>>") == ["a b c", "", ""]
    assert apply(spark, text.join_elements, [["a", "b"], []], "array<string>") == ["a\nb", ""]


def test_names(spark):
    names = ["a.TAR.Gz", "noext", ".hidden", "dir.d/file", "x.PDF", "y.jpeg", "scan.tif", None]
    assert apply(spark, files.file_extension, names) == ["gz", "noext", "hidden", "d/file", "pdf", "jpeg", "tif", None]
    assert apply(spark, files.extractor_route, names) == ["text", "text", "text", "text", "ocr", "ocr", "text", "text"]
    paths = ["/a/b.c/x.tif", "/a/b.c", "/a/bXc/x", "/z/a/b.c/x"]
    assert apply(spark, lambda c: files.relative_path(c, "/a/b.c/"), paths) == ["x.tif", *paths[1:]]


def test_truncation(spark):
    assert apply(spark, text.preview, ["é" * 301, "ab", ""]) == ["é" * 300, "ab", ""]
    assert apply(spark, text.used_context, ["\U0001f600" * 3001]) == ["\U0001f600" * 3000]
    keys = ["pages:1#chunk-0", "a#chunk-1#chunk-22", "none"]
    assert apply(spark, text.document_of_chunk, keys) == ["pages:1", "a#chunk-1", "none"]


def test_intents(spark):
    asked = ["Có BAO NHIÊU trạng thái?", "TRẠNG THÁI là gì", "thống kê", "what?", ""]
    assert apply(spark, chat.intent, asked) == ["count", "status", "count", "retrieve", "retrieve"]
    assert apply(spark, chat.is_question, ["a", " ", "　\n", "", None]) == [True, False, False, False, False]


def test_long_text_is_cut_in_linear_time(spark):
    """Two megabytes in one row; quadratic cutting would take minutes."""
    import time

    table = spark.range(1).select(F.repeat(F.lit("abc đé x "), 250_000).alias("v"))
    start = time.time()
    n = table.select(F.size(text.chunk_text(F.col("v")))).head()[0]
    assert n == len(range(0, 9 * 250_000, 680)) and time.time() - start < 30
