"""Queries over text: cleaning, chunking, names, cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import fixed_values as fv
from docloom.catalog import query
from docloom.functions import chat, files
from docloom.functions import text as tx
from docloom.operators.reports import index_stats
from docloom.plans.corpus_index import append_chunks, clean_chunk_table, explode_chunks, html_chunks
from docloom.session import read_table, spread, work_path

WS = fv.WHITESPACE
WS_LIST = (
    "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(32)||chr(133)||chr(160)"
    "||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)"
    "||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
)
STRIPPED = f"trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '{WS}+', ' ', 'g'))"


def chunk_sql(table: str, key: str, text: str, size: int = 800, step: int = 680, minimum: int = 60) -> str:
    """CTE ``chunks(key, idx, chunk)`` over ``table``."""
    return f"""
    cleaned AS (SELECT {key}, {text} AS t FROM {table}),
    starts AS (SELECT {key}, t, unnest(range(0, length(t), {step})) AS i FROM cleaned WHERE t <> ''),
    cut AS (SELECT {key}, i, trim(substring(t, (i + 1)::INT, {size}), {WS_LIST}) AS chunk FROM starts),
    chunks AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS idx, chunk
               FROM cut WHERE length(chunk) >= {minimum})"""


def pages(spark: SparkSession, directory: str) -> DataFrame:
    return spread(read_table(spark, directory, "pages"), "page_id")


def documents(spark: SparkSession, directory: str) -> DataFrame:
    return spread(read_table(spark, directory, "documents"), "doc_id")


def named_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Pages with file names of four kinds."""
    kinds = F.array(*[F.lit(kind) for kind in (".PDF", ".html", ".docx", ".tar.png")])
    return read_table(spark, directory, "pages").select(
        "page_id",
        F.concat(
            F.lit("page-"), F.col("page_id").cast("string"), F.element_at(kinds, (F.col("page_id") % 4 + 1).cast("int"))
        ).alias("filename"),
        "html",
    )


PAGE_NAME = (
    "'page-' || page_id || CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.html' WHEN 2 THEN '.docx' ELSE '.tar.png' END"
)


@query(f"SELECT page_id, {STRIPPED} AS text FROM pages")
def strip_html(spark: SparkSession, directory: str) -> DataFrame:
    return pages(spark, directory).select("page_id", tx.strip_html(F.col("html")).alias("text"))


# The table holds no control characters, so each text gets some at both ends and in
# place of its line breaks.
_DIRTY_SQL = "chr(7) || replace(text, chr(10), chr(133) || chr(28) || chr(9) || chr(160)) || chr(127) || chr(8199)"


@query(
    rf"""SELECT doc_id, trim(regexp_replace(regexp_replace({_DIRTY_SQL},
      '[\x{{01}}-\x{{08}}\x{{0b}}\x{{0c}}\x{{0e}}-\x{{1f}}\x{{7f}}-\x{{9f}}]', '', 'g'), '{WS}+', ' ', 'g')) AS text
      FROM documents"""
)
def clean_text(spark: SparkSession, directory: str) -> DataFrame:
    dirty = F.concat(
        F.lit("\x07"), F.replace("text", F.lit("\n"), F.lit("\x85\x1c\t\xa0")), F.lit("\x7f ")
    )
    return documents(spark, directory).select("doc_id", tx.clean_text(dirty).alias("text"))


@query(
    f"WITH {chunk_sql('pages', 'page_id', STRIPPED)} SELECT page_id AS doc_id, idx AS chunk_idx, "
    "'pages:' || page_id || '#chunk-' || idx AS filename, chunk AS text FROM chunks"
)
def chunk_pages(spark: SparkSession, directory: str) -> DataFrame:
    return explode_chunks(pages(spark, directory), "page_id", "pages", html_chunks(F.col("html"))).drop("id")


@query(f"WITH {chunk_sql('documents', 'doc_id', 'text')} SELECT doc_id, idx AS chunk_idx, chunk AS text FROM chunks")
def chunk_documents(spark: SparkSession, directory: str) -> DataFrame:
    chunks = F.posexplode(tx.chunk_text(F.col("text"))).alias("chunk_idx", "chunk")
    return documents(spark, directory).select("doc_id", chunks).select(
        "doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.col("chunk").alias("text")
    )


@query(
    """WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 462)) AS i FROM documents)
    SELECT doc_id, i // 462 AS chunk_idx, substring(text, (i + 1)::INT, 512) AS text FROM s"""
)
def chunk_plain(spark: SparkSession, directory: str) -> DataFrame:
    chunks = F.posexplode(tx.chunk_plain(F.col("text"))).alias("chunk_idx", "chunk")
    return documents(spark, directory).select("doc_id", chunks).select(
        "doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.col("chunk").alias("text")
    )


@query(
    f"WITH {chunk_sql('pages', 'page_id', STRIPPED)} "
    f"SELECT page_id::VARCHAR AS doc_id, trim(regexp_replace(chunk, '{WS}+', ' ', 'g')) AS chunk FROM chunks"
)
def chunk_table(spark: SparkSession, directory: str) -> DataFrame:
    path = work_path(spark, "chunks")
    append_chunks(clean_chunk_table(chunk_pages(spark, directory)), path)
    return spark.read.parquet(path)


@query(
    f"WITH {chunk_sql('pages', 'page_id', STRIPPED)} SELECT count(DISTINCT page_id) AS n_documents, "
    "count(*) AS n_chunks, round(avg(length(chunk)), 6) AS mean_chars FROM chunks"
)
def index_statistics(spark: SparkSession, directory: str) -> DataFrame:
    stats = index_stats(pages(spark, directory), html_chunks(F.col("html")))
    return stats.withColumn("mean_chars", F.round("mean_chars", 6))


@query(f"SELECT doc_id, trim(replace(text, chr(10), ' '), {WS_LIST}) AS text FROM documents")
def join_tokens(spark: SparkSession, directory: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    return read_table(spark, directory, "documents").select("doc_id", tx.join_tokens(lines).alias("text"))


@query("SELECT doc_id, replace(text, ' ', chr(10)) AS text FROM documents")
def join_elements(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "documents").select(
        "doc_id", tx.join_elements(F.split("text", " ")).alias("text")
    )


@query("SELECT page_id, lower(regexp_extract(url, '[^.]*$')) AS extension FROM pages")
def file_extension(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "pages").select("page_id", files.file_extension(F.col("url")).alias("extension"))


@query(
    f"""SELECT page_id, filename, CASE WHEN lower(split_part(filename, '.', -1)) IN ('png', 'jpg', 'jpeg', 'pdf')
    THEN 'ocr' ELSE 'text' END AS route FROM (SELECT page_id, {PAGE_NAME} AS filename FROM pages)"""
)
def route_extractor(spark: SparkSession, directory: str) -> DataFrame:
    return named_pages(spark, directory).select(
        "page_id", "filename", files.extractor_route(F.col("filename")).alias("route")
    )


@query(
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '/other/' || split_part(url, '://', 2)
    ELSE split_part(url, '://', 2) END AS filename FROM pages"""
)
def relative_path(spark: SparkSession, directory: str) -> DataFrame:
    below = F.substring_index("url", "://", -1)
    root = F.when(F.col("page_id") % 5 == 0, "/other/").otherwise("/data/raw.d/")
    path = F.concat(root, below)
    return read_table(spark, directory, "pages").select(
        "page_id", files.relative_path(path, "/data/raw.d").alias("filename")
    )


@query(
    """SELECT doc_id, substring(text, 1, 255) AS filename, substring(text || text || text, 1, 65535) AS text
    FROM documents"""
)
def truncate_fields(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "documents").select(
        "doc_id",
        tx.truncate(F.col("text"), fv.FILENAME_LIMIT).alias("filename"),
        tx.truncate(F.concat("text", "text", "text"), fv.TEXT_LIMIT).alias("text"),
    )


@query("SELECT doc_id, substring(text, 1, 300) AS preview, substring(text, 1, 3000) AS used_context FROM documents")
def hit_preview(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "documents").select(
        "doc_id", tx.preview(F.col("text")).alias("preview"), tx.used_context(F.col("text")).alias("used_context")
    )


COUNT_WORDS = ("tionou", "heth")
STATUS_WORDS = ("ation",)


@query(
    """SELECT conv_id, turn, CASE WHEN contains(lower(text), 'tionou') OR contains(lower(text), 'heth') THEN 'count'
    WHEN contains(lower(text), 'ation') THEN 'status' ELSE 'retrieve' END AS intent
    FROM conversations WHERE role = 'user'"""
)
def route_intent(spark: SparkSession, directory: str) -> DataFrame:
    """The tables hold invented prose, so the keywords are syllables of it."""
    asked = read_table(spark, directory, "conversations").where(F.col("role") == "user")
    return asked.select("conv_id", "turn", chat.intent(F.col("text"), COUNT_WORDS, STATUS_WORDS).alias("intent"))
