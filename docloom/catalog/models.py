"""Queries that run caller-supplied models, here plain stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import fixed_values as fv
from docloom.catalog import query
from docloom.catalog.retrieval import DIM, knn_sql, texts_sql
from docloom.catalog.text import PAGE_NAME, STRIPPED, WS_LIST, chunk_sql, chunk_documents, named_pages
from docloom.operators import models, search
from docloom.plans.corpus_index import index_corpus, index_extracted
from docloom.session import read_table, spread, work_path
from docloom.sources.corpus import read_corpus


def extracted_sql(name: str, text: str) -> str:
    ocr = f"lower(split_part({name}, '.', -1)) IN ('png', 'jpg', 'jpeg', 'pdf')"
    return f"trim(CASE WHEN {ocr} THEN replace({text}, chr(10), ' ') ELSE {text} END, {WS_LIST})"


@query(
    f"""SELECT filename, {extracted_sql('filename', 'html')} AS extracted_text, NULL::VARCHAR AS error
    FROM (SELECT {PAGE_NAME} AS filename, html FROM pages)
    UNION ALL SELECT 'lost-' || {PAGE_NAME}, 'ERROR: no content', 'no content' FROM pages WHERE page_id % 10 = 0"""
)
def extract_text(spark: SparkSession, directory: str) -> DataFrame:
    """Pages as file bytes, and some files without any, to show the error channel."""
    bucket = F.lit(fv.DEFAULT_BUCKET).alias("bucket")
    named = named_pages(spark, directory)
    lost = named.where(F.col("page_id") % 10 == 0)
    files = named.select("filename", bucket, F.encode("html", "UTF-8").alias("content")).unionByName(
        lost.select(F.concat(F.lit("lost-"), "filename").alias("filename"), bucket, F.lit(None).cast("binary").alias("content"))
    )
    return models.extract_text(files, lambda: models.PLAIN_EXTRACTORS).drop("bucket")


_CHUNKS = chunk_sql("documents", "doc_id", "text")
_WEIGHTS = """
    words AS (SELECT doc_id, idx, unnest(string_split(lower(chunk), ' ')) AS w FROM chunks),
    counts AS (SELECT doc_id, idx, ('0x' || substr(md5(w), 1, 4))::BIGINT % 64 AS slot, count(*) AS c
               FROM words WHERE w <> '' GROUP BY ALL),
    norms AS (SELECT doc_id, idx, sqrt(sum(c * c)) AS norm FROM counts GROUP BY ALL),
    weights AS (SELECT doc_id, idx, slot, (c / norm)::FLOAT::DOUBLE AS x FROM counts JOIN norms USING (doc_id, idx))"""


@query(f"WITH {_CHUNKS}, {_WEIGHTS} SELECT doc_id, idx AS chunk_idx, slot, round(x, 6) AS weight FROM weights")
def embed_chunks(spark: SparkSession, directory: str) -> DataFrame:
    embedded = models.embed(chunk_documents(spark, directory), models.hashed_tokens(DIM), dim=DIM)
    slots = embedded.select("doc_id", "chunk_idx", F.posexplode("vector").alias("slot", "x")).where(F.col("x") != 0)
    return slots.select(
        "doc_id",
        "chunk_idx",
        F.col("slot").cast("bigint").alias("slot"),
        F.round(F.col("x").cast("double"), 6).alias("weight"),
    )


_ASK = f"""WITH {_CHUNKS},
    named AS (SELECT 'documents:' || doc_id || '#chunk-' || idx AS id, chunk AS text FROM chunks),
    {texts_sql('rows', 'named', 'id')}, {texts_sql('asked', 'benchmark', 'item_id')}
    SELECT qid, id AS filename, round(d, 6) AS score, rk AS rank FROM (
    {knn_sql('SELECT item_id AS qid, id, asked.v AS a, rows.v AS b FROM asked, rows')})"""


@query(_ASK)
def ask_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """From documents to ranked hits: cut, embed and search, for every benchmark text."""
    chunks = chunk_documents(spark, directory).select(
        F.concat(
            F.lit("documents:"), F.col("doc_id").cast("string"), F.lit("#chunk-"), F.col("chunk_idx").cast("string")
        ).alias("id"),
        "text",
    )
    asked = read_table(spark, directory, "benchmark").select(F.col("item_id").alias("qid"), "text")
    embedded = [models.embed(part, models.hashed_tokens(DIM), dim=DIM) for part in (asked, chunks)]
    hits = search.nearest(embedded[0], embedded[1], dim=DIM)
    return hits.select("qid", F.col("id").alias("filename"), F.round("l2_sq", 6).alias("score"), "rank")


@query(
    f"WITH {chunk_sql('pages', 'page_id', STRIPPED)} SELECT page_id::VARCHAR AS doc_id, "
    "'pages:' || page_id || '#chunk-' || idx AS filename, chunk AS text FROM chunks"
)
def corpus_index(spark: SparkSession, directory: str) -> DataFrame:
    """The whole job, read back from the index it wrote."""
    pages = read_corpus(spark, [f"{directory}/pages.parquet"], {"id": "page_id", "content_html": "html"})
    built = index_corpus(
        spread(pages, "id"), models.hashed_tokens(DIM), work_path(spark, "corpus"), dim=DIM, source="pages", nlist=16
    )
    return built.rows.select("doc_id", "filename", "text")


_ASK_PAGES = f"""WITH {chunk_sql('pages', 'page_id', STRIPPED)},
    named AS (SELECT 'pages:' || page_id || '#chunk-' || idx AS id, chunk AS text FROM chunks),
    {texts_sql('rows', 'named', 'id')}, {texts_sql('asked', 'benchmark', 'item_id')}
    SELECT qid, rk AS rank, id AS filename, round(d, 6) AS score, text FROM (
    {knn_sql('SELECT item_id AS qid, id, asked.v AS a, rows.v AS b FROM asked, rows')}) JOIN named USING (id)"""


@query(_ASK_PAGES)
def ask_index(spark: SparkSession, directory: str) -> DataFrame:
    """From HTML pages to an index and from questions to their texts. All lists are
    probed, so the answer is exact."""
    corpus = read_corpus(spark, [f"{directory}/pages.parquet"], {"id": "page_id", "content_html": "html"})
    model = models.hashed_tokens(DIM)
    built = index_corpus(spread(corpus, "id"), model, work_path(spark, "asked"), dim=DIM, source="pages", nlist=16)
    asked = read_table(spark, directory, "benchmark").select(F.col("item_id").alias("qid"), "text")
    hits = search.nearest_by_lists(models.embed(asked, model, dim=DIM), built, nprobe=16)
    texts = built.rows.select("id", "list_id", "filename", "text")
    return search.hydrate(hits, texts).select("qid", "rank", "filename", F.round("l2_sq", 6).alias("score"), "text")


_EXTRACTED = f"""extracted AS (SELECT filename, trim(regexp_replace(regexp_replace({extracted_sql('filename', 'html')},
    '[\\x{{01}}-\\x{{08}}\\x{{0b}}\\x{{0c}}\\x{{0e}}-\\x{{1f}}\\x{{7f}}-\\x{{9f}}]', '', 'g'), '{fv.WHITESPACE}+', ' ', 'g')) AS text
    FROM (SELECT {PAGE_NAME} AS filename, html FROM pages))"""


@query(
    f"WITH {_EXTRACTED}, {chunk_sql('extracted', 'filename', 'text')} SELECT filename AS doc_id, "
    "'files:' || filename || '#chunk-' || idx AS filename, chunk AS text FROM chunks"
)
def index_extracted_text(spark: SparkSession, directory: str) -> DataFrame:
    """Files to extracted text to index, read back from the index."""
    built = index_extracted(
        extract_text(spark, directory),
        models.hashed_tokens(DIM),
        work_path(spark, "files"),
        source="files",
        dim=DIM,
        nlist=16,
    )
    return built.rows.select("doc_id", "filename", "text")


@query(
    """SELECT item_id AS qid, provider, CASE
      WHEN provider = 'google' AND item_id % 2 = 0 THEN '[Error] Gemini API Key is missing. Please provide it in settings.'
      WHEN provider = 'broken' THEN '[Error] broken LLM inference failed: out of order'
      ELSE 'words: ' || len(string_split(text, ' ')) END AS answer
    FROM (SELECT *, CASE item_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'google' ELSE 'broken' END AS provider FROM benchmark)"""
)
def generate_answers(spark: SparkSession, directory: str) -> DataFrame:
    """A stand-in model that counts words, and one that always fails."""

    def count_words(texts: list[str]) -> list[str]:
        return [f"words: {len(text.split(' '))}" for text in texts]

    def fail(texts: list[str]) -> list[str]:
        raise RuntimeError("out of order")

    providers = F.array(F.lit("local"), F.lit("google"), F.lit("broken"))
    prompts = read_table(spark, directory, "benchmark").select(
        F.col("item_id").alias("qid"),
        F.col("text").alias("prompt"),
        F.element_at(providers, (F.col("item_id") % 3 + 1).cast("int")).alias("provider"),
        (F.col("item_id") % 2 == 1).alias("has_key"),
    )
    answered = models.generate(prompts, {"local": count_words, "google": count_words, "broken": fail})
    return answered.select("qid", "provider", "answer")
