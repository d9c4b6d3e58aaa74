"""Queries over vectors and the answers built from them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import fixed_values as fv
from docloom.catalog import query
from docloom.catalog.tables import COUNT_SENTENCE_SQL, STATUS_SENTENCE_SQL
from docloom.catalog.text import chunk_sql, documents
from docloom.functions import vectors as vx
from docloom.functions.text import chunk_text
from docloom.operators import answers, index, models, reports, search, tree_index
from docloom.plans.corpus_index import explode_chunks
from docloom.plans.requests import answer_requests as answer_all
from docloom.session import materialise, read_table, work_path

DIM = 64


def _rows(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )


def _as_questions(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("id", "qid")


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "id", F.round("l2_sq", 6).alias("l2_sq"), "rank")


def knn_sql(pairs: str, k: int = 5) -> str:
    """``pairs`` gives qid, id, a, b (double lists)."""
    return f"""
    SELECT qid, id, d, rk FROM (
      SELECT qid, id, d, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rk FROM (
        SELECT qid, id, round(list_sum(list_transform(range(1, {DIM + 1}), lambda i: (a[i] - b[i]) * (a[i] - b[i]))), 9) AS d
        FROM ({pairs}))) WHERE rk <= {k}"""


_ALL_PAIRS = """SELECT q.vec_id AS qid, e.vec_id AS id, q.embedding::DOUBLE[] AS a, e.embedding::DOUBLE[] AS b
    FROM embeddings q, embeddings e WHERE q.vec_id <> e.vec_id"""
_KNN = f"SELECT qid, id, round(d, 6) AS l2_sq, rk AS rank FROM ({knn_sql(_ALL_PAIRS)})"


@query(
    """SELECT q.vec_id AS left_id, e.vec_id AS right_id,
    round(list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE)
      * (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE))), 6) AS l2_sq,
    round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE)
      * (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE)))), 6) AS l2
    FROM embeddings q JOIN embeddings e ON e.vec_id = q.vec_id + 1"""
)
def pair_distance(spark: SparkSession, directory: str) -> DataFrame:
    """Every vector against the one after it."""
    rows = _rows(spark, directory)
    left = rows.select(F.col("id").alias("left_id"), F.col("vector").alias("a"), (F.col("id") + 1).alias("right_id"))
    right = rows.select(F.col("id").alias("right_id"), F.col("vector").alias("b"))
    return left.join(right, "right_id").select(
        "left_id",
        "right_id",
        F.round(vx.l2_sq(F.col("a"), F.col("b")), 6).alias("l2_sq"),
        F.round(vx.l2(F.col("a"), F.col("b")), 6).alias("l2"),
    )


@query(_KNN)
def knn_exact(spark: SparkSession, directory: str) -> DataFrame:
    rows = _rows(spark, directory)
    return _rounded(search.nearest(_as_questions(rows), rows, dim=DIM, exclude_same_id=True))


@query(_KNN)
def knn_pruned(spark: SparkSession, directory: str) -> DataFrame:
    """The way taken for more questions than may be broadcast."""
    rows = _rows(spark, directory)
    return _rounded(
        search.nearest_pruned(_as_questions(rows), rows, dim=DIM, exclude_same_id=True, nlist=16, nprobe=4)
    )


@query(_KNN)
def knn_ivf(spark: SparkSession, directory: str) -> DataFrame:
    """All lists probed, which has to equal exact search."""
    rows = _rows(spark, directory)
    built = index.build_index(rows, dim=DIM, nlist=16)
    return _rounded(search.nearest_by_lists(_as_questions(rows), built, nprobe=16, exclude_same_id=True))


@query(_KNN)
def knn_tree(spark: SparkSession, directory: str) -> DataFrame:
    """An index of two levels, half of it appended; with the widest beam it has to equal exact search."""
    rows, path = _rows(spark, directory), work_path(spark, "tree")
    tree_index.build_tree_index(rows.where("id % 2 = 0"), dim=DIM, nlist=25, path=path)
    built = tree_index.append_to_tree_index(rows.where("id % 2 = 1"), path, "odd")
    return _rounded(tree_index.nearest_by_tree(_as_questions(rows), built, nprobe=25, beam=5, exclude_same_id=True))


# Ten lists around the mean vectors of the ten labels, so that SQL can place every row.
def _label_means(rows: DataFrame) -> np.ndarray:
    means = rows.select("label", F.posexplode("vector")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("x"))
    table = means.orderBy("label", "pos").toArrow()
    return table["x"].to_numpy().reshape(-1, DIM)


_LISTS = f"""means AS (SELECT row_number() OVER (ORDER BY label) - 1 AS list_id, list(x ORDER BY pos) AS c FROM (
      SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(range({DIM})) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings)
      GROUP BY ALL) GROUP BY label),
    placed AS (SELECT vec_id, list_id, row_number() OVER (PARTITION BY vec_id ORDER BY
      round(list_sum(list_transform(range(1, {DIM + 1}), lambda i: (embedding[i]::DOUBLE - c[i]) * (embedding[i]::DOUBLE - c[i]))), 9), list_id) AS place
      FROM embeddings, means)"""
_PROBED = """SELECT q.vec_id AS qid, e.vec_id AS id, q.embedding::DOUBLE[] AS a, e.embedding::DOUBLE[] AS b
    FROM embeddings q JOIN placed p ON p.vec_id = q.vec_id AND p.place <= 3 JOIN placed h ON h.list_id = p.list_id AND h.place = 1
    JOIN embeddings e ON e.vec_id = h.vec_id WHERE q.vec_id <> e.vec_id"""


@query(f"WITH {_LISTS} SELECT qid, id, round(d, 6) AS l2_sq, rk AS rank FROM ({knn_sql(_PROBED)})")
def knn_ivf_probe(spark: SparkSession, directory: str) -> DataFrame:
    """The approximate setting: the 3 nearest of 10 lists, around given centroids."""
    rows = _rows(spark, directory)
    built = index.build_index(rows, dim=DIM, centroids=_label_means(rows), written=True)
    return _rounded(search.nearest_by_lists(_as_questions(rows), built, nprobe=3, exclude_same_id=True))


@query(f"WITH {_LISTS} SELECT list_id::INT AS list_id, count(vec_id) AS n_rows FROM means LEFT JOIN placed USING (list_id) WHERE place = 1 OR place IS NULL GROUP BY list_id")
def ivf_lists(spark: SparkSession, directory: str) -> DataFrame:
    rows = _rows(spark, directory)
    return index.index_size(index.build_index(rows, dim=DIM, centroids=_label_means(rows), written=True))


@query(
    f"""SELECT vec_id AS id, label, unnest(range({DIM}))::INT AS slot, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings"""
)
def write_index(spark: SparkSession, directory: str) -> DataFrame:
    """Built on a part of the rows; the rest is appended under an id, offered once more
    and compacted, which leaves every row once."""
    rows, path = _rows(spark, directory), work_path(spark, "index")
    index.build_index(rows.where("id % 3 = 0"), dim=DIM, nlist=16, path=path)
    for part in ("id % 3 = 1", "id % 3 = 2", "id % 3 = 1"):
        index.append_to_index(rows.where(part), path, append_id=part)
    built = index.compact_index(spark, path)
    slots = built.rows.select("id", "label", F.posexplode("vector").alias("slot", "x"))
    return slots.withColumn("x", F.round(F.col("x").cast("double"), 6))


@query(
    "SELECT qid, id, round(d, 6) AS l2_sq, rk AS rank FROM ("
    + knn_sql(_ALL_PAIRS + " AND q.label = e.label")
    + ")"
)
def knn_filtered(spark: SparkSession, directory: str) -> DataFrame:
    """Every question is restricted to rows with its own label."""
    rows = _rows(spark, directory)
    return _rounded(search.nearest_within(_as_questions(rows), rows, "label", dim=DIM, exclude_same_id=True))


# Questions are the benchmark texts, rows are the chunks of all documents; both are
# embedded by the stand-in model.
def _questions(spark: SparkSession, directory: str) -> DataFrame:
    asked = read_table(spark, directory, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("question")
    )
    return models.embed(asked, models.hashed_tokens(DIM), text="question", dim=DIM)


def _moody(texts: list[str]) -> None:
    """A model that fails for some questions, and with them for their batch."""
    if any(len(text) % 13 == 5 for text in texts):
        raise ValueError("no vector")


def _moody_model() -> Callable[[list[str]], np.ndarray]:
    model = models.hashed_tokens(DIM)()

    def encode(texts: list[str]) -> np.ndarray:
        _moody(texts)
        return model(texts)

    return encode


def _chunks(spark: SparkSession, directory: str) -> DataFrame:
    return explode_chunks(documents(spark, directory), "doc_id", "documents", chunk_text(F.col("text")))


def _hits(spark: SparkSession, directory: str, questions: DataFrame) -> DataFrame:
    chunks = _chunks(spark, directory)
    rows = models.embed(chunks.select("id", "text"), models.hashed_tokens(DIM), dim=DIM)
    return search.hydrate(search.nearest(questions, rows, dim=DIM), chunks)


def texts_sql(name: str, source: str, key: str) -> str:
    """CTEs giving ``{name}(key, v)``: dense vectors of the texts of ``source``."""
    return f"""
    {name}_words AS (SELECT {key}, unnest(string_split(lower(text), ' ')) AS w FROM {source}),
    {name}_counts AS (SELECT {key}, ('0x' || substr(md5(w), 1, 4))::BIGINT % 64 AS slot, count(*) AS c
      FROM {name}_words WHERE w <> '' GROUP BY ALL),
    {name}_norms AS (SELECT {key}, sqrt(sum(c * c)) AS norm, map(list(slot), list(c)) AS m FROM {name}_counts GROUP BY ALL),
    {name} AS (SELECT {key}, list_transform(range(0, 64), lambda s: (coalesce(m[s], 0) / norm)::FLOAT::DOUBLE) AS v
      FROM {name}_norms)"""


_SEARCHED = f"""{chunk_sql('documents', 'doc_id', 'text')},
    named AS (SELECT 'documents:' || doc_id || '#chunk-' || idx AS id, 'documents:' || doc_id AS source, doc_id, chunk AS text FROM chunks),
    {texts_sql('vectors', 'named', 'id')}, {texts_sql('asked', 'benchmark', 'item_id')}"""
_HITS = f"""{_SEARCHED}, hits AS (
    SELECT qid, id, d, rk, id AS filename, source, text FROM (
      {knn_sql('SELECT item_id AS qid, id, asked.v AS a, vectors.v AS b FROM asked, vectors')}) JOIN named USING (id))"""
_QUESTIONS = "questions AS (SELECT item_id AS qid, text AS question FROM benchmark)"
_CONTEXT = f"""{_HITS}, context AS (
    SELECT qid, string_agg('[Source: ' || filename || ' | score=' || printf('%.4f', d) || ']' || chr(10) || text,
      chr(10) || chr(10) ORDER BY rk) AS context, count(*) AS n_sources FROM hits GROUP BY qid)"""


@query(f"WITH {_HITS} SELECT qid, rk AS rank, id, filename, round(d, 6) AS score, text FROM hits")
def hydrate_hits(spark: SparkSession, directory: str) -> DataFrame:
    hits = _hits(spark, directory, _questions(spark, directory))
    return hits.select("qid", "rank", "id", "filename", F.round("l2_sq", 6).alias("score"), "text")


@query(f"WITH {_CONTEXT} SELECT qid, context, n_sources FROM context")
def build_context(spark: SparkSession, directory: str) -> DataFrame:
    context = answers.build_context(_hits(spark, directory, _questions(spark, directory)))
    return context.select("qid", "context", "n_sources")


@query(
    f"""WITH {_HITS} SELECT qid, string_agg(chr(10) || '[Source: ' || filename || ']' || chr(10) || text || chr(10), ''
    ORDER BY rk) AS context FROM hits GROUP BY qid"""
)
def build_plain_context(spark: SparkSession, directory: str) -> DataFrame:
    hits = _hits(spark, directory, _questions(spark, directory))
    return answers.build_context(hits, with_score=False).select("qid", "context")


@query(
    f"""WITH {_HITS} SELECT qid, rk AS rank, filename, round(d, 6) AS score, substring(text, 1, 300) AS preview FROM hits"""
)
def answer_sources(spark: SparkSession, directory: str) -> DataFrame:
    hits = _hits(spark, directory, _questions(spark, directory))
    sources = answers.build_context(hits).select("qid", F.inline("sources"))
    return sources.select("qid", "filename", F.round("score", 6).alias("score"), "preview").join(
        hits.select("qid", "rank", "filename"), ["qid", "filename"]
    )


@query(
    f"""WITH {_HITS}, best AS (SELECT qid, source, min(rk) AS r FROM hits GROUP BY ALL)
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY r) AS id, source FROM best"""
)
def citations(spark: SparkSession, directory: str) -> DataFrame:
    return answers.citations(_hits(spark, directory, _questions(spark, directory))).drop("page")


_REPLY = f"""{_CONTEXT}, {_QUESTIONS}, reply AS (
    SELECT qid, question,
      CASE WHEN context IS NULL THEN 'Không tìm thấy ngữ cảnh phù hợp từ Milvus cho câu hỏi này.'
      ELSE 'Discovery Mode: Tìm thấy ' || n_sources || ' đoạn trích liên quan từ tài liệu của bạn.' END AS answer,
      coalesce(n_sources, 0) AS n_sources, coalesce(substring(context, 1, 3000), '') AS used_context
    FROM questions LEFT JOIN context USING (qid))"""


@query(f"WITH {_REPLY} SELECT qid, answer, n_sources, used_context FROM reply")
def retrieve_only(spark: SparkSession, directory: str) -> DataFrame:
    questions = _questions(spark, directory)
    return answers.retrieve_only(questions, answers.build_context(_hits(spark, directory, questions))).drop("sources")


_PROMPT = f"""WITH {_CONTEXT}, {_QUESTIONS} SELECT qid,
    'Bạn là trợ lý AI cho kho tài liệu. Chỉ trả lời dựa trên CONTEXT đã cho. Nếu thiếu dữ liệu trong CONTEXT thì nói rõ là không đủ thông tin từ tài liệu.'
    || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'QUESTION: ' || question
    || chr(10) || chr(10) || 'ANSWER (in Vietnamese):' AS prompt FROM questions LEFT JOIN context USING (qid)"""
_ENGLISH_PROMPT = f"""WITH {_HITS}, {_QUESTIONS}, context AS (SELECT qid, string_agg(chr(10) || '[Source: ' || filename || ']' || chr(10) || text || chr(10), ''
      ORDER BY rk) AS context FROM hits GROUP BY qid)
    SELECT qid, chr(10) || 'You are an AI assistant for a large document repository. ' || chr(10)
    || 'Answer the following question based ONLY on the provided context.' || chr(10)
    || 'If you don''t know the answer, say "I don''t have enough information from the documents."' || chr(10)
    || chr(10) || 'CONTEXT:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'QUESTION: ' || question || chr(10)
    || chr(10) || 'ANSWER:' || chr(10) AS prompt FROM questions LEFT JOIN context USING (qid)"""


@query(_PROMPT)
def build_prompt(spark: SparkSession, directory: str) -> DataFrame:
    questions = _questions(spark, directory)
    return answers.build_prompt(questions, answers.build_context(_hits(spark, directory, questions)))


@query(_ENGLISH_PROMPT)
def build_english_prompt(spark: SparkSession, directory: str) -> DataFrame:
    questions = _questions(spark, directory)
    context = answers.build_context(_hits(spark, directory, questions), with_score=False)
    return answers.build_prompt(questions, context, fv.PROMPT_EN)


COUNT_WORDS = ("heonha", "thion")
STATUS_WORDS = ("inha",)


@query(
    f"""WITH {_REPLY}, routed AS (SELECT *, CASE
      WHEN contains(lower(question), 'heonha') OR contains(lower(question), 'thion') THEN 'count'
      WHEN contains(lower(question), 'inha') THEN 'status' ELSE 'retrieve' END AS intent FROM reply)
    SELECT qid, intent, CASE WHEN intent = 'count' THEN ({COUNT_SENTENCE_SQL}) WHEN intent = 'status' THEN ({STATUS_SENTENCE_SQL})
      WHEN length(question) % 13 = 5 THEN 'Mình chưa truy xuất được RAG cục bộ, hiện đang trả lời ở chế độ cơ bản.' ELSE answer END AS answer FROM routed"""
)
def chat_router(spark: SparkSession, directory: str) -> DataFrame:
    """Statistics for some questions, retrieval for the rest, which fails for some; keywords
    are syllables of the invented prose."""
    asked = read_table(spark, directory, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    questions = materialise(models.embed(asked, _moody_model, text="question", dim=DIM, error="error"), "asked")
    context = answers.build_context(_hits(spark, directory, questions.where("error IS NULL")))
    retrieved = answers.retrieve_only(questions, context, questions.where("error IS NOT NULL"))
    return answers.route_and_answer(
        questions,
        reports.count_sentence(read_table(spark, directory, "documents")),
        reports.status_sentence(read_table(spark, directory, "events"), "event_type"),
        retrieved,
        count_keywords=COUNT_WORDS,
        status_keywords=STATUS_WORDS,
    )


# Requests: every fifth only asks for sources, every seventh for a document that does not
# exist, every eleventh for one that does; some have no vector; models are as in ``generate_answers``.
_REQUESTED = f"""{_SEARCHED}, request AS (SELECT *, item_id AS qid,
      CASE item_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'google' ELSE 'broken' END AS provider,
      CASE WHEN item_id % 7 = 3 THEN -1 WHEN item_id % 11 = 4 THEN item_id END AS wanted FROM benchmark),
    pairs AS (SELECT r.qid, n.id, asked.v AS a, vectors.v AS b FROM request r JOIN asked ON asked.item_id = r.qid, named n
      JOIN vectors ON vectors.id = n.id WHERE (r.wanted IS NULL OR r.wanted = n.doc_id) AND length(r.text) % 13 <> 5),
    hits AS (SELECT qid, id, d, rk, text FROM ({knn_sql('SELECT * FROM pairs')}) JOIN named USING (id)),
    context AS (SELECT qid, string_agg('[Source: ' || id || ' | score=' || printf('%.4f', d) || ']' || chr(10) || text,
      chr(10) || chr(10) ORDER BY rk) AS context, count(*) AS n_sources FROM hits GROUP BY qid),
    reply AS (SELECT qid, coalesce(n_sources, 0) AS n_sources, coalesce(substring(context, 1, 3000), '') AS used_context, CASE
      WHEN length(request.text) % 13 = 5 THEN '[Error] Milvus retrieval failed: no vector'
      WHEN context IS NULL THEN 'Không tìm thấy ngữ cảnh phù hợp từ Milvus cho câu hỏi này.'
      WHEN qid % 5 = 0 THEN 'Discovery Mode: Tìm thấy ' || n_sources || ' đoạn trích liên quan từ tài liệu của bạn.'
      WHEN provider = 'google' AND qid % 2 = 0 THEN '[Error] Gemini API Key is missing. Please provide it in settings.'
      WHEN provider = 'broken' THEN '[Error] broken LLM inference failed: out of order'
      ELSE 'characters: ' || length('Bạn là trợ lý AI cho kho tài liệu. Chỉ trả lời dựa trên CONTEXT đã cho. Nếu thiếu dữ liệu trong CONTEXT thì nói rõ là không đủ thông tin từ tài liệu.'
        || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || context || chr(10) || chr(10) || 'QUESTION: ' || request.text || chr(10) || chr(10) || 'ANSWER (in Vietnamese):') END AS answer
      FROM request LEFT JOIN context USING (qid))"""


@query(
    f"""WITH {_REQUESTED} SELECT qid, answer, n_sources, used_context, id AS filename, round(d, 6) AS score, substring(text, 1, 300) AS preview
    FROM reply LEFT JOIN hits USING (qid)"""
)
def answer_requests(spark: SparkSession, directory: str) -> DataFrame:
    """Every benchmark text as a request, through all branches; one row per source."""
    item = F.col("item_id")
    providers = F.array(F.lit("local"), F.lit("google"), F.lit("broken"))
    requests = read_table(spark, directory, "benchmark").select(
        item.alias("qid"),
        F.col("text").alias("question"),
        F.when(item % 7 == 3, F.lit(-1)).when(item % 11 == 4, item).cast("bigint").alias("doc_id"),
        F.element_at(providers, (item % 3 + 1).cast("int")).alias("provider"),
        (item % 2 == 1).alias("has_key"),
        F.when(item % 5 == 0, F.lit(True)).alias("retrieve_only"),
    )
    chunks = _chunks(spark, directory)
    rows = models.embed(chunks, models.hashed_tokens(DIM), dim=DIM)

    def count_characters(prompts: list[str]) -> list[str]:
        return [f"characters: {len(p)}" for p in prompts]

    def fail(prompts: list[str]) -> list[str]:
        raise RuntimeError("out of order")

    replies = answer_all(
        requests,
        _moody_model,
        lambda asked: search.nearest_within(asked, rows, "doc_id", dim=DIM),
        chunks,
        lambda: {"local": count_characters, "google": count_characters, "broken": fail},
        dim=DIM,
        seconds=600.0,
    )
    return replies.select("qid", "answer", "n_sources", "used_context", F.explode_outer("sources").alias("s")).select(
        "qid", "answer", "n_sources", "used_context", "s.filename", F.round("s.score", 6).alias("score"), "s.preview"
    )
