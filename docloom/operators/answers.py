"""Context, prompts, replies and citations from ranked hits.

Hits are ``qid, id, l2_sq, rank, filename, text``; a question has at most k of them,
so the lists gathered per question are bounded by k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import fixed_values as fv
from docloom.functions.chat import intent, is_question, question_key
from docloom.functions.text import document_of_chunk, preview, used_context
from docloom.operators.registry import with_defaults


def build_context(hits: DataFrame, *, with_score: bool = True) -> DataFrame:
    """``qid, context, n_sources, sources``: hits in rank order as one text.

    With scores, parts are separated by a blank line; without, each part starts and
    ends with a line break and nothing lies between them.
    """
    if with_score:
        part = F.format_string("[Source: %s | score=%.4f]\n%s", "filename", "l2_sq", "text")
        glue = "\n\n"
    else:
        part = F.format_string("\n[Source: %s]\n%s\n", "filename", "text")
        glue = ""
    row = F.struct(
        "rank",
        part.alias("part"),
        F.struct("filename", F.col("l2_sq").alias("score"), preview(F.col("text")).alias("preview")).alias("source"),
    )
    gathered = hits.groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return gathered.select(
        "qid",
        F.array_join(F.col("rows.part"), glue).alias("context"),
        F.size("rows").cast("bigint").alias("n_sources"),
        F.col("rows.source").alias("sources"),
    )


def retrieve_only(questions: DataFrame, context: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One reply per question, found or not: ``qid, answer, n_sources, sources, used_context``.

    ``failed`` (``qid, error``) lists questions whose retrieval broke; with it replies have ``retrieval_error``.
    """
    joined = questions.select("qid").join(context.select("qid", "context", "n_sources", "sources"), "qid", "left")
    found = F.length("context") > 0
    answer = F.when(found, F.format_string(fv.RETRIEVE_ONLY, "n_sources")).otherwise(fv.NO_CONTEXT)
    if failed is not None:
        joined = joined.join(failed.select("qid", "error"), "qid", "left")
        broken = F.col("error").isNotNull()
        answer = F.when(broken, F.concat(F.lit(fv.RETRIEVAL_FAILED), "error")).otherwise(answer)
        found = found & ~broken
    return joined.select(
        "qid",
        answer.alias("answer"),
        *([F.col("error").alias("retrieval_error")] if failed is not None else []),
        F.when(found, F.col("n_sources")).otherwise(0).cast("bigint").alias("n_sources"),
        F.when(found, F.col("sources")).otherwise(F.array().cast(context.schema["sources"].dataType)).alias("sources"),
        F.when(found, used_context(F.col("context"))).otherwise("").alias("used_context"),
    )


def build_prompt(questions: DataFrame, context: DataFrame, template: str = fv.PROMPT_VI) -> DataFrame:
    """``qid, prompt``: the template with context and question filled in."""
    before, rest = template.split("{context}")
    middle, after = rest.split("{question}")
    return questions.join(context.select("qid", "context"), "qid", "left").select(
        "qid",
        F.concat(
            F.lit(before), F.coalesce("context", F.lit("")), F.lit(middle), F.col("question"), F.lit(after)
        ).alias("prompt"),
    )


def citations(hits: DataFrame) -> DataFrame:
    """``qid, id, source, page``: sources numbered by their best rank in the question."""
    sources = hits.groupBy("qid", document_of_chunk(F.col("filename")).alias("source")).agg(
        F.min("rank").alias("first_rank")
    )
    order = Window.partitionBy("qid").orderBy("first_rank")
    return sources.select(
        "qid",
        F.dense_rank().over(order).cast("bigint").alias("id"),
        "source",
        F.lit(None).cast("int").alias("page"),
    )


def request_defaults(requests: DataFrame) -> DataFrame:
    """Fill what a request may leave out: session, provider, retrieval-only flag."""
    return with_defaults(
        requests,
        {
            "session_id": F.lit(fv.DEFAULT_SESSION),
            "provider": F.lit(fv.DEFAULT_PROVIDER),
            "retrieve_only": F.lit(False),
        },
    )


def split_questions(messages: DataFrame, text: str = "question") -> tuple[DataFrame, DataFrame]:
    """Askable questions, and rejected ones with their error."""
    asked = is_question(F.col(text))
    return messages.where(asked), messages.where(~asked).withColumn("error", F.lit(fv.EMPTY_QUESTION))


def distinct_questions(questions: DataFrame) -> DataFrame:
    """``question_key, qid, n_asked``: one representative per identical question.

    Answer these, then ``share_answers``. The aggregate combines copies before the
    shuffle, so a question asked by everyone is no hot spot.
    """
    return questions.groupBy(question_key(F.col("question")).alias("question_key")).agg(
        F.min("qid").alias("qid"), F.count("*").alias("n_asked")
    )


def share_answers(questions: DataFrame, answered: DataFrame, salts: int = 64) -> DataFrame:
    """Give every question the answer of its representative, NULL if it has none.

    ``answered`` is ``question_key, n_asked, answer, …`` as a written table. A question
    that makes up more than a thousandth of all rows would crowd into one task, so its
    askers are spread over ``salts`` copies of the answer. There can be at most a
    thousand such questions, which is why their keys may be broadcast.
    """
    total = answered.agg(F.sum("n_asked").alias("total")).scalar()
    is_hot = F.col("n_asked") * 1000 > total
    hot = answered.where(is_hot).select("question_key", F.lit(True).alias("_hot"))
    asked = (
        questions.withColumn("question_key", question_key(F.col("question")))
        .join(F.broadcast(hot), "question_key", "left")
        .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("qid"), F.lit(salts))).otherwise(0).cast("int"))
    )
    all_salts = F.sequence(F.lit(0), F.lit(salts - 1))
    copies = answered.withColumn("_salt", F.explode(F.when(is_hot, all_salts).otherwise(F.array(F.lit(0)))))
    return asked.join(copies, ["question_key", "_salt"], "left").drop("_salt", "_hot")


def route_and_answer(
    questions: DataFrame,
    count_answer: DataFrame,
    status_answer: DataFrame,
    retrieved: DataFrame,
    *,
    count_keywords: tuple[str, ...] = fv.COUNT_KEYWORDS,
    status_keywords: tuple[str, ...] = fv.STATUS_KEYWORDS,
) -> DataFrame:
    """``qid, intent, answer``: statistics sentences or the retrieved answer.

    ``count_answer`` and ``status_answer`` are one-row aggregates (``answer``), which
    is what lets them be attached as scalar subqueries. ``retrieved`` is
    ``qid, answer`` and optionally ``retrieval_error``, as replies to requests are; a failed
    retrieval, a missing row and a blank answer get their fixed messages.
    """
    if "retrieval_error" in retrieved.columns:
        retrieved = retrieved.withColumn("answer", F.when(F.col("retrieval_error").isNull(), F.col("answer")))
    routed = questions.withColumn("intent", intent(F.col("question"), count_keywords, status_keywords))
    statistics = {"count": count_answer, "status": status_answer}
    parts = [
        routed.where(F.col("intent") == name).select("qid", "intent", one_row.select("answer").scalar().alias("answer"))
        for name, one_row in statistics.items()
    ]
    answer: Column = (
        F.when(F.col("answer").isNull(), fv.BASIC_MODE)
        .when(F.length(F.trim("answer")) == 0, fv.BLANK_ANSWER)
        .otherwise(F.col("answer"))
    )
    searched = (
        routed.where(F.col("intent") == "retrieve")
        .join(retrieved.select("qid", "answer"), "qid", "left")
        .select("qid", "intent", answer.alias("answer"))
    )
    return searched.unionByName(parts[0]).unionByName(parts[1])
