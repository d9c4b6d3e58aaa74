"""Questions to replies: the whole request as one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import fixed_values as fv
from docloom.functions.text import used_context
from docloom.operators import answers, models, search
from docloom.session import materialise


def answer_requests(
    requests: DataFrame,
    model_factory: Callable,
    find: Callable[[DataFrame], DataFrame | tuple[DataFrame, DataFrame]],
    texts: DataFrame,
    generators: models.Generators,
    *,
    dim: int,
    template: str = fv.PROMPT_VI,
    seconds: float | None = None,
) -> DataFrame:
    """``qid, answer, n_sources, sources, used_context, retrieval_error`` for every request.

    ``requests`` is ``qid, question`` and optionally ``doc_id`` (search in that document
    only), ``session_id, provider, has_key, retrieve_only``. ``find`` takes them with their
    ``vector`` and returns hits, or hits and ``qid, error`` of the questions it could not serve;
    ``texts`` (``id, filename, text``) hydrate the hits.

    A question whose vector or search failed gets the fixed error reply, without sources, and
    the others are answered. A question without context gets a fixed reply and reaches no model; so does one
    that only asks for sources. A missing key, a failing model or one that takes longer than ``seconds`` gives
    an error reply that keeps sources and context. Vectors, contexts and answers are written once each.
    """
    asked = answers.request_defaults(requests)
    if "has_key" not in asked.columns:
        asked = asked.withColumn("has_key", F.lit(False))
    asked = materialise(models.embed(asked, model_factory, text="question", dim=dim, error="retrieval_error"), "asked")
    found = find(asked.where(F.col("retrieval_error").isNull()).drop("retrieval_error"))
    hits, unserved = found if isinstance(found, tuple) else (found, None)
    context = answers.build_context(search.hydrate(hits, texts))
    known = asked.drop("vector")
    if unserved is not None:
        known = known.join(unserved.select("qid", F.col("error").alias("search_error")), "qid", "left")
        known = known.withColumn("retrieval_error", F.coalesce("retrieval_error", "search_error")).drop("search_error")
    found = materialise(known.join(context, "qid", "left"), "found")
    failed = F.col("retrieval_error").isNotNull()
    has_context = F.coalesce(F.length("context") > 0, F.lit(False)) & ~failed
    silent = found.where(~has_context | F.col("retrieve_only"))
    fixed = (
        F.when(failed, F.concat(F.lit(fv.RETRIEVAL_FAILED), "retrieval_error"))
        .when(has_context, F.format_string(fv.RETRIEVE_ONLY, "n_sources"))
        .otherwise(fv.NO_CONTEXT)
    )
    spoken = found.where(has_context & ~F.col("retrieve_only"))
    prompts = spoken.join(answers.build_prompt(spoken.select("qid", "question"), spoken, template), "qid")
    kept = ["qid", "n_sources", "sources", "context", "retrieval_error"]
    generated = models.generate(prompts.select(*kept, "prompt", "provider", "has_key"), generators, seconds=seconds)
    replies = materialise(generated.select(*kept, "answer").unionByName(silent.select(*kept, fixed.alias("answer"))), "replies")
    return replies.select(
        "qid",
        "answer",
        F.when(failed, 0).otherwise(F.coalesce("n_sources", F.lit(0))).cast("bigint").alias("n_sources"),
        F.coalesce(F.when(~failed, F.col("sources")), F.array().cast(context.schema["sources"].dataType)).alias("sources"),
        F.coalesce(F.when(~failed, used_context(F.col("context"))), F.lit("")).alias("used_context"),
        "retrieval_error",
    )
