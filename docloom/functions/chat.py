"""Questions, intents and roles."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import fixed_values as fv
from docloom.functions.text import strip_whitespace


def question_key(question: Column) -> Column:
    """Digest of the lower-cased, trimmed question: equal keys are the same question.

    A digest keeps long questions out of shuffles and sorts.
    """
    return F.sha2(strip_whitespace(F.lower(question)), 256)


def is_question(question: Column) -> Column:
    return F.coalesce(F.length(strip_whitespace(question)) > 0, F.lit(False))


def is_chat_role(role: Column) -> Column:
    return role.isin(*fv.ROLES)


def intent(
    question: Column,
    count_keywords: tuple[str, ...] = fv.COUNT_KEYWORDS,
    status_keywords: tuple[str, ...] = fv.STATUS_KEYWORDS,
) -> Column:
    """``count``, ``status`` or ``retrieve``; the first rule that matches wins."""
    lowered = F.lower(question)

    def mentions(words: tuple[str, ...]) -> Column:
        return reduce(or_, [lowered.contains(word) for word in words])

    return (
        F.when(mentions(count_keywords), "count")
        .when(mentions(status_keywords), "status")
        .otherwise("retrieve")
    )
