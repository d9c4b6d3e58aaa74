"""Cleaning and cutting text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import fixed_values as fv


def strip_whitespace(text: Column) -> Column:
    return F.btrim(text, F.lit(fv.WHITESPACE_CHARACTERS))


def strip_html(html: Column) -> Column:
    """Tags become a space, whitespace runs collapse; NULL becomes ''."""
    spaced = F.regexp_replace(F.coalesce(html, F.lit("")), fv.HTML_TAG, " ")
    return F.trim(F.regexp_replace(spaced, fv.WHITESPACE + "+", " "))


def clean_text(text: Column) -> Column:
    """Control characters are deleted first, then whitespace runs collapse."""
    kept = F.regexp_replace(text, fv.CONTROL_CHARACTERS, "")
    return F.trim(F.regexp_replace(kept, fv.WHITESPACE + "+", " "))


def _windows(text: Column, size: int, step: int) -> Column:
    """All windows of ``size`` code points starting every ``step`` code points.

    ``substring`` counts code points from the start of the string on every call,
    which is quadratic for long texts. Cutting the text once into pieces of
    ``step`` and gluing neighbours is linear. The outer one-element ``transform``
    gives the array of pieces a name, so it is computed once per row.
    """
    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % step), F.lit(0))
    span = -(-size // step)

    def glue(parts: Column) -> Column:
        return F.transform(
            parts,
            lambda _, i: F.substring(F.array_join(F.slice(parts, i + 1, span), ""), 1, size),
        )

    return F.element_at(F.transform(F.array(pieces), glue), 1)


def chunk_text(
    text: Column,
    size: int = fv.CHUNK_SIZE,
    overlap: int = fv.CHUNK_OVERLAP,
    minimum: int = fv.CHUNK_MINIMUM,
) -> Column:
    """Overlapping windows, trimmed, short ones dropped; an array in text order."""
    if size < 1:
        raise ValueError("chunk size must be at least 1")
    windows = F.transform(_windows(text, size, max(1, size - overlap)), strip_whitespace)
    return F.filter(windows, lambda chunk: F.length(chunk) >= minimum)


def chunk_plain(
    text: Column, size: int = fv.PLAIN_CHUNK_SIZE, overlap: int = fv.PLAIN_CHUNK_OVERLAP
) -> Column:
    """Overlapping windows exactly as cut."""
    if size <= overlap:
        raise ValueError("chunk size must be larger than the overlap")
    return _windows(text, size, size - overlap)


def join_tokens(lines: Column) -> Column:
    """Array of arrays of words -> words joined by one space, trimmed."""
    return strip_whitespace(F.array_join(F.flatten(lines), " "))


def join_elements(elements: Column) -> Column:
    return F.array_join(elements, "\n")


def chunk_key(source: str, document: Column, index: Column) -> Column:
    return F.concat(F.lit(f"{source}:"), document.cast("string"), F.lit("#chunk-"), index.cast("string"))


def document_of_chunk(key: Column) -> Column:
    return F.regexp_replace(key, "#chunk-[0-9]+$", "")


def truncate(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def preview(text: Column) -> Column:
    return truncate(text, fv.PREVIEW_LIMIT)


def used_context(context: Column) -> Column:
    return truncate(context, fv.CONTEXT_LIMIT)
