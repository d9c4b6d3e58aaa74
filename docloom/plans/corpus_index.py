"""Corpus to vector index."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import fixed_values as fv
from docloom.functions.text import chunk_key, chunk_text, clean_text, strip_html, truncate
from docloom.operators.index import IvfIndex, build_index
from docloom.operators.models import embed


def html_chunks(
    html: Column,
    size: int = fv.CHUNK_SIZE,
    overlap: int = fv.CHUNK_OVERLAP,
    minimum: int = fv.CHUNK_MINIMUM,
) -> Column:
    """Array of the chunks of one HTML document."""
    return chunk_text(strip_html(html), size, overlap, minimum)


def explode_chunks(documents: DataFrame, id_column: str, source: str, chunks: Column) -> DataFrame:
    """``doc_id, chunk_idx, id, filename, text``: one row per chunk, no shuffle.

    ``id`` is the whole key of the chunk, ``filename`` the key cut to its limit.
    ``chunk_idx`` counts the chunks that were kept. Documents without any are gone.
    ``chunks`` is exploded as an expression, not as a column made before: from a column
    Spark would infer a filter on its size and compute all chunks once more for it.
    """
    return documents.select(F.col(id_column).alias("doc_id"), F.posexplode(chunks).alias("chunk_idx", "text")).select(
        "doc_id",
        F.col("chunk_idx").cast("bigint").alias("chunk_idx"),
        chunk_key(source, F.col("doc_id"), F.col("chunk_idx")).alias("id"),
        truncate(chunk_key(source, F.col("doc_id"), F.col("chunk_idx")), fv.FILENAME_LIMIT).alias("filename"),
        truncate(F.col("text"), fv.TEXT_LIMIT).alias("text"),
    )


def clean_chunk_table(chunks: DataFrame, doc_id: str = "doc_id", chunk: str = "text") -> DataFrame:
    """``doc_id, chunk``: cleaned chunks, ready to append."""
    return chunks.select(F.col(doc_id).cast("string").alias("doc_id"), clean_text(F.col(chunk)).alias("chunk"))


def append_chunks(chunks: DataFrame, path: str, table_format: str = "parquet") -> None:
    chunks.write.format(table_format).mode("append").save(path)


def index_chunks(
    chunks: DataFrame,
    model_factory: Callable[[], Callable[[list[str]], np.ndarray]],
    path: str,
    *,
    dim: int,
    nlist: int = fv.NLIST,
    batch_size: int = fv.EMBED_BATCH,
) -> IvfIndex:
    """Embed, write; then fit lists on the written chunks.

    The embedded chunks are written once, because fitting reads them several times
    and the model is by far the most expensive step.
    """
    embedded = embed(chunks, model_factory, dim=dim, batch_size=batch_size)
    embedded.write.mode("error").parquet(f"{path}/chunks")
    rows = chunks.sparkSession.read.parquet(f"{path}/chunks")
    return build_index(rows, dim=dim, nlist=nlist, path=f"{path}/index", written=True)


def index_corpus(
    corpus: DataFrame,
    model_factory: Callable[[], Callable[[list[str]], np.ndarray]],
    path: str,
    *,
    source: str,
    **settings: int,
) -> IvfIndex:
    """HTML corpus (``id, content_html``) to index: strip, cut, embed, fit."""
    chunks = explode_chunks(corpus, "id", source, html_chunks(F.col("content_html")))
    return index_chunks(chunks, model_factory, path, **settings)


def index_extracted(
    extracted: DataFrame,
    model_factory: Callable[[], Callable[[list[str]], np.ndarray]],
    path: str,
    *,
    source: str,
    **settings: int,
) -> IvfIndex:
    """Extracted texts (``filename, extracted_text, error``) to index: clean, cut, embed,
    fit. Failed extractions are left out."""
    good = extracted.where(F.col("error").isNull())
    chunks = explode_chunks(good, "filename", source, chunk_text(clean_text(F.col("extracted_text"))))
    return index_chunks(chunks, model_factory, path, **settings)
