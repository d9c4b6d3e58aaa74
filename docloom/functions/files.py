"""File names, routes and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import fixed_values as fv


def file_extension(filename: Column) -> Column:
    """Lower-case text after the last dot; a name without a dot is returned whole."""
    return F.lower(F.substring_index(filename, ".", -1))


def extractor_route(filename: Column, ocr_extensions: tuple[str, ...] = fv.OCR_EXTENSIONS) -> Column:
    return F.when(file_extension(filename).isin(*ocr_extensions), "ocr").otherwise("text")


def relative_path(path: Column, root: str) -> Column:
    """``path`` below ``root``; a path outside it is returned unchanged."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def short_id(name: Column) -> Column:
    """Eight-character display id, the same on every run. Not a key: it may collide."""
    return F.substring(F.sha2(name, 256), 1, fv.SHORT_ID_LENGTH)
