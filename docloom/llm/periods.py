"""Periodic runs of words, found in tiles whose size follows the period.

Word i matches word i + q for 3 q places in a row where words repeat four times with period
q. For the octave of periods P to 2 P - 1 a document has a boundary every 3 P words (5, where that is
less), so such a stretch of matches always holds one. A tile is the words around neighbouring boundaries; it is solved by
itself: Z-functions of the words after and before a boundary give, for all periods of the octave at once, how far
matches go on both sides, up to the next boundary. What goes further is a fragment
that the neighbouring tile has too. Fragments are shuffled by document and period and
stitched where they overlap.

A boundary without repeated n-grams at a distance of the octave cannot lie in a long
stretch, so only the tiles of the others are cut out. Most documents have none; they
pass without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import blocks as B
from docloom.llm import substrings
from docloom.llm import words as W
from docloom.session import materialise

MIN_WORDS, REPEATS = 6, 4
#: Matches in a row that the first look asks for at a place.
GRAM = 16
#: Words of a tile, unless one boundary's own are more.
TILE_WORDS = 1 << 15
#: Up to this octave all boundaries of a tile are stepped along together.
STEPPED = 16
_PIECE = 4 << 20
_PAIRS = 1 << 20
SALTS = 16
TILE = "octave long, offset long, boundary long, boundaries int, words binary"
RUNS = "array<struct<start:long,length:long,period:long>>"


def _spacing(octave: int) -> int:
    """Words between boundaries: no more than the matches of the shortest run of the octave."""
    return max((REPEATS - 1) * octave, MIN_WORDS - 1)


def _needed(periods: np.ndarray) -> np.ndarray:
    """Matches in a row that make a run."""
    return np.maximum((REPEATS - 1) * periods, MIN_WORDS - periods)


def _boundaries(words: W.Words, octave: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries (as positions in the batch) of all texts with room for a run, and their texts."""
    counts, spacing = words.counts, _spacing(octave)
    texts = np.flatnonzero((counts >= REPEATS * octave) & (counts >= MIN_WORDS))
    many = -(-counts[texts] // spacing)
    text = np.repeat(texts, many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return words.first[text] + spacing * nth, text


def _promising(hashes: np.ndarray, words: W.Words, octave: int, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which boundaries may lie in a run, for some period of the octave.

    Half of a run's matches, or more, are on one side of its boundary: that side is looked at where it begins
    and where its half ends.
    """
    half = _spacing(octave) // 2
    gram = min(GRAM, half)
    grams = W.window_hashes(hashes, gram)
    if not len(grams):
        return np.zeros(len(at), bool)
    last, out = len(grams) - 1, np.zeros(len(at), bool)
    steps = np.arange(octave, 2 * octave)
    low, high = words.first[text], words.first[text + 1]
    many = max(1, _PAIRS // octave)
    for k in range(0, len(at), many):
        c, a, b = at[k : k + many, None], low[k : k + many, None], high[k : k + many, None]

        def equal(place):
            return grams[np.clip(place + steps, 0, last)] == grams[np.clip(place, 0, last)]  # noqa: B023

        after = equal(c) & (c + steps + half <= b)
        before = equal(c - gram) & (c - half >= a) & (c + steps <= b)
        if half > gram:
            after &= equal(c + half - gram)
            before &= equal(c - half)
        out[k : k + many] = (after | before).any(axis=1)
    return out


def _found(words: W.Words, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every octave the boundaries worth a tile, and their texts. Those of short periods
    are stepped along at once, as chance often repeats a word or two."""
    octave, longest = 1, int(words.counts.max(initial=0))
    while REPEATS * octave <= longest:
        at, text = _boundaries(words, octave)
        kept = _promising(hashes, words, octave, at, text)
        at, text = at[kept], text[kept]
        if octave <= STEPPED and len(at):
            after, before = _stepped(hashes, at, octave, words.first[text], words.first[text + 1])
            kept = _telling(after, before, octave).any(axis=1)
            at, text = at[kept], text[kept]
        yield octave, at, text
        octave *= 2


def tiles(words: W.Words, hashes: np.ndarray) -> Iterator[tuple[int, dict]]:
    """Tiles of a batch, each with its text: the words around boundaries that follow each other."""
    for octave, at, text in _found(words, hashes):
        apart = np.ones(len(at), bool)
        spacing = _spacing(octave)
        apart[1:] = (np.diff(at) != spacing) | (np.diff(text) != 0)
        edges = np.append(np.flatnonzero(apart), len(at))
        most = max(1, TILE_WORDS // spacing)
        for left, right in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for one in range(left, right, most):
                end = min(one + most, right)
                row, first = int(text[one]), int(words.first[text[one]])
                low = max(first, int(at[one]) - spacing)
                high = min(int(words.first[row + 1]), int(at[end - 1]) + spacing + 2 * octave)
                names = np.unique(hashes[low:high], return_inverse=True)[1].astype(np.int32)
                yield row, {"octave": octave, "offset": low - first, "boundary": int(at[one]) - low, "boundaries": end - one, "words": B.squeeze(names)}


def _matching(left: np.ndarray, right: np.ndarray) -> int:
    """How many first values are equal, looked at in growing pieces."""
    size, done, piece = min(len(left), len(right)), 0, 16
    while done < size:
        unequal = left[done : done + piece][: size - done] != right[done : done + piece][: size - done]
        at = int(unequal.argmax())
        if unequal[at]:
            return done + at
        done, piece = min(size, done + piece), piece * 4
    return size


def extensions(pattern: np.ndarray, text: np.ndarray, count: int) -> np.ndarray:
    """For the first ``count`` places of ``text``: how long the pattern matches there.

    The Z-function of the pattern is carried along the text; an inner match is only
    looked at beyond what is known.
    """
    heads, places = memoryview(np.ascontiguousarray(pattern)), memoryview(np.ascontiguousarray(text))
    size = len(pattern)

    def carry(where: np.ndarray, view: memoryview, out: list[int], z: list[int]) -> list[int]:
        left = right = 0
        for i in range(len(out), min(count, len(where))):
            value = min(z[i - left], right - i) if i < right else 0
            if i + value >= right and (value or (size and heads[0] == view[i])):
                value += _matching(pattern[value:], where[i + value :])
                left, right = i, i + value
            out.append(value)
        return out

    own = [size]
    carry(pattern, heads, own, own)
    found = carry(text, places, [], own)
    return np.array(found + [0] * (count - len(found)), np.int64)


def _stepped(words: np.ndarray, at: np.ndarray, octave: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches after and before every boundary for every period, up to the next boundary, one
    step at a time; words from ``low`` to ``high`` count."""
    c, q = at[:, None], np.arange(octave, 2 * octave)[None, :]
    last, found = len(words) - 1, []
    for sign in (1, -1):
        length, going = np.zeros((len(at), octave), np.int64), np.ones((len(at), octave), bool)
        for step in range(_spacing(octave)):
            place = c + step if sign > 0 else c - 1 - step
            going &= (place >= low[:, None]) & (place + q < high[:, None])
            going &= words[np.clip(place, 0, last)] == words[np.clip(place + q, 0, last)]
            if not going.any():
                break
            length += going
        found.append(length)
    return found[0], found[1]


def _by_z(words: np.ndarray, c: int, octave: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one boundary by Z-functions."""
    far, near = _spacing(octave), 2 * octave
    after = extensions(words[c : c + far], words[c + octave : c + near + far], octave)
    back = words[max(0, c - far) : c][::-1]
    # the largest period comes first in the reversed words, and may be beyond the text's end
    missing = max(0, c + near - 1 - len(words))
    ahead = words[max(0, c - far) : c + near - 1][::-1]
    before = np.concatenate([np.zeros(min(missing, octave), np.int64), extensions(back, ahead, max(0, octave - missing))])[::-1]
    return after, before


def _telling(after: np.ndarray, before: np.ndarray, octave: int) -> np.ndarray:
    """Matches that make a run, or go on beyond the next boundary."""
    far = _spacing(octave)
    return (after + before >= _needed(np.arange(octave, 2 * octave))) | (after >= far) | (before >= far)


def fragments(words: np.ndarray, octave: int, boundary: int, boundaries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of matches that are long enough or go on in the next tile: period, first
    match and the end of the matches, overlapping ones joined."""
    at = boundary + _spacing(octave) * np.arange(boundaries)
    if octave <= STEPPED:
        after, before = _stepped(words, at, octave, np.zeros(len(at), int), np.full(len(at), len(words)))
    else:
        both = [_by_z(words, int(c), octave) for c in at]
        after, before = np.array([b[0] for b in both]), np.array([b[1] for b in both])
    row, column = np.nonzero(_telling(after, before, octave))
    q, low, high = octave + column, at[row] - before[row, column], at[row] + after[row, column]
    return joined(q, low, high)


def joined(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching stretches of the same period as one."""
    if not len(q):
        return q, low, high
    order = np.lexsort((low, q))
    q, low, high = q[order], low[order], high[order]
    apart = int(high.max()) + 2
    reach = np.maximum.accumulate(high + q * apart)
    new = np.ones(len(q), bool)
    new[1:] = low[1:] + q[1:] * apart > reach[:-1]
    edges = np.flatnonzero(new)
    return q[edges], low[edges], np.maximum.reduceat(high, edges)


def _solve(batches):
    for batch in batches:
        parts = []
        for key, tile in zip(batch.column("run_key"), batch.column("tile").to_pylist(), strict=True):
            q, low, high = fragments(B.unsqueeze(tile["words"], np.int32), tile["octave"], tile["boundary"], tile["boundaries"])
            if len(q):
                columns = [pa.array([key.as_py()] * len(q), pa.binary()), *(pa.array(v.astype(np.int64)) for v in (q, low + tile["offset"], high + tile["offset"]))]
                parts.append(pa.RecordBatch.from_arrays(columns, names=["run_key", "period", "low", "high"]))
        yield from parts


def _stitched(found: DataFrame) -> DataFrame:
    """All runs of every text, from fragments: ``run_key, runs``."""
    found = found.groupBy("run_key", "period", "low").agg(F.max("high").alias("high"))
    order = Window.partitionBy("run_key", "period").orderBy("low")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.when(reach.isNull() | (F.col("low") > reach), 1).otherwise(0))
    islands = marked.withColumn("island", F.sum("new").over(order)).groupBy("run_key", "period", "island").agg(F.min("low").alias("start"), F.max("high").alias("high"))
    whole = islands.withColumn("length", F.col("high") - F.col("start") + F.col("period"))
    whole = whole.where((F.col("length") >= MIN_WORDS) & (F.col("length") >= REPEATS * F.col("period")))
    # a multiple of a run's period gives the same stretch
    least = whole.groupBy("run_key", "start", "length").agg(F.min("period").alias("period"))
    listed = F.sort_array(F.collect_list(F.struct("start", "period", "length")))
    ordered = F.transform(listed, lambda r: F.struct(r["start"], r["length"], r["period"]))
    return least.groupBy("run_key").agg(ordered.cast(RUNS).alias("runs"))


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Find all periodic runs of every text and keep one period of each.

    A run is a stretch of words with smallest period q, at least 6 words and 4 q long, that no
    neighbouring word extends; words are separated by space and U+0009 to U+000D. Returns
    all columns with ``text`` collapsed (a word goes if it lies in a run after the run's
    first q words, with the white space before it), ``n_words`` (before) and ``runs`` (an array of
    ``start, length, period`` by start, then period; starts count words from 0).

    NULL texts stay NULL; they and empty texts have no words and no runs. A text that loses nothing
    stays as it is. Texts are worked on whole, however long. Rows are told apart by their
    texts, so repeated rows and NULL ids get equal results. Input columns named
    ``n_words`` or ``runs`` are replaced, any other name is left alone. An empty table gives an empty table.
    """
    own = B.added(docs.schema, ("n_words", T.LongType()), ("runs", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))))
    names = own.fieldNames()
    # names of our own for all columns, so that none can clash on the way
    given = docs.select([F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    column = f"c{docs.columns.index(text)}"
    plain = given.schema

    def looked_at(batches):
        for batch in B.cut_batches(batches, column, _PIECE):
            raw = W.text_bytes(batch.column(column))
            words = W.split_words(raw)
            yield batch, raw, words, W.hash_spans(raw.data, words.start, words.end)

    def cut_out(batches):
        """Rows with tiles; of equal texts in a batch only the first carries them."""
        for batch, raw, words, hashes in looked_at(batches):
            found: dict[int, list] = {}
            for row, tile in tiles(words, hashes):
                found.setdefault(row, []).append(tile)
            rows = sorted(found)
            keys = [hashlib.md5(raw.data[raw.offsets[r] : raw.offsets[r + 1]].tobytes(), usedforsecurity=False).digest() for r in rows]
            seen: set[bytes] = set()
            carried = [[] if k in seen or seen.add(k) else found[r] for r, k in zip(rows, keys, strict=True)]
            if rows:
                kept = batch.take(pa.array(rows))
                extra = [pa.array(words.counts[rows].astype(np.int64)), pa.array(keys, pa.binary()), pa.array(carried, tile_type)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *extra], names=[*kept.schema.names, "n_words", "run_key", "tiles"])

    def without(batches):
        for batch, _, words, hashes in looked_at(batches):
            free = np.ones(batch.num_rows, bool)
            for _, _, found in _found(words, hashes):
                free[found] = False
            extra = [pa.array(words.counts.astype(np.int64)), pa.array([[]] * batch.num_rows, run_type)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "n_words", "runs"]).filter(pa.array(free))

    def collapse(batches):
        for batch, raw, words, _ in looked_at(batches):
            gone = np.zeros(len(words.start), bool)
            for row, runs in enumerate(batch.column("runs").to_pylist()):
                first = words.first[row]
                for run in runs:
                    gone[first + run["start"] + run["period"] : first + run["start"] + run["length"]] = True
            removed = np.bincount(words.text[gone], minlength=batch.num_rows)
            text_of = substrings._cut_texts(batch.column(column), raw, words, gone, removed)
            yield B.with_columns(batch, {column: text_of}, batch.schema.names)

    tile_type = pa.list_(pa.struct([("octave", pa.int64()), ("offset", pa.int64()), ("boundary", pa.int64()), ("boundaries", pa.int32()), ("words", pa.binary())]))
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
    tiled = T.StructType([*plain.fields, own["n_words"], T.StructField("run_key", T.BinaryType()), T.StructField("tiles", T.ArrayType(T.StructType.fromDDL(TILE)))])
    marked = materialise(given.mapInArrow(cut_out, tiled), "tiles")
    # a tile is little data and much work, so their number of parts is not left to their size
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = marked.select("run_key", F.explode("tiles").alias("tile")).repartition(parts, "run_key", "tile.octave", "tile.offset")
    runs = materialise(_stitched(spread.mapInArrow(_solve, "run_key binary, period long, low long, high long")), "runs")
    # copies of one text may be a third of all rows: they meet their runs in several parts
    salted = runs.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    left = marked.drop("tiles").withColumn("salt", F.spark_partition_id() % SALTS)
    with_runs = left.join(salted.hint("merge"), ["run_key", "salt"], "left").select(*plain.fieldNames(), "n_words", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"))
    out_schema = T.StructType([*plain.fields, own["n_words"], own["runs"]])
    both = given.mapInArrow(without, out_schema).unionByName(with_runs.mapInArrow(collapse, out_schema))
    back = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return both.select([F.col(n if n in ("n_words", "runs") else back[n]).alias(n) for n in names])
