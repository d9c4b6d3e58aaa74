"""Benchmark contamination, found by one Aho-Corasick automaton over the test items.

The words of the items are numbered, and a number is two letters of the automaton, each of an
alphabet as large as the root of what there is to number: a window of 13 words is a pattern of 26 letters, and a
text is scanned as the string of its words' numbers. Words that no item has are a letter that is in no pattern.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docloom.llm import blocks as B
from docloom.llm import words as W
from docloom.session import materialise

#: Bytes that separate words once A-Z are lower-cased: all of ASCII but digits and letters.
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
NORMAL = W.byte_class(SEPARATORS)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Words of distinct windows that one automaton takes, as each is two nodes of some 50 bytes
#: at worst; windows beyond are scanned for in further passes.
PART_WORDS = 2 << 20
#: What a window, and an item that has it, takes besides nodes, as so many words.
_PATTERN, _OWNER = 8, 2
#: The letter of words that are in no item.
_GAP = 1
_PIECE = 2 << 20

Item = tuple[str, str]
FOUND = (
    ("n_words", T.LongType()),
    ("n_hit", T.LongType()),
    ("items", T.ArrayType(T.StringType())),
    ("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
    ("contaminated", T.BooleanType()),
)


class Normal:
    """A batch in normal form: the lower-cased bytes, the words' spans and their hashes."""

    def __init__(self, column: pa.Array):
        raw = W.text_bytes(column)
        self.raw = W.Text(LOWER[raw.data], raw.offsets)
        self.words = W.split_words(self.raw, NORMAL)
        self.hashes = W.hash_spans(self.raw.data, self.words.start, self.words.end)


def item_words(text: str) -> tuple[list[str], np.ndarray]:
    """Words of one text in normal form, and their hashes."""
    normal = Normal(pa.array([text], pa.string()))
    data = normal.raw.data.tobytes()
    return [data[a:b].decode() for a, b in zip(normal.words.start.tolist(), normal.words.end.tolist(), strict=True)], normal.hashes


def windows(hashes: np.ndarray, window: int) -> Iterator[bytes]:
    """Every window of an item's words, as its hashes; fewer words than a window, but not none, are one."""
    size = min(window, len(hashes))
    for k in range(len(hashes) - size + 1 if size else 0):
        yield hashes[k : k + size].tobytes()


def patterns(items: list[Item], window: int) -> dict[bytes, tuple[int, set[str]]]:
    """Windows of all items in normal form: number of words and items that have them."""
    out: dict[bytes, tuple[int, set[str]]] = {}
    for item, text in items:
        hashes = item_words(text)[1]
        for pattern in windows(hashes, window):
            out.setdefault(pattern, (min(window, len(hashes)), set()))[1].add(item)
    return out


def _string(numbers: np.ndarray, count: int) -> str:
    """Numbers of words (below ``count``; others are gaps) as two letters each, of alphabets of their own."""
    base = int(np.ceil(np.sqrt(count)))
    known = numbers < count
    first, second = np.where(known, numbers // base + _GAP + 1, _GAP), np.where(known, numbers % base + base + _GAP + 1, _GAP)
    return np.stack([first, second], axis=1).astype("<u4").tobytes().decode("utf-32-le")


_BUILT: dict[str, tuple] = {}


def _automaton(items: list[Item], window: int, digest: str) -> tuple:
    """The automaton, the hashes of its words in order of their numbers, words by pattern, and items by
    pattern; one is kept per process."""
    if digest not in _BUILT:
        _BUILT.clear()
        found = patterns(items, window)
        flat = np.frombuffer(b"".join(found), np.uint64)
        known, numbers = np.unique(flat, return_inverse=True)
        whole = _string(numbers, len(known))
        sizes = np.array([n for n, _ in found.values()], np.int64)
        ends = np.cumsum(sizes)
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
            machine.add_word(whole[2 * a : 2 * b], number)
        machine.make_automaton()
        owners = [sorted(names) for _, names in found.values()]
        _BUILT[digest] = (machine, known, sizes, owners)
    return _BUILT[digest]


def scan(column: pa.Array, machine, known: np.ndarray, sizes: np.ndarray, owners: list[list[str]]) -> tuple[Normal, np.ndarray, list[set[str]]]:
    """The batch in normal form, which words are hit, and the items found in each text."""
    normal = Normal(column)
    words, hashes = normal.words, normal.hashes
    items: list[set[str]] = [set() for _ in range(len(column))]
    hit = np.zeros(len(hashes), bool)
    if not len(sizes) or not len(hashes):
        return normal, hit, items
    rank = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    numbers = np.full(len(hashes) + len(column), len(known), np.int64)
    places = np.arange(len(hashes)) + words.text  # a gap ends every text
    numbers[places] = np.where(known[rank] == hashes, rank, len(known))
    found = list(machine.iter(_string(numbers, len(known))))
    if found:
        at, pattern = np.array(found, np.int64).T
        last = np.searchsorted(places, at // 2)
        size = sizes[pattern]
        steps = np.bincount(last - size + 1, minlength=len(hit) + 1) - np.bincount(last + 1, minlength=len(hit) + 1)
        hit = np.cumsum(steps[:-1]) > 0
        pairs = np.unique(np.stack([words.text[last], pattern]), axis=1)
        for row, which in pairs.T.tolist():
            items[row].update(owners[which])
    return normal, hit, items


def _parts(benchmark: DataFrame, id: str, text: str, window: int, most: int) -> Iterator[list[Item]]:
    """Items in lists whose distinct windows take at most ``most`` words (or that are one
    window), so that neither the driver nor an automaton ever holds them all.

    An item with more windows than a list has room for is cut; its pieces overlap by a
    window less one word, so that each window is in one piece.
    """
    held, seen, size = [], set(), 0
    for row in benchmark.select(id, text).toLocalIterator():
        if row[0] is None or row[1] is None:
            continue
        (words, hashes), low = item_words(row[1]), 0
        for k, pattern in enumerate(windows(hashes, window)):
            more = _OWNER + (0 if pattern in seen else len(pattern) // 8 + _PATTERN)
            if size and size + more > most:
                if k > low:
                    held.append((str(row[0]), " ".join(words[low : k - 1 + window])))
                yield held
                held, seen, size, low = [], set(), 0, k
                more = _OWNER + len(pattern) // 8 + _PATTERN
            seen.add(pattern)
            size += more
        if words:
            held.append((str(row[0]), " ".join(words[low:])))
    if held:
        yield held


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    share: int = 20,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    part_words: int = PART_WORDS,
) -> DataFrame:
    """Scan every text for windows of the test items.

    Adds ``n_words, n_hit`` (long: words, and words inside an occurrence of a window),
    ``items`` (sorted ids as strings), ``spans`` (begin and end of hit passages, in
    characters of the original text) and ``contaminated`` (some word is hit, and
    ``share`` times the hit words are all words or more). Columns with these names are
    replaced.

    Words are runs of digits, lower-cased letters and characters beyond ASCII. NULL and
    empty texts have no words and no hits. Items that are NULL, have a NULL id or no
    words are not looked for; equal ids count as one item. Without items nothing is
    hit. Texts are scanned once; distinct windows beyond ``part_words`` words of them are scanned for in
    further passes. Words are told apart by 64-bit hashes. Very long texts are scanned whole; of the items,
    one list and the words of one item at a time are held.
    """
    out = docs.select([c for c in docs.columns if c.lower() != "items"])
    bits = "_hit"
    while bits in {c.lower() for c in docs.columns}:
        bits += "_"
    parts = _parts(benchmark, item_id, item_text, window, part_words)
    items, number = next(parts, []), 0
    while True:
        following = next(parts, None)
        out = _pass(out, items, window, text, share, number == 0, following is None, bits)
        if following is None:
            return out.select(B.added(docs.schema, *FOUND).fieldNames())
        out, items, number = materialise(out, "scanned"), following, number + 1


def _pass(docs: DataFrame, items: list[Item], window: int, text: str, share: int, first: bool, last: bool, bits_name: str) -> DataFrame:
    """Look for ``items``; hits so far are carried along as bits per word in a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    digest = hashlib.sha256(repr((window, items)).encode()).hexdigest()
    schema = B.added(docs.schema, (bits_name, T.BinaryType()), FOUND[2])
    if last:
        schema = B.added(docs.drop(bits_name).schema, *FOUND)
    names = schema.fieldNames()

    def run(batches):
        built = _automaton(shared.value, window, digest)
        for batch in B.cut_batches(batches, text, _PIECE):
            normal, hit, found = scan(batch.column(text), *built)
            cuts = normal.words.first
            if not first:
                found = [x | set(y) for x, y in zip(found, batch.column("items").to_pylist(), strict=True)]
                for a, b, bits in zip(cuts[:-1], cuts[1:], batch.column(bits_name), strict=True):
                    hit[a:b] |= np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=int(b - a)).astype(bool)
            columns = {"items": pa.array([sorted(x) for x in found], pa.list_(pa.string()))}
            if last:
                columns |= _result(normal, hit, share)
            else:
                columns[bits_name] = pa.array([np.packbits(hit[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
            yield B.with_columns(batch, columns, names)

    return docs.mapInArrow(run, schema)


def _result(normal: Normal, hit: np.ndarray, share: int) -> dict[str, pa.Array]:
    """Counts, verdict, and the hit passages in characters of the original texts."""
    raw, words = normal.raw, normal.words
    n = words.counts.astype(np.int64)
    n_hit = np.bincount(words.text[hit], minlength=len(n)).astype(np.int64)
    spans: list[list] = [[] for _ in n]
    for row in np.flatnonzero(n_hit).tolist():
        a, b, low, high = words.first[row], words.first[row + 1], int(raw.offsets[row]), int(raw.offsets[row + 1])
        edges = a + np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8)))
        points = np.concatenate([[0], np.cumsum((raw.data[low:high] & 0xC0) != 0x80)])
        begin, end = points[words.start[edges[::2]] - low], points[words.end[edges[1::2] - 1] - low]
        spans[row] = [{"begin": x, "end": y} for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
    return {
        "n_words": pa.array(n),
        "n_hit": pa.array(n_hit),
        "spans": pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
        "contaminated": pa.array((n_hit > 0) & (share * n_hit >= n)),
    }
