"""Periodic runs, mixing and whitening against plain computations, and their edge rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import mixing, periods, queries, whitening


def plain_runs(words):
    """Every run, by comparing the words with themselves at every distance."""
    found = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - i + q
            if length >= max(6, 4 * q):
                found.setdefault((i, length), q)
            i = end
    return sorted((start, length, q) for (start, length), q in found.items())


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def made_texts(rng):
    texts = ["a " * 5, "a " * 6, "x " + "a b " * 4 + "a", "a " * 3000, "a b " * 1500 + "c", ("a " * 7 + "b ") * 300]
    for _ in range(120):
        texts.append(" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 120))))
    for _ in range(40):
        p, n = rng.randrange(1, 120), rng.randrange(10, 900)
        base = [rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(p)]
        words = [str(rng.random()) for _ in range(rng.randrange(0, 200))] + [base[i % p] for i in range(n)] + ["end"] * rng.randrange(0, 9)
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = "other"
        texts.append(" ".join(words))
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    texts.append(" ".join(word))
    nested = ["z"]
    for k in range(6):
        nested = nested * 4 + [f"w{k}"]
    texts.append(" ".join(nested))
    return texts


@pytest.mark.parametrize("tile_words", [60, periods.TILE_WORDS])
def test_runs_equal_plain_comparison(spark, monkeypatch, tile_words):
    monkeypatch.setattr(periods, "TILE_WORDS", tile_words)
    texts = made_texts(random.Random(tile_words))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    for row in periods.collapse_runs(docs).collect():
        words = texts[row.doc_id].split()
        want = plain_runs(words)
        assert [(r.start, r.length, r.period) for r in row.runs] == want, row.doc_id
        assert row.text.split() == collapsed(words, want) and row.n_words == len(words)
        if not want:
            assert row.text == texts[row.doc_id]


def test_extensions_are_the_plain_ones():
    rng = np.random.default_rng(5)
    for _ in range(200):
        pattern, text = rng.integers(0, 2, rng.integers(0, 30)), rng.integers(0, 2, rng.integers(0, 60))
        count = int(rng.integers(1, 40))
        pattern, text = np.repeat(pattern, rng.integers(1, 4)).astype(np.int32), np.repeat(text, rng.integers(1, 4)).astype(np.int32)

        def plain(i):
            k = 0
            while k < len(pattern) and i + k < len(text) and pattern[k] == text[i + k]:
                k += 1
            return k

        assert periods.extensions(pattern, text, count).tolist() == [plain(i) if i < len(text) else 0 for i in range(count)]


def test_runs_on_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "la " * 9), (4, "la " * 9), (4, "la " * 9), (5, "  " * 7 + "é"), (6, "new words only")]
    docs = spark.createDataFrame([(*r, "mine", 1, 2, "k", "s") for r in rows], "doc_id long, text string, runs string, n_words int, c0 int, run_key string, salt string")
    out = periods.collapse_runs(docs.repartition(3))
    assert out.columns == ["doc_id", "text", "c0", "run_key", "salt", "n_words", "runs"]
    found = sorted(((r.doc_id or 0), r.text, r.n_words, [tuple(x) for x in r.runs], r.c0, r.run_key, r.salt) for r in out.collect() if r.text is not None)
    extra = (2, "k", "s")
    assert found == sorted(
        [(2, "", 0, [], *extra), (3, " \n\t ", 0, [], *extra), (6, "new words only", 3, [], *extra), (5, "  é", 8, [(0, 7, 1)], *extra)]
        + [(k, "la ", 9, [(0, 9, 1)], *extra) for k in (0, 4, 4)]
    )
    nothing = out.where("text IS NULL").collect()
    assert [(r.doc_id, r.n_words, r.runs) for r in nothing] == [(1, 0, [])]
    assert periods.collapse_runs(docs.limit(0)).collect() == []


def test_a_very_long_text_of_one_word(spark):
    docs = spark.createDataFrame([(1, "go " * 200_000), (2, "stay " + "on and " * 100_000)], "doc_id long, text string")
    found = {r.doc_id: r for r in periods.collapse_runs(docs).collect()}
    assert [tuple(x) for x in found[1].runs] == [(0, 200_000, 1)] and found[1].text.split() == ["go"]
    assert [tuple(x) for x in found[2].runs] == [(1, 200_000, 2)] and found[2].text.split() == ["stay", "on", "and"]


def test_runs_by_tiles_of_a_long_planted_text(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(9000)]
    words = base[:4000] + [base[i % 2500] for i in range(30_000)] + base[4000:]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    row = periods.collapse_runs(docs).first()
    start, end = 4000, 34_000
    while start and words[start - 1] == words[start + 2499]:
        start -= 1
    while end < len(words) and words[end] == words[end - 2500]:
        end += 1
    assert (start, end - start, 2500) in [tuple(r) for r in row.runs]


def plain_mix(sizes, weights, budget, cap):
    """Targets by clamping the sources one after the other."""
    total = budget * sum(sizes.values())
    full = set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        weight = sum(weights[s] for s in sizes if s not in full)
        targets = {s: cap * sizes[s] if s in full else left * weights[s] / weight for s in sizes}
        over = {s for s in sizes if s not in full and targets[s] > cap * sizes[s]}
        if not over:
            return targets
        full |= over


def test_mix_equals_plain_water_filling(spark):
    rng = random.Random(1)
    rows = []
    for k in range(3000):
        source = rng.choice(["big"] * 12 + ["a", "b", "c", "é", "Z", None])
        rows.append((k, "w " * min(2000, int(rng.paretovariate(0.8) * 5)), source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    weights = mixing.cyclic_weights(docs.select("source"), (5, 2, 1))
    order = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    given = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    assert {r.source: r.weight for r in weights.collect()} == given
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in order}
    want = plain_mix(sizes, given, 1.5, 2)
    assert any(want[s] == 2 * sizes[s] for s in order) and any(want[s] < 2 * sizes[s] for s in order)
    first = mixing.mix_sources(docs, weights).collect()
    assert len(first) == len(rows)
    for s in order:
        mine = [r for r in first if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * want[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 1
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
        # whole repetitions, but for the row at the cut
        assert sum(r.taken % r.size > 0 for r in mine if r.size) <= 1
    again = mixing.mix_sources(docs.repartition(3), weights).collect()
    assert sorted(map(tuple, first), key=lambda r: r[0]) == sorted(map(tuple, again), key=lambda r: r[0])
    other = mixing.mix_sources(docs, weights, seed=1).collect()
    assert {(r.doc_id, r.taken) for r in other} != {(r.doc_id, r.taken) for r in first}


def test_many_sources_are_joined_in_parts(spark, monkeypatch):
    docs = spark.range(500).selectExpr("id AS doc_id", "repeat('w ', cast(id % 7 as int)) AS text", "nullif(concat('s', id % 11), 's3') AS source")
    weights = mixing.cyclic_weights(docs.select("source"), (5, 2, 1))
    few = mixing.mix_sources(docs, weights).collect()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix_sources(docs, weights).collect())) == sorted(map(tuple, few)) if all(r.source for r in few) else True
    assert {(r.doc_id, r.taken) for r in mixing.mix_sources(docs, weights).collect()} == {(r.doc_id, r.taken) for r in few}


def test_mix_of_equal_rows_nulls_and_nothing(spark):
    rows = [(None, "a b c", "s")] * 300 + [(7, "d e", "s")] * 100 + [(k, "", "empty") for k in range(5)] + [(k, None, None) for k in range(5)] + [(1, "x " * 900, "t")]
    docs = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, source string, size int, taken string")
    weights = mixing.cyclic_weights(docs.select("source"), (1,))
    out = mixing.mix_sources(docs, weights, budget=0.7).collect()
    assert len(out) == len(rows)
    for s in ("s", "t"):
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= len(mine)
    assert all(r.taken == 0 and r.size == 0 for r in out if r.source in (None, "empty"))
    assert all(r.taken == 2 * r.size for r in mixing.mix_sources(docs, weights, budget=9).collect())
    assert mixing.mix_sources(docs.limit(0), weights).collect() == []
    assert mixing.mix_sources(docs, weights.limit(0)).agg(F.sum("taken")).first()[0] == 0


def test_mixing_uses_no_python_workers(spark, directory):
    plan = queries.op12_mixing(spark, directory)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_whitening(vectors, components):
    x = np.floor(256 * np.array(vectors, np.float64))
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    values, columns = np.linalg.eigh(centred.T @ centred / len(fit))
    order = np.argsort(-values)[:components]
    return (x - fit.mean(axis=0)) @ columns[:, order] / np.sqrt(values[order]), values[order] / values.sum(), fit


@pytest.mark.parametrize("scale", [1.0, 300.0, 1e7])
def test_whitening_equals_eigenvectors(spark, scale):
    rng = np.random.default_rng(int(scale))
    data = (rng.normal(size=(400, 9)) * np.logspace(0, -2, 9) * scale + rng.normal(size=9)).astype(np.float32)
    data = np.concatenate([data, np.repeat(data[:1], 600, axis=0)])
    table = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(data)], "vec_id long, embedding array<float>").repartition(6)
    out = whitening.whiten(table).collect()
    want, share, fit = plain_whitening(data, 4)
    got = np.zeros((len(data), 4))
    sums, n = fit.astype(object).sum(axis=0), len(fit)
    for r in out:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and abs(r.explained - share[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < 1e-6
    for r in out[:40]:
        x = [int(c) for c in np.floor(256 * data[r.vec_id].astype(np.float64))]
        exact = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        assert r.deviation == (exact if exact < 2**63 else None)


def test_whitening_on_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [1.0, -inf]), (6, [1.0]), (None, [1.0, 2.0]), (8, [-0.0, 0.0]), (8, [0.0, 0.0]), (9, [3.0, 5.0]), (10, [3e38, 0.0])]
    table = spark.createDataFrame([(k, v, 7, "m") for k, v in rows], "vec_id long, embedding array<double>, n int, whitened string").repartition(4)
    out = whitening.whiten(table).collect()
    assert sorted((r.vec_id or 0, r.component) for r in out) == sorted([(k, c) for k in (0, 8, 8, 9, 10) for c in (1, 2)])
    assert {r.n for r in out} == {4}
    flat = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 4.0]), (3, [1.0, 2.0, 6.0])], "vec_id long, embedding array<float>")
    flat = {(r.vec_id, r.component): r for r in whitening.whiten(flat).collect()}
    assert flat[1, 1].explained == pytest.approx(1) and flat[1, 2].whitened is None and flat[1, 2].explained == 0
    assert flat[1, 1].identity_error < 1e-12 and len(flat) == 9
    one = whitening.whiten(table.where("vec_id = 9")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, None)] * 2
    assert whitening.whiten(table.limit(0)).collect() == [] and whitening.whiten(table.where("vec_id < 3")).collect() == []
    assert whitening.whiten(table.limit(0)).columns == whitening.whiten(table).columns


def test_packed_vectors_come_back():
    x = np.array([[0, -1], [32767, -32768], [32768, 0], [-(2**31), 5], [2**31, 1], [2**62, -(2**62)]])
    out = np.concatenate([whitening.unpack(a, 2) for a in whitening.pack(x)])
    assert sorted(map(tuple, out.tolist())) == sorted(map(tuple, x.tolist()))


def test_planted_runs_follow_the_rule(spark, directory):
    import zlib

    docs = spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "text")
    given = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.with_planted_runs(docs).collect():
        words = given[r.doc_id].split()
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 or not words:
            assert r.text == given[r.doc_id]
            continue
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert r.text.split(" ") == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_digests_are_those_of_the_words(spark, directory):
    docs = spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: (r.text or "").split() for r in queries.with_planted_runs(docs).collect()}
    for r in queries.op11_periodic_runs(spark, directory).collect():
        runs = plain_runs(texts[r.doc_id]) if len(texts[r.doc_id]) < 700 else None
        if runs is not None:
            lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
            assert r.n_runs == len(runs) and r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
            assert r.collapsed_sha256 == hashlib.sha256(" ".join(collapsed(texts[r.doc_id], runs)).encode()).hexdigest()
            best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
            assert (r.start, r.length, r.period) == best
