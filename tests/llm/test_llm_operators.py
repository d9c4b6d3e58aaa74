"""Operators against brute force, round trips and held-out rows."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import backoff, contamination, neardup, pages, quality, queries, repetition, sequences, sharding, substrings, urls
from docloom.session import read_table


@pytest.fixture(scope="module")
def documents(spark, directory):
    return {r.doc_id: r.text for r in read_table(spark, directory, "documents").collect()}


def collected(frame, key="doc_id"):
    return {r[key]: r for r in frame.collect()}


# sharding


def test_shards_are_balanced_and_numbered(spark, documents, directory):
    rows = queries.QUERIES["op1_sharding"](spark, directory).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    by_shard = collections.defaultdict(list)
    for r in rows:
        data = documents[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        by_shard[r.shard].append(r)
    assert set(by_shard) <= set(range(40))
    for held in by_shard.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    sizes = [sum(r.size for r in by_shard[k]) for k in range(40)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)


def test_equal_texts_share_a_shard_unless_they_fill_it(spark):
    rows = [(i, f"text {i // 3} " + "x" * 40, "en", f"s{i % 7}") for i in range(3000)] + [(10_000 + i, "hot " * 12, "de", "hot") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = sharding.shard_documents(docs, shards=10).collect()
    sizes, shards = collections.Counter(), collections.defaultdict(set)
    for r in out:
        sizes[r.shard] += r.size
        shards[r.text_crc32].add(r.shard)
    assert max(sizes.values()) < 1.03 * min(sizes.values())
    assert sum(len(s) > 1 for s in shards.values()) == 1  # the hot text


def test_target_bytes(spark):
    docs = spark.createDataFrame([(i, "y" * 84) for i in range(1000)], "doc_id long, text string")
    sizes = collections.Counter()
    for r in sharding.shard_documents(docs, target_bytes=10_000).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 10 and max(sizes.values()) <= 11_000


# substring dedup


def test_difference_cover_meets_every_pair_of_positions():
    for i in range(substrings.PERIOD):
        for j in range(substrings.PERIOD):
            assert any(substrings.COVER[(i + d) % 7] and substrings.COVER[(j + d) % 7] for d in range(7))


@pytest.mark.parametrize("block_bytes", [300, 1 << 20])
def test_repeats_across_small_blocks(spark, block_bytes):
    rng = np.random.default_rng(5)
    passages = [[f"p{k}w{i}" for i in range(30)] for k in range(4)]
    texts = []
    for _ in range(60):
        words = [f"r{x}" for x in rng.integers(0, 40, 20)]
        for k in rng.integers(0, 4, 2):
            at, cut = rng.integers(0, len(words)), rng.integers(0, 18)
            words[at:at] = passages[k][cut : cut + rng.integers(11, 20)]
        texts.append(" \n".join(words) + "  ")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = collected(substrings.remove_repeats(docs, block_bytes=block_bytes))
    owner: dict = {}
    split = [t.split() for t in texts]
    for d, words in enumerate(split):
        for i in range(len(words) - 12):
            owner.setdefault(tuple(words[i : i + 13]), d)
    for d, words in enumerate(split):
        gone = {i + k for i in range(len(words) - 12) if owner[tuple(words[i : i + 13])] < d for k in range(13)}
        assert out[d].text.split() == [w for i, w in enumerate(words) if i not in gone]
        assert (out[d].n_words, out[d].n_removed) == (len(words), len(gone))
        if not gone:
            assert out[d].text == texts[d]


# near duplicates


def bag(text):
    words = (text or "").split()
    if len(words) < 5:
        return collections.Counter([tuple(words)] if words else [])
    return collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def groups(texts):
    """Group (smallest id) of each text by comparing all pairs."""
    ids, parent = sorted(texts), {i: i for i in texts}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = {i: bag(t) for i, t in texts.items()}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = sum((bags[i] & bags[j]).values())
            if (texts[i] or "") == (texts[j] or "") or (both and 5 * both >= 4 * (bags[i].total() + bags[j].total() - both)):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_near_duplicates_of_documents(spark, documents, directory):
    out = collected(queries.QUERIES["op3_near_duplicates"](spark, directory))
    assert {i: r.class_id for i, r in out.items()} == groups(documents)


def test_near_duplicate_chains_and_multisets(spark):
    """Copies that are similar to others only through their neighbours, and texts that
    differ in how often they repeat a sentence."""
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 900, 120)]
    texts, words = {}, list(base)
    for i in range(40):
        texts[i] = " ".join(words)
        words[(i * 29) % 120] = f"n{i}"
    sentence = "one two three four five six seven "
    for k, times in enumerate((1, 2, 9, 10, 11, 30)):
        texts[100 + k] = sentence * times
    texts |= {200: "a b c", 201: "a  b\nc", 202: "a b", 203: "", 204: " ", 205: None, 206: "a b c d"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    out = collected(neardup.near_duplicates(docs))
    want = groups(texts)
    assert {i: out[i].class_id for i in texts} == want
    assert out[39].class_id == 0 and out[205].copy_of == 203


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 2**63, 60, dtype=np.uint64)
    left, right = rng.integers(0, 50, 60), rng.integers(0, 50, 60)
    text = np.concatenate([np.zeros(60, int), np.ones(60, int)])
    count = np.concatenate([left, right])
    some = count > 0
    times = neardup.bag_signatures(text[some], np.concatenate([keys, keys])[some], count[some], 2, 4096)
    true = np.minimum(left, right).sum() / np.maximum(left, right).sum()
    assert abs((times[0] == times[1]).mean() - true) < 0.03


def test_components_of_chains_stars_and_cliques(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(100, 170)] + [(0, i) for i in range(1, 40)] + [(i, j) for i in range(50, 60) for j in range(50, i)]
    order = rng.permutation(300)
    links += [(int(order[i]) + 1000, int(order[i + 1]) + 1000) for i in range(150)] + [(7, 7)]
    out = {r.node: r.label for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    chain = min(order[:151]) + 1000
    want = {i: 100 for i in range(100, 171)} | {i: 0 for i in range(40)} | {i: 50 for i in range(50, 60)} | {int(x) + 1000: int(chain) for x in order[:151]}
    assert out == want
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("parts,texts", [(32, 250), (32, 7), (2, 7), (0, 7)])
def test_all_ways_through_a_cluster_agree(spark, monkeypatch, parts, texts):
    """Whole clusters, clusters in blocks, and clusters that go by buckets."""
    monkeypatch.setattr(neardup, "PARTS", parts)
    monkeypatch.setattr(neardup, "PART_TEXTS", texts)
    rng = np.random.default_rng(8)
    made = {}
    for k in range(60):
        words = [f"f{k % 3}w{i}" for i in range(150)]
        for at in rng.integers(0, 150, rng.integers(0, 10)):
            words[at] = f"x{k}a{at}"
        made[k] = " ".join(words)
    out = collected(neardup.near_duplicates(spark.createDataFrame(list(made.items()), "doc_id long, text string")))
    assert {i: r.class_id for i, r in out.items()} == groups(made)


def test_blocks_of_a_large_bucket_are_bounded(spark, monkeypatch):
    """No task gets a whole bucket of small groups, and all pairs of different groups meet."""
    monkeypatch.setattr(neardup, "PART_TEXTS", 5)
    name = {i: 0 if i < 100 else i for i in range(300)} | {i: 300 + i % 7 for i in range(300, 340)}
    keys = {7: range(300), 8: range(300), 9: range(280, 340)}
    buckets = spark.createDataFrame([(k, i) for k, held in keys.items() for i in held], "key long, doc long")
    members = spark.createDataFrame([(i, 0, 100) for i in name], "doc long, cluster long, size long")
    labels = spark.createDataFrame([x for x in name.items() if x[0] < 100 or x[0] >= 300], "node long, label long")
    blocks = collections.defaultdict(list)
    for r in neardup._blocks(buckets, members, labels).collect():
        assert r.name == name[r.doc]
        blocks[r.cluster, r.key, r.left, r.right].append((r.doc, r.part))
    assert max(map(len, blocks.values())) <= 90  # two parts of about 20
    met = set()
    for held in blocks.values():
        one = len({p for _, p in held}) == 1
        met |= {(a, b) for a, p in held for b, q in held if a < b and name[a] != name[b] and (one or p != q)}
    assert met >= {(a, b) for held in keys.values() for a in held for b in held if a < b and name[a] != name[b]}


def test_template_family_in_small_blocks(spark, monkeypatch):
    """Texts of one template of which most are just not similar enough."""
    monkeypatch.setattr(neardup, "PARTS", 0)
    monkeypatch.setattr(neardup, "PART_TEXTS", 3)
    rng = np.random.default_rng(9)
    made = {}
    for k in range(120):
        words = [f"w{i}" for i in range(150)]
        for at in rng.integers(0, 150, int(rng.integers(2, 6))):
            words[at] = f"x{k}a{at}"
        made[k] = " ".join(words)
    out = collected(neardup.near_duplicates(spark.createDataFrame(list(made.items()), "doc_id long, text string")))
    want = groups(made)
    assert {i: out[i].class_id for i in made} == want and 5 < len(set(want.values())) < 115


# pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><a href="/">Site</a></header><div class="cookie-notice">We use cookies</div><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div id="wrap"><main><article class="post-%d"><h1>A &amp; B</h1><p>First <b>bold</b>text,&nbsp;two.<br>next<p>Second a < b
<div class="ad-box">Buy!</div><ul><li>one<li>two</ul><script>var x = "<p>no</p>";</script><!-- no -->
<form><input name="q"><button>Go</button></form></article>
<section id="comments"><p>%s</p></section></main><aside class="sidebar"><p>Side</p></aside></div>
<footer>&copy; Site</footer></body>"""
WANT = "A & B First boldtext, two. next Second a < b one two"


def test_main_text_of_a_rich_page(spark):
    rows = [(i, f"http://h.test/{i}", PAGE % (i, "long comment " * 80)) for i in range(5)]
    rows += [
        (10, None, None),
        (11, "x", ""),
        (12, "http://h.test/z", "plain text only"),
        (13, "http://other.test/", "<p>cut off <b>here</b> <a href='x"),
        (14, "http://other.test/", "<!-- never closed"),
        (15, "http://h.test/only", "<body><div><p>Another layout with words</p></div></body>"),
        (16, "http://parts.test/", "<article><section><p>" + "long part " * 30 + "</p></section><section><p>short part</p></section></article>"),
        (17, "http://divs.test/", "<div id=c><DIV><P>" + "some words " * 9 + "</DIV><div><p>more words here, and as many again<pre>a\n  b</pre></div></div><div class='Main-Sidebar'>x</div>"),
        (18, "http://kept.test/", "<article class=x><h1>T</h1><div><p>one<table><tr><td>c1<td>c2</table><blockquote>q</blockquote><ol class=commentlist><li>no</ol></div></article>"),
    ]
    table = spark.createDataFrame([(*r, "mine", "old") for r in rows], "page_id long, url string, html string, path string, text string")
    out = collected(pages.extract_pages(table), "page_id")
    assert len(out) == len(rows) and out[0].path.endswith("main>article.post-0")
    assert all(out[i].text == WANT for i in range(5))
    assert out[16].text == ("long part " * 30).strip() + " short part"
    assert out[17].text == "some words " * 9 + "more words here, and as many again a b"
    assert out[18].text == "T one c1 c2 q"
    assert [out[i].text for i in (10, 11, 12, 13, 14, 15)] == ["", "", "plain text only", "cut off here", "", "Another layout with words"]


def test_consensus_beats_a_page_with_long_extras(spark):
    """A page whose own best container is something else follows its host."""
    usual = "<body><div class=text><p>{}</p></div><div class=extra><p>{}</p></div></body>"
    rows = [(i, "http://h.test/", usual.format("word " * 50, "x")) for i in range(4)] + [(9, "http://h.test/", usual.format("short", "much longer " * 40))]
    out = collected(pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert out[9].text == "short"


def test_smaller_layout_of_a_host_keeps_its_article(spark):
    """A winning path of plain tags, or beside the article, that holds little of the page."""
    long = "long text " * 40
    rows = [(i, "http://h.test/", f"<body><div><p>{long}</p></div></body>") for i in range(6)]
    rows += [(10 + i, "http://h.test/", f"<body><div><p>Tip of the day</p></div><article>{long}</article></body>") for i in range(2)]
    rows += [(20 + i, "http://n.test/", f"<body><div class=text><p>{long}</p></div></body>") for i in range(6)]
    rows += [(30, "http://n.test/", f"<body><div class=text><p>Tip of the day</p></div><main><p>{long}</p></main></body>")]
    out = collected(pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert {r.text for r in out.values()} == {long.strip()}


@pytest.mark.parametrize("name", ["class='content-with-sidebar'", "class='layout-sidebar-left'", "class='page-header-fixed'", "class='post-share-enabled'", "id='register-guide'"])
def test_wrappers_with_noise_words_keep_their_text(name):
    """Names of wrappers say how a page is laid out; small parts and comments still go."""
    article, rest = "<h1>Title</h1><p>" + "some words " * 30 + "</p>", "<div class=sidebar><p>Side</p></div><div class='ad box'>Buy</div>"
    want = "Title " + ("some words " * 30).strip()
    for page in (f"<div {name}><div>{article}</div>{rest}</div>", f"<div {name}><article>{article}</article>{rest}</div><div id=comments><p>{'long comment ' * 99}</p></div>"):
        nodes, blocks = pages.parse(f"<body>{page}<p>By us</p></body>")
        assert [b.text for b in blocks] == [*(want[:5], want[6:]), "By us"]


LONG = "some long words " * 30


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<body><form id=f><div><article><p>{LONG}</p></article><p><input name=q><button>Go</button></p></div></form></body>", LONG),
        (f"<body><form><p>{LONG}</p></form></body>", LONG),
        (f"<body><article><p>{LONG}</p></article><form><p>{LONG} {LONG}</p></form></body>", LONG),
        (f"<body><a name=top><div><article><p>{LONG}</p><p><a id=x>More</p></article></div></body>", f"{LONG} More"),
        (f"<body><div><p><a href=/x>All {LONG}</a></p></div></body>", f"All {LONG}"),
        (f"<body><a href=/x>Home<a href=/y>Up<div class=t><p>{LONG}</p></div></body>", LONG),
        (f"<my-content class='post-header'><article><p>{LONG}</p></article></my-content>", LONG),
        (f"<div class=text class=comments><p>{LONG}</p></div>", LONG),
        (f"<p>AT&<b>lt;</b> {LONG}</p>", f"AT&lt; {LONG}"),
        (f"<body><div class=text><p>{LONG}</p></div><section class=reviews><p>{LONG}</p></section></body>", LONG),
    ],
)
def test_main_text_of_unusual_pages(page, want):
    nodes, blocks = pages.parse(page)
    assert pages.text_in(nodes, blocks, pages.best_container(nodes, blocks)).split() == want.split()


def test_smaller_layout_under_a_named_path_keeps_its_text(spark):
    """The host's path is there with a line, the text is elsewhere; extras do not take its place."""
    rows = [(i, f"<body><div class=tip><p>{LONG}</p></div><div class=extra><p>x</p></div></body>") for i in range(6)]
    rows += [(10, f"<body><div class=tip><p>Tip of the day</p></div><div><p>{LONG}</p></div></body>")]
    rows += [(11, f"<body><div class=tip><p>short</p></div><div class=extra><p>{LONG}</p></div></body>")]
    table = spark.createDataFrame([(i, "http://h.test/", p) for i, p in rows], "page_id long, url string, html string")
    out = collected(pages.extract_pages(table), "page_id")
    assert {out[i].text for i in (*range(6), 10)} == {LONG.strip()} and out[11].text == "short"


def test_deep_pages_take_little_time_and_memory():
    import time
    import tracemalloc

    deep = "<div class=a>" * 50_000 + f"<p>{LONG}</p>" + "</div>" * 25_000 + "<p>end</p>"
    tracemalloc.start()
    start = time.monotonic()
    nodes, blocks = pages.parse(deep)
    best = pages.best_container(nodes, blocks)
    assert pages.text_in(nodes, blocks, best).split() == LONG.split()
    assert time.monotonic() - start < 20 and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_pages_on_edge_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "", ""), (2, "http://h.test/" + "x" * 100_000, f"<p>{LONG * 2000}</p>"), (3, "http://h.test/", "<p>a</p>")]
    schema = "page_id long, url string, html string, _paths int, _host int, _html int, host string, tried int, key int, path int, text string"
    table = spark.createDataFrame([(*r, 1, 2, 3, "mine", 4, 5, 6, "old") for r in rows], schema).repartition(3)
    out = pages.extract_pages(table)
    assert out.columns == ["page_id", "url", "_paths", "_host", "_html", "host", "tried", "key", "text", "path"]
    found = out.collect()
    assert sorted((r.page_id or 0, len(r.text)) for r in found) == [(0, 0), (1, 0), (1, 0), (2, len((LONG * 2000).strip())), (3, 1)]
    assert {(r._paths, r._host, r._html, r.host, r.tried, r.key) for r in found} == {(1, 2, 3, "mine", 4, 5)}
    assert pages.extract_pages(table.limit(0)).collect() == []


def test_pages_of_the_tables(spark, directory):
    import html
    import re

    raw = collected(read_table(spark, directory, "pages"), "page_id")
    out = collected(queries.QUERIES["op4_html_extraction"](spark, directory), "page_id")
    for i, page in raw.items():
        body = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", body).replace("<h1>", " ").replace("</h1>", " ").replace("<p>", " ").replace("</p>", " ").replace("<br>", " ")).split())
        assert (out[i].text, out[i].n_chars) == (want, len(want))


# quality


def test_quality_on_held_out_rows(spark):
    directory = "/root/testdata/sf0.01"
    scores = collected(queries.QUERIES["op5_quality_classifier"](spark, directory))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in scores.items())
    labels = [(r.quality, scores[r.doc_id].predicted) for r in read_table(spark, directory, "labels").collect() if scores[r.doc_id].held_out]
    assert sum(a == b for a, b in labels) > 0.95 * len(labels)


# packing


def test_quality_scores_equal_a_plain_discriminant(spark, directory):
    """Scores from moments, inverses and determinants that numpy works out over all rows at once."""
    docs, labels = (read_table(spark, directory, n) for n in ("documents", "labels"))
    rows = docs.collect()
    values = quality.statistics(pa.array([r.text for r in rows], pa.string()))
    label = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and r.doc_id % 3}
    known = np.array([label.get(r.doc_id, -1) for r in rows])
    own = {k: values[known == k] for k in (0, 1)}
    plain = {k: np.cov(v, rowvar=False, bias=True) for k, v in own.items()}
    pooled = sum(len(own[k]) * plain[k] for k in own) / sum(map(len, own.values()))
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    logs = []
    for k in (0, 1):
        c = (1 - quality.POOLED) * plain[k] + quality.POOLED * pooled
        c = c / np.outer(scale, scale)
        c = (1 - quality.ROUND) * c + quality.ROUND * max(np.trace(c) / len(c), 1e-3) * np.eye(len(c))
        z = (values - own[k].mean(axis=0)) / scale
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z) - 0.5 * np.linalg.slogdet(c)[1])
    prior = (len(own[1]) + 1) / (len(own[0]) + len(own[1]) + 2)
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + np.log(prior / (1 - prior)), -500, 500)))
    got = {r.doc_id: r.score for r in quality.score_quality(docs, labels, F.col("doc_id") % 3 != 0).collect()}
    assert max(abs(got[r.doc_id] - w) for r, w in zip(rows, want, strict=True)) < 1e-6


def test_packing_gives_all_tokens_back(spark, documents, directory):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary())
    docs = read_table(spark, directory, "documents")
    pieces = sequences.pack_sequences(docs, queries.vocabulary).collect()
    digests = collections.Counter((r.doc_id, r.start, r.ids_crc32) for r in queries.QUERIES["op7_packing"](spark, directory).collect())
    assert digests == collections.Counter((r.doc_id, r.start, zlib.crc32(r.ids)) for r in pieces)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        assert len(r.ids) == 4 * r.length > 0
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(documents)
    for doc, held in by_doc.items():
        held.sort(key=lambda r: r.start)
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in held), "<u4").tolist()
        assert ids == tokenizer.encode(documents[doc], add_special_tokens=False).ids + [1]
        assert all(r.doc_tokens == len(ids) for r in held)
        assert [r.start for r in held] == np.cumsum([0, *(r.length for r in held)])[:-1].tolist()
    padded = total = 0
    for held in by_sequence.values():
        held.sort(key=lambda r: r.offset)
        used = sum(r.length for r in held)
        assert [r.offset for r in held] == np.cumsum([0, *(r.length for r in held)])[:-1].tolist()
        assert used <= held[0].tier <= 2048 and len({r.step_id for r in held}) == 1
        padded += 0 if used & (used - 1) == 0 else 2048 - used
        total += used
    assert padded <= max(2048, 0.02 * total)


@pytest.mark.parametrize("sizes", [[], [1], [2048], [2049], [5000, 3, 700], [1500] * 9, [256, 255, 257, 1, 1, 1], list(range(1, 300))])
def test_arranged_windows_hold_everything_once(sizes):
    windows = sequences.arrange(sizes)
    seen = collections.Counter((d, s + k) for _, pieces in windows for d, s, n in pieces for k in range(n))
    assert seen == collections.Counter((d, k) for d, n in enumerate(sizes) for k in range(n))
    open_windows = [w for t, w in windows if sum(n for *_, n in w) not in sequences.TIERS]
    assert len(open_windows) <= 1


def test_words_are_encoded_as_whole_texts_are():
    texts = [
        "", "a", "İstanbul İ É́", "foo<|endoftext|>bar", "it's we're THE'S o'clock's", "é, x", "!!,. ,a, ,", "12,34 5.", "\x1c x\x85y z",
        "Σας ΟΔΟΣ", "ÀÉÑÖ! é, ñ.", "a b", "\tx\n\r y", "漢字,かな。", "<|ENDOFTEXT|>", "ß ẞ ſ K", "aͅ,", "x×y÷z, q’s", "é,", "word### $$$|", "x" * 5000,
    ]
    encode = sequences.Encoder(queries.vocabulary())
    want = [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encode.ids(pa.array([*texts, None])) == [*want, b""]


# decontamination


def test_short_items_spans_and_parts(spark):
    items = [("s", "Short item!"), ("long", " ".join(f"w{i}" for i in range(20))), ("long", "again other"), ("none", "!!"), (None, "never"), ("null", None)]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    text = "É, SHORT--item and " + ", ".join(f"W{i}" for i in range(2, 17)) + " end again-other"
    docs = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "", 5), (4, "item short", 5)], "doc_id long, text string, n_hit int")
    for part in (8 << 20, 1):
        out = collected(contamination.find_contamination(docs, benchmark, part_words=part))
        assert out[1]["items"] == ["long", "s"] and (out[1].n_words, out[1].n_hit, out[1].contaminated) == (22, 19, True)
        assert [text[s.begin : s.end] for s in out[1].spans] == ["SHORT--item", text[text.index("W2") : text.index(" end")], "again-other"]
        assert [(out[i].n_words, out[i].n_hit, out[i]["items"], out[i].contaminated) for i in (2, 3, 4)] == [(0, 0, [], False)] * 2 + [(2, 0, [], False)]
    assert collected(contamination.find_contamination(docs, benchmark.limit(0)))[1].n_hit == 0


def normal_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_brute_force(texts, items, window=13):
    """n_words, n_hit and items of every text."""
    wanted = collections.defaultdict(set)
    for item, text in items:
        words = normal_words(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            wanted[tuple(words[k : k + size])].add(item)
    out = {}
    for doc, text in texts.items():
        words, hit, found = normal_words(text), set(), set()
        for size in {len(w) for w in wanted}:
            for k in range(len(words) - size + 1):
                if names := wanted.get(tuple(words[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= names
        out[doc] = (len(words), len(hit), sorted(found))
    return out


def test_words_with_any_byte_are_found(spark):
    """Bytes 0x85 and 0xA0 of letters beyond ASCII, which are white space in latin-1."""
    rng = np.random.default_rng(6)
    pool = ["voilà", "déjà", "Åre", "ąŠ", "хорошо", "Работа", "a\u00a0b", "x\u0085y", "中文字", "酅栠", "ok", "End", "9"]
    long = [[pool[k] for k in rng.integers(0, len(pool), 25)] for _ in range(6)]
    items = [(f"i{k}", " ".join(words)) for k, words in enumerate(long)]
    items += [("fr", "voilà déjà à"), ("ru", "хорошо, Работа!"), ("nbsp", "\u00a0"), ("cjk", "酅栠 中文字"), ("nel", "x\u0085y ok"), ("none", " .\n")]
    texts = {k: " ".join(pool[i] for i in rng.integers(0, len(pool), 9)) + ". " + "-".join(long[k % 6][k % 9 : k % 9 + 15]) + " à " + "\u00a0" * (k % 2) for k in range(30)}
    texts |= {50: "voil d j", 51: "Voilà: déjà -à", 52: "хорошо Работа", 53: "酅栠\n中文字", 54: None, 55: "\u00a0"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = collected(contamination.find_contamination(docs, spark.createDataFrame(items, "item_id string, text string")))
    assert {i: (r.n_words, r.n_hit, r["items"]) for i, r in out.items()} == by_brute_force(texts, items)
    assert out[51]["items"] == ["fr"] and out[52]["items"] == ["ru"] and out[55]["items"] == ["nbsp"]


def test_parts_are_bounded_by_their_patterns(spark):
    """No automaton gets more than its words of windows, an item longer than a part is cut,
    and all parts together find what brute force does."""
    rng = np.random.default_rng(7)
    words = [[f"wört{x}" for x in rng.integers(0, 10**6, n)] for n in (300, 40, 13, 12, 2)]
    items = [(f"i{k}", " ".join(w)) for k, w in enumerate(words)] + [("copy", " ".join(words[1]))]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    most = 1500
    parts = [contamination.patterns(part, 13) for part in contamination._parts(benchmark, "item_id", "text", 13, most)]
    assert len(parts) > 4 and all(sum(n for n, _ in part.values()) <= most for part in parts)
    whole = collections.Counter((p, size, item) for p, (size, names) in contamination.patterns(items, 13).items() for item in names)
    assert collections.Counter((p, size, item) for part in parts for p, (size, names) in part.items() for item in names) == whole
    texts = {k: " ".join(["x", *words[k % 5][k : k + 14], "y", *words[0][40 * k : 40 * k + 50]]) for k in range(8)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = collected(contamination.find_contamination(docs, benchmark, part_words=most))
    assert {i: (r.n_words, r.n_hit, r["items"]) for i, r in out.items()} == by_brute_force(texts, items)


def test_an_item_of_many_different_words(spark):
    """Numbers of two digits; words of other items, and gaps, lie between."""
    words = [f"w{k}" for k in range(30_000)]
    items = [("i", " ".join(words)), ("j", "w7 w8 w9")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    texts = {1: " ".join(words[24_990:25_030]), 2: " ".join(words[5:17]) + " w18", 3: " ".join(words[29_980:]), 4: " ".join(words[9:14] + ["x"] + words[14:26])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert len(list(contamination._parts(benchmark, "item_id", "text", 13, contamination.PART_WORDS))) == 1
    out = collected(contamination.find_contamination(docs, benchmark))
    assert {i: (r.n_words, r.n_hit, r["items"]) for i, r in out.items()} == {1: (40, 40, ["i"]), 2: (13, 3, ["j"]), 3: (20, 20, ["i"]), 4: (18, 0, [])}


# LM scores


def test_scores_with_small_blocks(spark, directory):
    docs = read_table(spark, directory, "documents").limit(60)
    rows = docs.collect()
    frame = spark.createDataFrame(rows, docs.schema)
    one, many = (collected(backoff.score_documents(frame, block_bytes=n)) for n in (1 << 24, 5000))
    assert {i: (r.n_order_3, r.n_order_2, round(r.log_score, 6)) for i, r in one.items()} == {i: (r.n_order_3, r.n_order_2, round(r.log_score, 6)) for i, r in many.items()}


# addresses


def test_rules_and_model(spark):
    rows = [
        (1, "http://A.Example.ORG/es/x?y", "example.org/es/", "block"),
        (2, "https://x.org/", "org/", "allow"),
        (3, "https://library.org", None, "allow"),
        (4, "http://m.example.org/en/12", "example.org/en/1", "block"),
        (5, "http://notexample.org/es/", "org/", "allow"),
        (6, "http://a.com/de/1#x", "com/de/", "block"),
        (7, "http://www.casino-win.example.net/en/7", None, "block"),
        (8, "http://therin.example.net/en/7", None, "allow"),
        (9, None, None, "allow"),
        (10, "no address", None, "allow"),
    ]
    table = spark.createDataFrame([(i, u, "x") for i, u, _, _ in rows], "page_id long, url string, Verdict string")
    out = collected(urls.filter_urls(table), "page_id")
    assert {i: (out[i].rule, out[i].verdict) for i, *_ in rows} == {i: (rule, verdict) for i, _, rule, verdict in rows}
    assert (out[1].host, out[1].path) == ("a.example.org", "/es/x") and (out[3].host, out[3].path) == ("library.org", "")
    assert (out[9].host, out[9].path, out[10].host) == ("", "", "")
    model = urls.UrlModel.train(urls.small_table())
    hosts, paths, labels = zip(*urls.small_table(), strict=True)
    assert ((model.block_scores(list(hosts), list(paths)) >= 0.5) == np.array(labels)).all()


# repetition


def test_repetition_counts_of_made_texts(spark):
    texts = {1: None, 2: "", 3: "a b c a b c\na b c a b c\n \n \n", 4: "é# é#\n\té# é#\né# é#"}
    out = collected(repetition.judge(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert (out[1].n_words, out[1].base_failed, out[1].kept, out[2].n_words) == (0, True, False, 0)
    assert (out[3].n_words, out[3].word_chars, out[3].n_dup_lines, out[3].n_repeat_words) == (12, 12, 1, 12)
    assert (out[4].word_chars, out[4].n_symbols, out[4].n_dup_lines) == (12, 6, 1)


# pipeline


def test_pipeline_stages(spark, directory, documents):
    docs = read_table(spark, directory, "documents")
    kept = {r.doc_id for r in repetition.judge(docs).collect() if r.kept}
    first = corpus_pipeline.materialise(corpus_pipeline.quality_rules(spark, docs, directory), "t")
    assert {r.doc_id for r in first.collect()} == kept and first.columns == docs.columns
    second = corpus_pipeline.materialise(corpus_pipeline.near_duplicates(spark, first, directory), "t")
    assert {r.doc_id for r in second.collect()} == set(groups({i: documents[i] for i in kept}).values())
    third = collected(corpus_pipeline.substring_dedup(spark, second, directory))
    assert set(third) == {r.doc_id for r in second.collect()} and all(r.n_chars == len(r.text) for r in third.values())
    # decontamination by brute force: lower-cased words inside any window of an item
    import re

    def words_of(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    items = [words_of(r.text) for r in read_table(spark, directory, "benchmark").collect()]
    windows = {tuple(w[k : k + min(13, len(w))]) for w in items if w for k in range(len(w) - min(13, len(w)) + 1)}
    sizes = {len(w) for w in windows}
    clean = {}
    for i, r in third.items():
        words = words_of(r.text)
        hit = {p for n in sizes for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in windows for p in range(k, k + n)}
        if not hit or 20 * len(hit) < len(words):
            clean[i] = r.text
    assert 0 < len(clean) < len(third)
    third_table = corpus_pipeline.materialise(corpus_pipeline.substring_dedup(spark, second, directory), "t")
    fourth = collected(corpus_pipeline.decontamination(spark, third_table, directory))
    assert {i: r.text for i, r in fourth.items()} == clean
    # packing: the tokens of every document, in order, and an end token
    import tokenizers

    encode = tokenizers.Tokenizer.from_file(queries.vocabulary()).encode
    pieces = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, directory).collect():
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert set(pieces) == set(clean)
    for i, text in clean.items():
        assert [x for _, ids in sorted(pieces[i]) for x in ids] == [*encode(text or "", add_special_tokens=False).ids, 1]


def test_one_document_of_each_group_stays_with_any_ids(spark, directory):
    text, other = "one two three four five six seven eight nine ten " * 8, "something else entirely for this row " * 9
    rows = [(None, text), (None, text), (7, text), (7, text), (5, other), (5, other), (None, other), (9, None), (None, None), (3, text + "x"), (4, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, row_key long").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, directory)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, (r.text or "")[:3]) for r in out.collect()) == [(3, "one"), (4, ""), (5, "som")]
    unnamed = docs.where("doc_id IS NULL AND text IS NOT NULL")
    assert corpus_pipeline.near_duplicates(spark, unnamed, directory).count() == 2


def test_rows_that_are_equal_throughout_are_spread(spark):
    rows = [(1, "the same " * 10, "en", "s")] * 2000 + [(k, f"text {k} " + "y" * 80, "en", "t") for k in range(2, 2002)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    sizes = collections.Counter()
    for r in sharding.shard_documents(docs, shards=40).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 40 and max(sizes.values()) < 1.05 * sum(sizes.values()) / 40


def test_steps_are_equal_but_for_the_last_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(sequences, "GROUP_BYTES", 40_000)
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(k, "some words here " * int(rng.integers(0, 400))) for k in range(400)], "doc_id long, text string").coalesce(1)
    rows = sequences.pack_sequences(docs, queries.vocabulary, step_tokens=8192).collect()
    steps = collections.Counter()
    for sequence, (step, tier) in {r.sequence_id: (r.step_id, r.tier) for r in rows}.items():
        steps[step] += tier
    sizes = [steps[s] for s in sorted(steps)]
    assert len(sizes) > 10 and set(sizes[:-1]) == {8192} and sizes[-1] <= 8192


def test_address_model_has_not_seen_the_hosts_it_judges(spark, directory):
    unwanted = {"cheap-pills", "casino-win", "spam-farm", "ads-track", "free-bets", "adult-x"}
    seen = {host.split(".")[-2] for host, _, _ in urls.small_table()}
    rows = queries.op10_url_filter(spark, directory).collect()
    names = {r.host.split(".")[-3] for r in rows if r.host.count(".") > 1}
    assert not names & seen and not unwanted & seen
    model = urls.UrlModel.train(urls.small_table())
    hosts = [f"{p}{n}.example.net" for n in sorted(unwanted | names) for p in ("", "www.", "m.", "blog.")]
    blocked = model.block_scores(hosts, ["/en/77"] * len(hosts)) >= 0.5
    right = [b == (h.split(".")[-3] in unwanted) for h, b in zip(hosts, blocked, strict=True)]
    assert sum(right) >= 0.9 * len(right)


def test_hosts_paths_and_rules_of_the_tables(spark, directory):
    """By plain string work on every address."""
    given = collected(read_table(spark, directory, "pages"), "page_id")
    for r in queries.op10_url_filter(spark, directory).collect():
        host, path = "", ""
        if "://" in (given[r.page_id].url or ""):
            rest = given[r.page_id].url.split("://", 1)[1]
            end = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
            host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
            path = rest[: min([k for k in map(rest.find, "?#") if k >= 0], default=len(rest))]
        fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)


def test_addresses_on_edge_rows(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "http://" + "a" * 1_000_000 + ".org/es/"), (3, "://x"), (4, "http://é.example.org/es/")]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, score string, Host int")
    out = urls.filter_urls(table)
    assert len(out.collect()) == 6 and len({c.lower() for c in out.columns}) == len(out.columns)
    assert {r.page_id: r.rule for r in out.collect() if r.page_id in (2, 3, 4)} == {2: "org/", 3: None, 4: "example.org/es/"}
    assert urls.filter_urls(table.limit(0)).collect() == []
