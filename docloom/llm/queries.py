"""One query for each operator, over whole tables, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import backoff, contamination, mixing, neardup, pages, periods, quality, repetition, sequences, sharding, substrings, urls, whitening
from docloom.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            CHECKS[function.__name__] = sql
        return function

    return register


OP2 = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), word AS (
  SELECT doc_id, j, words[j] AS w,
    CASE WHEN j + 12 <= len(words) THEN array_to_string(words[j:j + 12], ' ') END AS win
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS j FROM texts)
), owner AS (
  SELECT win, min(doc_id) AS least FROM word WHERE win IS NOT NULL GROUP BY win
), judged AS (
  SELECT doc_id, j, w, coalesce(bool_or(least < doc_id) OVER (
    PARTITION BY doc_id ORDER BY j ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone
  FROM word LEFT JOIN owner USING (win)
), result AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(w, ' ' ORDER BY j) FILTER (NOT gone), '') AS kept
  FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN result USING (doc_id)
"""


@query(OP2)
def op2_substring_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """Every document without the passages that an earlier document has."""
    docs = read_table(spark, directory, "documents").select("doc_id", "text")
    kept = substrings.kept_words(F.col("text"))
    return substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def _covered(n: int) -> str:
    """Word characters covered by windows of n words found twice or more in the text."""
    return f"""
g{n} AS (
  SELECT *, CASE WHEN j + {n - 1} <= n THEN array_to_string(words[j:j + {n - 1}], ' ') END AS win FROM word
), f{n} AS (
  SELECT doc_id, j, w, win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 AS twice FROM g{n}
), c{n} AS (
  SELECT doc_id, count(*) FILTER (c) AS words_{n}, coalesce(sum(len(w)) FILTER (c), 0) AS chars_{n} FROM (
    SELECT doc_id, w, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c FROM f{n}
  ) GROUP BY doc_id
)"""


OP6 = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), word AS (
  SELECT doc_id, words, len(words) AS n, j, words[j] AS w FROM (SELECT *, unnest(range(1, len(words) + 1)) AS j FROM texts)
), {_covered(3)}, {_covered(5)}, {_covered(7)}, {_covered(10)}, line AS (
  SELECT doc_id, k, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM texts
  ) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), lines AS (
  SELECT doc_id, count(*) FILTER (nth > 1) AS n_dup_lines,
    coalesce(sum(len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) FILTER (nth > 1), 0) AS line_chars
  FROM line GROUP BY doc_id
), base AS (
  SELECT t.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: len(w))), 0) AS word_chars,
    len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(words_3, 0) AS n_repeat_words, coalesce(line_chars, 0) AS line_chars,
    coalesce(chars_5, 0) AS chars_5, coalesce(chars_7, 0) AS chars_7, coalesce(chars_10, 0) AS chars_10
  FROM texts t LEFT JOIN lines USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN c5 USING (doc_id)
    LEFT JOIN c7 USING (doc_id) LEFT JOIN c10 USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * line_chars <= 30 * word_chars AND 100 * chars_5 <= 40 * word_chars
    AND 100 * chars_7 <= 38 * word_chars AND 100 * chars_10 <= 35 * word_chars AS kept
FROM judged
"""


@query(OP6)
def op6_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    """Repetition counts of every document and whether it stays."""
    docs = read_table(spark, directory, "documents").select("doc_id", "text")
    return repetition.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def vocabulary() -> str:
    """Place of the tokenizer file, asked for where a task runs."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op7_packing(spark: SparkSession, directory: str) -> DataFrame:
    """Every piece of every document in sequences of up to 2048 tokens."""
    docs = read_table(spark, directory, "documents")
    return sequences.pack_sequences(docs, vocabulary).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_id"
    )


OP8 = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[k:k + size - 1], ' ') AS win FROM (
    SELECT *, unnest(range(1, len(words) - size + 2)) AS k FROM (SELECT *, least(13, len(words)) AS size FROM items) WHERE size > 0)
), sizes AS (
  SELECT DISTINCT size FROM windows
), places AS (
  SELECT doc_id, j, size, array_to_string(words[j:j + size - 1], ' ') AS win FROM (
    SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS j FROM texts, sizes WHERE len(words) >= size)
), hits AS (
  SELECT doc_id, j, size, item_id FROM places JOIN windows USING (size, win)
), hit_words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (
    SELECT doc_id, unnest(range(j, j + size)) AS place FROM (SELECT DISTINCT doc_id, j, size FROM hits)) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
    SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM texts LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@query(OP8)
def op8_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    """Which documents hold passages of the benchmark, and of which items."""
    docs = read_table(spark, directory, "documents").select("doc_id", "text")
    return contamination.find_contamination(docs, read_table(spark, directory, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query()
def op10_url_filter(spark: SparkSession, directory: str) -> DataFrame:
    """Verdict on the address of every page."""
    pages = read_table(spark, directory, "pages").select("page_id", "url")
    return urls.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


@query()
def op4_html_extraction(spark: SparkSession, directory: str) -> DataFrame:
    """Main text of every page."""
    pages_table = read_table(spark, directory, "pages").select("page_id", "url", "html")
    return pages.extract_pages(pages_table).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op5_quality_classifier(spark: SparkSession, directory: str) -> DataFrame:
    """Quality score of every document, learned from four fifths of the labels."""
    docs, labels = (read_table(spark, directory, name) for name in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scored = quality.score_quality(docs, labels, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query()
def op1_sharding(spark: SparkSession, directory: str) -> DataFrame:
    """Every document in one of 40 shards of nearly equal bytes."""
    docs = read_table(spark, directory, "documents")
    sharded = sharding.shard_documents(docs, shards=40)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


OP3 = r"""
WITH RECURSIVE texts AS (
  SELECT coalesce(text, '') AS t, min(doc_id) AS doc FROM documents GROUP BY 1
), split AS (
  SELECT doc, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM texts
), shingles AS (
  SELECT doc, s, count(*) AS c FROM (SELECT doc, unnest(CASE WHEN len(words) >= 5
      THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS s FROM split) GROUP BY ALL
), sizes AS (
  SELECT doc, sum(c) AS n FROM shingles GROUP BY doc
), shared AS (
  SELECT x.doc AS a, y.doc AS b, sum(least(x.c, y.c)) AS o FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc < y.doc GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc = a JOIN sizes q ON q.doc = b WHERE 5 * o >= 4 * (p.n + q.n - o)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(doc, other) AS (
  SELECT doc, doc FROM texts UNION SELECT reached.doc, b FROM reached JOIN both_ways ON other = a
), classes AS (
  SELECT doc, min(other) AS class_id FROM reached GROUP BY doc
)
SELECT doc_id, doc AS copy_of, class_id FROM documents JOIN texts ON coalesce(text, '') = t JOIN classes USING (doc)
"""


@query(OP3)
def op3_near_duplicates(spark: SparkSession, directory: str) -> DataFrame:
    """The group of near duplicates of every document."""
    docs = read_table(spark, directory, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs)


OP9 = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), word AS (
  SELECT doc_id, n, j, words[j] AS w1, CASE WHEN j > 1 THEN words[j - 1] || ' ' || words[j] END AS w2,
    CASE WHEN j > 2 THEN words[j - 2] || ' ' || words[j - 1] || ' ' || words[j] END AS w3
  FROM (SELECT doc_id, words, len(words) AS n, unnest(range(1, len(words) + 1)) AS j FROM texts)
), counted AS (
  SELECT *, count(*) OVER (PARTITION BY w1) - count(*) OVER (PARTITION BY w1, doc_id) AS c1,
    CASE WHEN w2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY w2) - count(*) OVER (PARTITION BY w2, doc_id) END AS c2,
    CASE WHEN w3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY w3, doc_id) END AS c3,
    (SELECT count(*) FROM word) - n AS rest
  FROM word
), history AS (
  SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY j) AS h1, lag(c2) OVER (PARTITION BY doc_id ORDER BY j) AS h2 FROM counted
), scored AS (
  SELECT doc_id, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS ord,
    CASE WHEN c3 > 0 THEN ln(c3 / h2) WHEN c2 > 0 THEN ln(c2 / h1) + CASE WHEN j > 2 THEN ln(0.4) ELSE 0 END
      ELSE CASE WHEN c1 > 0 THEN ln(c1 / rest) ELSE ln(1 / (rest + 1)) END + CASE WHEN j > 2 THEN 2 WHEN j = 2 THEN 1 ELSE 0 END * ln(0.4)
    END AS score
  FROM history
), summed AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (ord = 3) AS n_order_3, count(*) FILTER (ord = 2) AS n_order_2,
    count(*) FILTER (ord = 1) AS n_order_1, count(*) FILTER (ord = 0) AS n_order_0, avg(score) AS mean_log_score
  FROM scored GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_order_3, 0) AS n_order_3, coalesce(n_order_2, 0) AS n_order_2,
  coalesce(n_order_1, 0) AS n_order_1, coalesce(n_order_0, 0) AS n_order_0, round(coalesce(mean_log_score, 0), 6) AS mean_log_score
FROM documents LEFT JOIN summed USING (doc_id)
"""


@query(OP9)
def op9_backoff_scores(spark: SparkSession, directory: str) -> DataFrame:
    """Every document scored by the trigrams of all others."""
    docs = read_table(spark, directory, "documents").select("doc_id", "text")
    scored = backoff.score_documents(docs)
    return scored.select(
        "doc_id", "n_words", "n_order_3", "n_order_2", "n_order_1", "n_order_0", F.round("mean_log_score", 6).alias("mean_log_score")
    )


OP11 = r"""
WITH numbers AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS given, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END)) AS state
  FROM documents
), planted AS (
  SELECT *, 4294967295::BIGINT - state AS h, len(given) AS n FROM numbers
), parts AS (
  SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM planted WHERE h % 10 = 0 AND n > 0
), texts AS (
  SELECT doc_id, list_transform(range(n), lambda i: CASE WHEN i < a THEN given[i + 1] ELSE given[a + (i - a) % p + 1] END) AS words FROM parts
  UNION ALL SELECT doc_id, given FROM planted WHERE h % 10 > 0 OR n = 0
), word AS (
  SELECT doc_id, n, i, words[i + 1] AS w, CASE WHEN i + 2 < n THEN hash(words[i + 1], words[i + 2], words[i + 3]) END AS gram
  FROM (SELECT doc_id, words, len(words) AS n, unnest(range(len(words))) AS i FROM texts)
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 2 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= 6 AND length >= 4 * q GROUP BY ALL
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id
), best AS (
  SELECT r.doc_id, start, length, period FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND (o.length * r.period > r.length * o.period
    OR (o.length * r.period = r.length * o.period AND (o.start < r.start OR (o.start = r.start AND o.period < r.period)))))
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

WORD = r"[^\x20\x09-\x0D]+"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document (by the checksum of its id) repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    chosen = chosen.withColumns({"n": F.size("words").cast("long"), "g": F.floor(h / 10)})
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    chosen = chosen.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    rest = (F.col("n") - F.col("a")).cast("int")
    cycle = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), " ")
    return chosen.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


@query(OP11)
def op11_periodic_runs(spark: SparkSession, directory: str) -> DataFrame:
    """Periodic runs of every document, and its text with one period of each."""
    docs = with_planted_runs(read_table(spark, directory, "documents").select("doc_id", "text"))
    found = periods.collapse_runs(docs)
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    # runs come by start and period, so the first of equal ones stays
    best = F.reduce("runs", none, lambda best, r: F.when(better(best, r), r).otherwise(best))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(substrings.kept_words(F.col("text")), 256).alias("collapsed_sha256"),
    )


OP12 = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT AS u
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size, list_extract([5.0, 2.0, 1.0]::DOUBLE[], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS weight
  FROM rows GROUP BY source
), ordered AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY source_size / weight, source) AS k FROM sums
), levels AS (
  SELECT k, cap, weight, (1.5::DOUBLE * (SELECT sum(source_size) FROM sums)::DOUBLE - coalesce(sum(cap) OVER before, 0))
    / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ordered WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stop AS (
  SELECT level, k FROM levels WHERE level * weight < cap ORDER BY k LIMIT 1
), plan AS (
  SELECT source, source_size, CASE WHEN o.k < stop.k THEN cap ELSE weight * level END AS target FROM ordered o, stop
), needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats,
    greatest(0, round(target)::BIGINT - CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END * source_size) AS need
  FROM plan
), placed AS (
  SELECT doc_id, r.source, size, source_size, target, repeats, need,
    sum(size) OVER (PARTITION BY r.source ORDER BY u RANGE UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY r.source, u) AS held
  FROM rows r JOIN needs n ON r.source IS NOT DISTINCT FROM n.source
)
SELECT doc_id, source, size, source_size, target, repeats, (repeats * size + CASE WHEN need = 0 OR upto - held >= need THEN 0 WHEN upto <= need THEN size
  ELSE (size * (need - (upto - held))) // held END)::BIGINT AS taken
FROM placed
"""


@query(OP12)
def op12_mixing(spark: SparkSession, directory: str) -> DataFrame:
    """How many words of every document a mix of one and a half corpora takes."""
    docs = read_table(spark, directory, "documents")
    return mixing.mix_sources(docs, mixing.cyclic_weights(docs.select("source"), (5, 2, 1)), budget=1.5, max_epochs=2.0)


@query()
def op13_whitening(spark: SparkSession, directory: str) -> DataFrame:
    """Whitened coordinates of every vector along the four widest directions."""
    return whitening.whiten(read_table(spark, directory, "embeddings"), components=4)
