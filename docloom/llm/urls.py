"""Address filter: rules for hosts and paths first, then a model on character n-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import words as W

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: A small labelled table: hosts to block, then hosts to allow; none is a host of the tables the
#: filter is judged on. Each comes with the paths of its turn, so that paths tell the classes apart only by their words.
UNWANTED = """
casino-royal.test bigcasino.test casino-slots.test live-casino.test casinobonus.test win-jackpot.test winbig.test bigwin-slots.test instant-win.test
poker-win.test winner-bets.test sportbets.test bets-online.test bets24.test bestbets.test betting-odds.test bet-bonus.test slots-bets.test
cheap-meds.test cheapviagra.test cheap-loans.test cheap-watches.test cheap-replica.test diet-pills.test buypills.test pills-shop.test online-pills.test
viagra-pills.test cheap-rx.test free-slots.test freespins.test free-iphone.test free-crack.test free-money.test free-cams.test freexxx.test free-bonus.test
spam-links.test spamhost.test spam-mail.test bulkspam.test link-farm.test linkfarm.test clickfarm.test content-farm.test farm-links.test seo-spam.test
ads-server.test adserver.test ads-click.test popup-ads.test bannerads.test ads-network.test click-track.test tracker-pixel.test trackads.test track-click.test
user-track.test adult-cams.test adultvideos.test adult-dating.test adult-sex.test xadult.test x-cams.test x-rated.test xxx-videos.test sex-x.test
payday-loans.test fast-cash.test replica-shop.test warez-crack.test keygen-crack.test porn-tube.test hot-escorts.test seo-links.test
"""
WANTED = """
news.test library.test gardening.test weather.test university.test museum.test recipes.test citycouncil.test project.test science.test history.test
open-data.test city-guide.test sport-results.test free-software.test evening-classes.test farmers.test pillow.test train-track-maps.test address-book.test
northern.test mother.test together.test nation.test station.test motion.test theory.test thread.test throne.test thirst.test theatre.test thunder.test
another.test father.test brother.test weathering.test therapy.test thermal.test thesis.test thorns.test bathing.test nothing.test anything.test
lighthouse.test southend.test northland.test authority.test method.test cathedral.test mathematics.test rhythm.test health.test wealth.test earth.test
ration.test portion.test fiction.test section.test caption.test relation.test tradition.test condition.test edition.test notion.test option.test
reader.test winter.test window.test betty.test alphabet.test farmland.test trackside.test adriatic.test adventure.test loaded.test exhibit.test axis.test
school.test hospital.test bakery.test harbour.test village.test orchestra.test observatory.test cycling.test
"""
PREFIXES = ("", "www.", "m.", "blog.")
PATHS = ("/en/{}", "/fr/{}.html", "/de/{}/", "/es/{}?page=2&ref=x", "/{}#top", "/")
GRAMS = (3, 4, 5)
SLOTS = 1 << 14


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path; both empty for NULL or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, pattern, 2)


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written as host and path, and its verdict; else NULL."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, decision in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def _grams(texts: list[str], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of all texts: row and slot, each pair once."""
    data = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    pairs = []
    for size in GRAMS:
        keys = W.window_hashes(W.mix(data), size)
        good = np.flatnonzero(row[: len(keys)] == row[len(row) - len(keys) :])
        pairs.append(row[good].astype(np.uint64) * np.uint64(slots) + W.mix(keys[good], size) % np.uint64(slots))
    found = np.unique(np.concatenate(pairs))
    return (found // np.uint64(slots)).astype(np.int64), (found % np.uint64(slots)).astype(np.int64)


def _marked(host: str, path: str) -> str:
    return f"^{host.rpartition('.')[0] or host}$ {path}"


class UrlModel:
    """Logistic regression on hashed n-grams of the host, without its last label, and path."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def train(cls, labelled: list[tuple[str, str, int]], slots: int = SLOTS, ridge: float = 1e-4, steps: int = 2000, rate: float = 20.0) -> UrlModel:
        """``labelled``: host, path, 1 to block. A small table by contract: it is fitted in
        one process, by plain gradient steps on the mean loss."""
        row, slot = _grams([_marked(h, p) for h, p, _ in labelled], slots)
        target = np.array([y for _, _, y in labelled], float)
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(labelled))))
        weights, bias = np.zeros(slots), 0.0
        for _ in range(steps):
            score = bias + scale * np.bincount(row, weights[slot], len(labelled))
            error = 1 / (1 + np.exp(-score)) - target
            weights -= rate * (np.bincount(slot, (error * scale)[row], slots) / len(labelled) + ridge * weights)
            bias -= rate * error.mean()
        return cls(weights, bias)

    def block_scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        texts = [_marked(h, p) for h, p in zip(hosts, paths, strict=True)]
        if not texts:
            return np.empty(0)
        row, slot = _grams(texts, len(self.weights))
        sums = np.bincount(row, self.weights[slot], len(texts)) / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(texts))))
        return 1 / (1 + np.exp(-(self.bias + sums)))


def small_table() -> list[tuple[str, str, int]]:
    """Host, path and label of the addresses that the model learns from, a few for each host."""
    out = []
    for block, text in ((1, UNWANTED), (0, WANTED)):
        for number, host in enumerate(text.split()):
            for turn in range(3):
                path = PATHS[(number + 2 * turn) % len(PATHS)].format(37 * number + 11 * turn)
                out.append((PREFIXES[(number + turn) % len(PREFIXES)] + host, path.partition("?")[0].partition("#")[0], block))
    return out


def filter_urls(pages: DataFrame, url: str = "url", rules=RULES, model: UrlModel | None = None, threshold: float = 0.5) -> DataFrame:
    """Judge every address: adds ``host, path, rule, score, verdict``.

    The longest fitting rule decides (a rule fits its host and all subdomains if the path
    starts with the rule's path); without one, the model blocks at ``threshold`` or more.
    ``score`` is the model's in any case. A NULL address, or one without ``://``, has an
    empty host and path and is judged by the model. Addresses of any length are judged whole. Columns of these names are replaced;
    rows are judged one by one, so repeated rows get the same verdict; an empty table gives an empty table.
    """
    model = model or UrlModel.train(small_table())
    schema = T.StructType([f for f in pages.schema.fields if f.name.lower() not in ("host", "path", "rule", "score", "verdict")])
    host, path = host_and_path(F.col(url))
    rule, decided = best_rule(F.col("host"), F.col("path"), rules)

    @F.pandas_udf("double")
    def score(hosts, paths):
        import pandas as pd

        return pd.Series(model.block_scores(hosts.tolist(), paths.tolist()))

    kept = pages.select(*schema.fieldNames()).withColumns({"host": host, "path": path})
    return kept.withColumns({"rule": rule, "score": score("host", "path")}).withColumn(
        "verdict", F.coalesce(decided, F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    )
