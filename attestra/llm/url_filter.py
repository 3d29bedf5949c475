"""URL filtering by host rules and a logistic regression on hashed character n-grams.

A url is split into host and path. Rules on host suffixes and path prefixes come first, the longest
rule wins; a url no rule covers is judged by the regression, trained in numpy from a small labelled
URL table.

Defined results: a null url, or one without ``://``, has an empty host and path and gets the
regression's verdict for that. Repeated ids are judged row by row. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import mix, small_batches

DIMENSIONS = 1 << 14
NGRAMS = (3, 4, 5)

# Rules as (verdict, host, path prefix).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# A small labelled URL table (host and path, 1 = block).
LABELLED = (
    ("casino-royal.test/en/1", 1), ("www.casino-win.test/fr/play", 1), ("best-casino.test/win", 1),
    ("free-bets.test/en/20", 1), ("m.bets-online.test/odds", 1), ("poker-bets.test/free", 1),
    ("cheap-pills.test/buy", 1), ("www.cheap-pills.test/en/9", 1), ("pills-shop.test/order", 1),
    ("ads-track.test/click", 1), ("m.ads-track.test/en/5", 1), ("track-click.test/ads", 1),
    ("spam-farm.test/en/77", 1), ("blog.spam-farm.test/links", 1), ("link-farm.test/spam", 1),
    ("adult-x.test/video", 1), ("blog.adult-x.test/en/3", 1), ("xxx-adult.test/free", 1),
    ("cheap-loans.test/win", 1), ("free-casino-bets.test/now", 1),
    ("library.test/en/catalogue", 0), ("www.museum.test/de/history", 0), ("blog.theory.test/en/41", 0),
    ("news.test/fr/2020", 0), ("m.weather.test/es/today", 0), ("school.test/en/lesson/3", 0),
    ("www.thetion.test/en/100", 0), ("m.thener.test/en/474.html", 0), ("blog.therin.test/es/10", 0),
    ("thor.test/de/252", 0), ("garden.test/en/plants", 0), ("www.recipes.test/fr/soup", 0),
    ("health.test/en/advice", 0), ("travel.test/es/825", 0), ("science.test/en/paper/7", 0),
    ("blog.thand.test/en/369", 0), ("music.test/de/333", 0), ("m.thing.test/en/80", 0),
    ("archive.test/en/1999", 0), ("www.city.test/fr/616", 0),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    known = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(known, pattern, 1)
    return (
        F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        F.regexp_extract(known, pattern, 2),
    )


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that covers host and path, as (rule, verdict); nulls where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, suffix, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        name = F.when(fits, suffix + prefix).otherwise(name)
        verdict = F.when(fits, action).otherwise(verdict)
    return name, verdict


def features(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed n-gram) pairs, each once per row; n-grams of host and path are told apart."""
    rows, codes = [], []
    for row, url in enumerate(urls):
        host, slash, path = url.partition("/")
        grams = set()
        for part, text in (("h", f".{host}."), ("p", slash + path)):
            raw = text.lower()
            for size in NGRAMS:
                grams.update(f"{part}{raw[i : i + size]}" for i in range(len(raw) - size + 1))
        rows += [row] * len(grams)
        codes += grams
    hashed = np.array([hash_text(gram) for gram in codes], np.uint64) if codes else np.zeros(0, np.uint64)
    return np.array(rows, np.int64), (mix(hashed) % np.uint64(DIMENSIONS)).astype(np.int64)


def hash_text(text: str) -> int:
    value = 1469598103934665603
    for byte in text.encode():
        value = (value ^ byte) * 1099511628211 % (1 << 64)
    return value


class UrlModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, urls: list[str]) -> np.ndarray:
        rows, codes = features(urls)
        counts = np.bincount(rows, minlength=len(urls))
        total = np.bincount(rows, self.weights[codes], minlength=len(urls))
        return 1 / (1 + np.exp(-(total / np.sqrt(np.maximum(counts, 1)) + self.bias)))


def train_url_model(labelled=LABELLED, steps: int = 400, rate: float = 2.0, decay: float = 1e-3) -> UrlModel:
    """Full-batch gradient descent on the labelled table."""
    urls, wanted = [u for u, _ in labelled], np.array([y for _, y in labelled], float)
    rows, codes = features(urls)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(urls)), 1))
    weights, bias = np.zeros(DIMENSIONS), 0.0
    for _ in range(steps):
        total = np.bincount(rows, weights[codes], minlength=len(urls)) * scale + bias
        error = (1 / (1 + np.exp(-total)) - wanted) / len(urls)
        weights -= rate * (
            np.bincount(codes, (error * scale)[rows], minlength=DIMENSIONS) + decay * weights / len(urls)
        )
        bias -= rate * error.sum()
    return UrlModel(weights, bias)


def filter_urls(
    pages: DataFrame,
    labelled=LABELLED,
    rules=RULES,
    threshold: float = 0.5,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """One row per page row: id, host, path, rule, score (of the regression), verdict."""
    small_batches(pages.sparkSession)
    host, path = split_url(F.col(url_column).cast("string"))
    parts = pages.select(F.col(id_column).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    model = train_url_model(labelled)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            scores = model.score([a + b for a, b in zip(hosts, paths)])
            yield batch.append_column("score", pa.array(scores))

    scored = parts.mapInArrow(task, "id long, host string, path string, score double")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(
        "id", "host", "path", rule.alias("rule"), "score", F.coalesce(verdict, judged).alias("verdict")
    )
