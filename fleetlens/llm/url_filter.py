"""URL filter: host and path rules first, then a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.line_dedup import LOWER, UPPER
from fleetlens.llm.texts import Block, byte_blocks
from fleetlens.llm.suffix_dedup import rolling


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query (fixed values).
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: Words of a small labelled table, from general knowledge of unwanted and of ordinary sites; the given tables had no part in it.
BAD_WORDS = (
    "casino", "poker", "roulette", "jackpot", "slots", "betting", "bets", "wager", "bingo", "lottery",
    "pills", "meds", "viagra", "pharma", "steroids", "adult", "porn", "escort", "cams", "xxx",
    "spam", "clickbait", "adserver", "ads", "tracker", "popup", "malware", "phishing", "warez", "crack", "loans", "replica",
)
GOOD_WORDS = (
    "library", "museum", "school", "university", "garden", "weather", "recipe", "travel", "history", "science",
    "council", "health", "music", "news", "forum", "theatre", "hospital", "bakery", "cycling", "physics",
    "poetry", "market", "archive", "football", "harbour", "orchard", "bridge", "village", "farm", "track", "mail", "server",
)
#: What hosts of both kinds add to a word.
BESIDE = ("best", "my", "the", "city", "daily", "north", "blue", "first", "online", "free", "world", "24", "365", "top", "win", "cheap")
ENDINGS = ("com", "net", "org", "info", "io")
PREFIXES = ("", "www.", "m.", "blog.", "shop.")
PATHS = ("/en/{}", "/de/{}/", "/{}.html", "/es/{}", "/item/{}/", "/")


def made_names(count: int, seed: int = 11) -> list[str]:
    """Names without a meaning, as many ordinary sites have: syllables of a fixed generator."""
    rng = random.Random(seed)
    part = lambda: rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiou") + rng.choice(("", "n", "r", "th", "l", "s"))
    return ["".join(part() for _ in range(rng.randint(2, 4))) for _ in range(count)]


def labelled_urls() -> list[tuple[str, int]]:
    """``(url, label)`` of the small training table (640 rows); both labels share endings, prefixes, paths, hyphens and digits."""
    out = []

    def add(name: str, label: int, k: int) -> None:
        path = PATHS[k % len(PATHS)].format(1000 + 617 * (k % 13))
        out.append((f"https://{PREFIXES[k % len(PREFIXES)]}{name}.{ENDINGS[k // 2 % len(ENDINGS)]}{path}", label))

    for words, label in ((BAD_WORDS, 1), (GOOD_WORDS, 0)):
        for i, word in enumerate(words):
            beside = [BESIDE[(5 * i + 3 * k + label) % len(BESIDE)] for k in range(3)]
            for k, name in enumerate((f"{word}-{beside[0]}", f"{beside[1]}{word}", f"{beside[2]}-{word}{i % 10}", word)):
                add(name, label, 4 * i + k)
    for k, name in enumerate(made_names(384)):
        add(name if k % 3 else f"{name}-{BESIDE[k % len(BESIDE)]}", 0, k)
    return out


def with_parts(urls: DataFrame) -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``; both are empty for null or a url without ``://``."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return urls.withColumn("_rest", F.coalesce(rest, F.lit(""))).withColumns({
        "host": F.translate(F.regexp_extract("_rest", r"^([^/?#]*)([^?#]*)", 1), UPPER, LOWER),
        "path": F.regexp_extract("_rest", r"^([^/?#]*)([^?#]*)", 2)}).drop("_rest")


def rule_of(rules: Sequence[Rule], value: str) -> Column:
    """``name`` or ``verdict`` of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        host = (F.col("host") == rule.host) | F.endswith("host", F.lit(f".{rule.host}"))
        out = F.when(host & F.startswith("path", F.lit(rule.path)), F.lit(getattr(rule, value))).otherwise(out)
    return out


class GramModel:
    """Logistic regression on counts of hashed n-grams of 3 to 5 bytes of host and path, scaled to unit length."""

    SIZES = (3, 4, 5)

    def __init__(self, buckets: int = 1 << 14, penalty: float = 1e-5, steps: int = 600, rate: float = 16.0):
        self.buckets, self.penalty, self.steps, self.rate = buckets, penalty, steps, rate
        self.weights, self.bias = np.zeros(buckets), 0.0

    def grams(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Row and bucket of every n-gram that lies in one row."""
        rows, cells = [], []
        for size in self.SIZES:
            hashes = rolling(block.data, size)
            row = np.searchsorted(block.ends, np.arange(len(hashes)), side="right")
            inside = np.arange(len(hashes)) + size <= block.ends[np.minimum(row, len(block.ends) - 1)]
            rows.append(row[inside])
            cells.append((hashes[inside] % np.uint64(self.buckets)).astype(np.int64))
        return np.concatenate(rows), np.concatenate(cells)

    def values(self, rows: np.ndarray, cells: np.ndarray, size: int) -> np.ndarray:
        """Log-odds per row; a row without n-grams gets the bias."""
        norm = np.sqrt(np.maximum(np.bincount(rows, minlength=size), 1))
        return np.bincount(rows, self.weights[cells], minlength=size) / norm + self.bias

    def fit(self, texts: list[str], labels: list[int]) -> GramModel:
        (block,) = byte_blocks(pa.array(texts), 1 << 30)
        rows, cells = self.grams(block)
        y, size = np.array(labels, float), len(texts)
        norm = np.sqrt(np.maximum(np.bincount(rows, minlength=size), 1))
        weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))  # both labels weigh the same, however many rows they have
        for _ in range(self.steps):
            gap = (1 / (1 + np.exp(-self.values(rows, cells, size))) - y) * weight
            step = np.bincount(cells, (gap / norm)[rows], minlength=self.buckets) + self.penalty * self.weights
            self.weights -= self.rate * step
            self.bias -= self.rate * gap.sum()
        return self


def parts_text(url: str) -> str:
    """Host and path of a url as the model reads them."""
    rest = url.partition("://")[2]
    stop = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[stop:].partition("?")[0].partition("#")[0]
    return f"^{rest[:stop].lower()}{path}"


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, labelled: list[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """``page_id, url, host, path, rule, score, verdict`` of every row.

    ``score`` is the model's probability that the url is to be blocked; it decides where no rule fits. Null urls and urls
    without ``://`` have an empty host and path and are scored as such. Rows pass one by one; other columns are ignored.
    """
    table = labelled or labelled_urls()
    model = GramModel().fit([parts_text(u) for u, _ in table], [y for _, y in table])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.binary_join_element_wise(pa.scalar("^"), batch.column(2), batch.column(3), "")
            scores = [np.zeros(0)]
            for block in byte_blocks(text):
                scores.append(1 / (1 + np.exp(-model.values(*model.grams(block), len(block.starts)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], [*batch.schema.names, "score"])

    parts = with_parts(pages.select("page_id", F.col("url").cast("string").alias("url")))
    kind = parts.schema["page_id"].dataType.simpleString()
    scored = parts.mapInArrow(run, f"page_id {kind}, url string, host string, path string, score double")
    return scored.withColumn("rule", rule_of(rules, "name")).withColumn("verdict", F.coalesce(
        rule_of(rules, "verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow")))
