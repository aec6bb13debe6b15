"""Quality classifier: regularised quadratic discriminant analysis on transformed document statistics.

Each class is a Gaussian. Its covariance is shrunk towards the diagonal of the pooled covariance, so that it can be inverted
also where a statistic hardly varies in a class. Means and second moments are sums that Spark combines; only they reach the
driver. Scoring uses the inverted Cholesky factors, computed once: the difference of the log densities (squared Mahalanobis
distances and log determinants) plus the log prior ratio goes through a logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.native import stored
from fleetlens.llm.texts import MIX, Block, ascii_lower, byte_blocks, scramble, span_hashes, word_spans

NAMES = ("log_words", "word_length", "word_spread", "upper", "symbols", "bangs", "digits", "beyond_ascii", "distinct", "repeated", "lines", "repeated_lines")
CLASS = np.zeros(256, np.int8)
CLASS[65:91] = 1
CLASS[97:123] = 2
CLASS[48:58] = 3
CLASS[[33, 63]] = 4
CLASS[list(b'"#$%&*+/<=>@[\\]^_`{|}~')] = 5
CLASS[10] = 6
CLASS[128:] = 7


def _distinct(keys: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=size)


def statistics(block: Block) -> np.ndarray:
    """One row of transformed statistics per text, all finite, zeros for an empty one."""
    size = len(block.starts)
    row = np.repeat(np.arange(size), block.ends - block.starts)
    kinds = np.bincount(row * 8 + CLASS[block.data], minlength=size * 8).reshape(size, 8)
    starts, ends, of = word_spans(block)
    words = np.bincount(of, minlength=size)
    length = (ends - starts).astype(float)
    n = np.maximum(words, 1)
    mean = np.bincount(of, length, minlength=size) / n
    spread = np.sqrt(np.maximum(np.bincount(of, length**2, minlength=size) / n - mean**2, 0))
    hashes = span_hashes(ascii_lower(block.data), starts, ends)
    distinct = _distinct(hashes, of, size)
    run = hashes[:0]
    if len(hashes) >= 5:
        run = hashes[:-4].copy()
        for k in range(1, 5):
            run = scramble(run * MIX + hashes[k : len(hashes) - 4 + k])
        inside = of[:-4] == of[4:]
        run, run_of = run[inside], of[:-4][inside]
    else:
        run_of = of[:0]
    runs = np.bincount(run_of, minlength=size)
    repeated = 1 - _distinct(run, run_of, size) / np.maximum(runs, 1)
    repeated[runs == 0] = 0
    # Lines: spans between line breaks, hashed as they stand.
    breaks = block.data == 10
    edge = np.flatnonzero(~breaks & np.concatenate(([True], breaks[:-1]))) if len(breaks) else np.zeros(0, np.int64)
    edge = np.union1d(edge, block.starts[(block.ends > block.starts)])
    edge = edge[~breaks[edge]] if len(edge) else edge
    line_of = np.searchsorted(block.ends, edge, side="right")
    stops = np.flatnonzero(breaks)
    next_break = np.append(stops, len(breaks))[np.searchsorted(stops, edge)]
    line_hash = span_hashes(block.data, edge, np.minimum(next_break, block.ends[line_of]) if len(edge) else edge)
    lines = np.bincount(line_of, minlength=size)
    line_repeat = 1 - _distinct(line_hash, line_of, size) / np.maximum(lines, 1)
    line_repeat[lines == 0] = 0
    letters = np.maximum(kinds[:, 1] + kinds[:, 2], 1)
    total = np.maximum(block.ends - block.starts, 1)
    share = np.sqrt
    return np.column_stack([
        np.log1p(words), np.log1p(mean), np.log1p(spread), share(kinds[:, 1] / letters), share(kinds[:, 5] / total), share(kinds[:, 4] / total),
        share(kinds[:, 3] / total), share(kinds[:, 7] / total), np.log((distinct + 1) / (words + 1)), share(repeated), share(kinds[:, 6] / total), share(line_repeat)])


def statistics_table(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in byte_blocks(batch.column(1)):
                x = statistics(block)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(x)), lists], ["doc_id", "x"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


class Gaussian(NamedTuple):
    prior: float
    mean: np.ndarray
    whiten: np.ndarray
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.whiten.T
        return np.log(self.prior) - 0.5 * (z**2).sum(1) - 0.5 * self.log_det


class Qda:
    """Two classes; ``fit`` takes the sums of a table with ``y`` (0 or 1) and ``x``."""

    def __init__(self, shrinkage: float = 0.1, floor: float = 1e-3, temperature: float = 4.0):
        self.shrinkage, self.floor, self.temperature = shrinkage, floor, temperature
        self.classes: dict[int, Gaussian] = {}

    def fit(self, labelled: DataFrame) -> Qda:
        d = len(NAMES)
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        x = F.col("x")
        sums = labelled.groupBy("y").agg(
            F.count("*").alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(d)), *(F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs)).collect()
        moments = {}
        for row in sums:
            mean = np.array([row[f"s{i}"] for i in range(d)]) / row["n"]
            cov = np.zeros((d, d))
            for i, j in pairs:
                cov[i, j] = cov[j, i] = row[f"p{i}_{j}"] / row["n"] - mean[i] * mean[j]
            moments[row["y"]] = row["n"], mean, cov
        total = sum(m[0] for m in moments.values())
        if total:
            pooled = sum(m[0] * m[2] for m in moments.values()) / total
            target = np.diag(np.maximum(np.diag(pooled), self.floor))
            for y, (n, mean, cov) in moments.items():
                factor = np.linalg.cholesky((1 - self.shrinkage) * cov + self.shrinkage * target + self.floor * np.eye(d))
                self.classes[y] = Gaussian(n / total, mean, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum()))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability-like score of label 1. With one class only it is that class, without any 0.5."""
        if len(self.classes) < 2:
            return np.full(len(x), float(next(iter(self.classes), 0.5)))
        gap = self.classes[1].log_density(x) - self.classes[0].log_density(x)
        return 1 / (1 + np.exp(-np.clip(gap / self.temperature, -700, 700)))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def classify(docs: DataFrame, labels: DataFrame, model: Qda | None = None) -> DataFrame:
    """``doc_id, held_out, score`` of every row of ``docs``.

    ``labels`` (``doc_id, quality``) teach the model, but for ids whose CRC-32 is divisible by 5 (``held_out``) and labels
    other than 0 and 1. Nothing but the text enters a score. Null text is scored as empty text; a null id is not held out;
    rows pass one by one, so a repeated id is scored per row and learned from per row and label.
    """
    table = stored(statistics_table(docs), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("y in (0, 1)")
    fitted = (model or Qda()).fit(table.join(known.filter(fold(F.col("doc_id")) != 0), "doc_id").select("y", "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fitted.score(x))], ["doc_id", "score"])

    scored = table.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score")
