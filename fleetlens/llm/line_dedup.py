"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of ``h1, h2, n_docs, last_doc`` sorted by the 128-bit hash of a line's key. Batches of documents come in
descending order of their ids: each batch is reduced to its distinct keys and merge-joined with the runs stored so far. A
key that no run holds (the anti-join) enters with its keeper, the largest id that has it; a known key only adds its number
of documents. The result is a new run of level 0; whenever ``fan`` runs share a level, they are compacted into one run of
the next level, so that few runs exist at any time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.native import Scratch, keyed, stored, trimmed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, text_hash, pos, h1, h2`` of every line whose key has at least ``min_chars`` code points.

    The hash of a first column seeds that of the next, so the salt of ``h2`` comes first: after the key it would make ``h2`` a function of ``h1``.
    """
    lines = docs.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.withColumn("key", F.translate(trimmed(F.col("line")), UPPER, LOWER)).filter(F.length("key") >= min_chars)
    return keyed.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class Runs:
    """The levelled runs; ``levels[i]`` lists the runs of level i."""

    def __init__(self, fan: int = 2, scratch: Scratch | None = None):
        self.fan, self.scratch = fan, scratch or Scratch()
        self.levels: list[list[DataFrame]] = [[]]

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        """Add a batch of ``doc_id, h1, h2`` rows; all its ids must be smaller than those of earlier batches."""
        own = keys.select("doc_id", *KEY).distinct().groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        if self.all():
            known = reduce(DataFrame.unionAll, [run.filter("last_doc is not null").select(*KEY) for run in self.all()])
            own = own.join(known.withColumn("known", F.lit(True)), KEY, "left").select(
                *KEY, "n_docs", F.when(F.col("known").isNull(), F.col("last_doc")).alias("last_doc"))
        self._put(own, 0)

    def _put(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(self.scratch.stored(run.sortWithinPartitions(*KEY), "line-run"))
        if len(self.levels[level]) == self.fan:
            merged = self._merge(self.levels[level])
            self.levels[level] = []
            self._put(merged, level + 1)

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionAll, runs).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def frequent(self, min_docs: int) -> DataFrame:
        return self._merge(self.all()).filter(F.col("n_docs") >= min_docs).select(*KEY, "last_doc")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fan: int = 2) -> DataFrame:
    """Adds ``n_lines, n_dropped, kept_text`` to each row of ``docs``; other columns stay, those of the same name are replaced.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least ``min_chars`` code
    points in at least ``min_docs`` documents lose all lines but those in the largest id that holds the key. Null or empty text
    is one empty line. Rows that repeat an id count as one document. A row without id keeps all its lines and counts
    for no key. ``batches`` divides the id range; the result does not depend on it.
    """
    scratch = Scratch()
    keys = scratch.stored(line_keys(keyed(docs).filter("doc_id is not null"), min_chars), "line-keys")
    cuts = keys.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    runs, above = Runs(fan, scratch), None
    for low in [*sorted(set(cuts), reverse=True), None]:
        batch = keys if above is None else keys.filter(F.col("doc_id") <= above)
        runs.add(batch if low is None else batch.filter(F.col("doc_id") > low))
        above = low
    drops = keys.join(scratch.stored(runs.frequent(min_docs), "frequent-lines"), KEY).filter("doc_id < last_doc")
    drops = stored(drops.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drops")), "dropped-lines")
    scratch.drop()
    return _without(docs, drops)


def _without(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """The rows of ``docs`` without the lines at the positions in ``drops``.

    Texts are shuffled to their drops, once, within ``row``. The join is a merge join at every size, so that disk grows
    with the input and not by a step where the drops get too large to broadcast.
    """
    rows = keyed(docs).select("row", "doc_id", "text_hash")
    joined = rows.join(drops.hint("merge"), ["doc_id", "text_hash"], "left")
    joined = joined.withColumn("text", F.coalesce(F.col("row")["text"], F.lit(""))).withColumn("lines", F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    out = joined.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(
            F.array_join(F.transform(left, lambda i: F.col("lines")[i]), "\n")).alias("kept_text"))
    added = ["n_lines", "n_dropped", "kept_text"]
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in added), *added)
