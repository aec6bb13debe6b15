"""Benchmark decontamination by spaced-seed hashing.

A mask selects some of consecutive words and ignores the others, so a seed still matches where an ignored word was replaced.
Items of at least ``WINDOW`` words use ``MASKS`` over ``SPAN`` words, chosen so that in any ``WINDOW`` words with at most two
replaced ones at least one seed is intact (``tests/llm`` proves it by enumeration). A shorter item is seeded as a whole: where the
share allows ``r`` replacements, ``r + 1`` masks read every ``r + 1``-th word each, and one of them stays intact. Seeds of all
documents are joined with the seeds of the items; each hit is verified on the aligned words around it: some window of
``WINDOW`` words of the item (or the whole item, if shorter) must agree in at least ``share`` of its positions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.native import keyed, stored

WINDOW, SPAN = 13, 8
MASKS = ("11001111", "11101011")
#: How far the aligned context of a seed reaches before it.
BEFORE = WINDOW - SPAN
REACH = BEFORE + WINDOW


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def whole_masks(length: int, share: float) -> list[str]:
    """Masks of an item shorter than ``WINDOW``: no allowed choice of replaced words hits all of them."""
    parts = length - math.ceil(length * share - 1e-9) + 1
    return ["".join("1" if i % parts == k else "0" for i in range(length)) for k in range(parts)]


def shapes(lengths: Sequence[int], share: float) -> list[tuple[int, str]]:
    """``(name, mask)`` of every seed: the standard ones, and those of the short items' lengths."""
    short = [(16 * n + k, mask) for n in sorted(lengths) for k, mask in enumerate(whole_masks(n, share))]
    return [*enumerate(MASKS), *short]


def seeds(rows: DataFrame, masks: Sequence[tuple[int, str]], named: bool = False) -> DataFrame:
    """One row per mask and position of the word hashes ``h``: ``seed``, ``at`` (0-based) and the words around as ``c0, c1, ...``; with ``named`` also ``shape``.

    The context reaches from ``BEFORE`` words before the seed to ``WINDOW`` words after its start, null outside the text. It
    travels as plain columns, so that a row has a fixed size whatever the length of its text.
    """
    least = min(len(mask) for _, mask in masks)
    count = F.size("h") - least + 1
    before, after = (F.array_repeat(F.lit(None).cast("long"), n) for n in (BEFORE, WINDOW))
    padded = rows.filter(F.size("h") >= least).withColumn("p", F.concat(before, "h", after)).withColumn("words", F.size("h"))
    parts = [F.slice("p", F.lit(k + 1), count).alias(f"c{k}") for k in range(REACH)] + [F.sequence(F.lit(0), count - 1).alias("at")]
    names = [f"c{k}" for k in range(REACH)]
    own = [c for c in rows.columns if c != "h"]
    spread = padded.select(*own, "words", F.inline(F.arrays_zip(*parts)).alias(*names, "at"))

    def key(name: int, mask: str) -> Column:
        seed = F.xxhash64(F.lit(name), *(f"c{BEFORE + k}" for k in range(len(mask)) if mask[k] == "1"))
        seed = F.struct(seed.alias("seed"), F.lit(name).alias("shape")) if named else seed
        return seed if len(mask) == least else F.when(F.col("at") + len(mask) <= F.col("words"), seed)

    keys = spread.select(*own, "at", *names, F.explode(F.array(*(key(*m) for m in masks))).alias("seed"))
    keys = keys if all(len(mask) == least for _, mask in masks) else keys.filter("seed is not null")
    return keys.select(*own, "at", *names, "seed.*") if named else keys


def postings(items: DataFrame, masks: Sequence[tuple[int, str]]) -> DataFrame:
    """Seeds of the items ``item_id, h``; the context columns are ``i0, i1, ...``."""
    found = seeds(items.withColumn("width", F.least(F.size("h"), F.lit(WINDOW))), masks, named=True)
    whole = (F.col("at") == 0) & (F.floor(F.col("shape") / 16) == F.col("width"))
    own = found.filter(F.when(F.col("width") < WINDOW, whole).otherwise(F.col("shape") < len(MASKS)))
    return own.select("seed", "item_id", "width", *(F.col(f"c{k}").alias(f"i{k}") for k in range(REACH))).distinct()


def agreement() -> Column:
    """Most agreeing positions in ``WINDOW`` consecutive ones; those outside a short item agree with nothing."""
    windows = [reduce(Column.__add__, (F.col(f"e{k}") for k in range(start, start + WINDOW))) for start in range(BEFORE + 1)]
    return F.greatest(*windows)


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, block_seeds: int = 200_000, rows: bool = False) -> DataFrame:
    """``doc_id, item_id, agreeing, width, first_word``: every document that holds a passage of an item; with ``rows``
    also ``text_hash``, so that each row of ``docs`` is judged by itself, one without id too.

    The benchmark is the stated query set. Its seeds are broadcast in blocks of about ``block_seeds`` seeds (about 200 bytes
    each), as many blocks as it takes, long items over several; documents are never shuffled. Items without words match nothing,
    nor do null or empty texts. Without ``rows``, rows without an id are not reported and rows that repeat an id count as
    one document. Other columns are ignored.
    """
    docs = keyed(docs).select("doc_id", "text_hash", word_hashes(F.col("text")).alias("h"))
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("h")).filter("item_id is not null")
    short = [r["n"] for r in items.select(F.size("h").alias("n")).filter(f"n between 1 and {WINDOW - 1}").distinct().collect()]  # 12 numbers at most
    masks = shapes(short, share)
    posted = stored(postings(items, masks), "postings")
    blocks = max(1, -(-posted.count() // block_seeds))
    own = ["doc_id", "text_hash"] if rows else ["doc_id"]
    docs = docs if rows else docs.filter("doc_id is not null").drop("text_hash")
    found = [_verified(seeds(docs, masks), posted.filter(F.pmod(F.xxhash64("item_id", "seed"), F.lit(blocks)) == i), own, share) for i in range(blocks)]
    return reduce(DataFrame.unionAll, found).groupBy(*own, "item_id").agg(
        F.max("agreeing").alias("agreeing"), F.max("width").alias("width"), F.min("at").cast("long").alias("first_word"))


def _verified(found: DataFrame, items: DataFrame, own: list[str], share: float) -> DataFrame:
    hits = found.join(F.broadcast(items), "seed")
    equal = [F.when(F.col(f"c{k}") == F.col(f"i{k}"), 1).otherwise(0).alias(f"e{k}") for k in range(REACH)]
    judged = hits.select(*own, "item_id", "at", "width", *equal).withColumn("agreeing", agreement())
    return judged.filter(F.col("agreeing") >= F.ceil(F.col("width") * F.lit(share))).select(*own, "item_id", "at", "width", "agreeing")
