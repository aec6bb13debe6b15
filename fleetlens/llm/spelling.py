"""Spelling variants through a bit-sliced position index.

For a block of words the index keeps one bitset per (position, letter): the words that have this letter there. A query word
runs over its letters once; word-parallel recurrences keep, for all words of the block at once, the set that agrees so far
(zero errors), the set with one replaced letter, and the set with one letter more, which reads the slices one position
on. Pairs with one letter less are the same pairs seen from the longer word.

Blocks come from keys that near words share. Let ``short`` be the length of the shorter word. One error leaves its first half
or the rest equal, so each word has a key for either; a key with too many words is halved again inside the part that is
still open, until at most one letter is open. A pair counts where its first agreeing half leads, hence in one block only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.native import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS = "[a-zÀ-ÿ]+"
KEY = ("short", "p", "s", "below", "seg")
#: More than any word is long.
FAR = 1 << 30
#: Letters of all words of a block, about; bounds the bitsets whatever the words' length.
LETTERS = 1 << 18


def vocabulary(docs: DataFrame, least: int = 3, shortest: int = 5) -> DataFrame:
    """``word, n``: runs of letters with A-Z lower-cased and planted slips, of ``shortest`` letters and ``least`` occurrences.

    A run loses a letter where 97 divides the checksum of its document's id and itself; rows without an id lose none.
    """
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(RUNS), F.lit(0))).alias("run"))
    # One letter may still go.
    marked = runs.filter(F.length("run") >= shortest).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = marked.select(F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def halves(keyed: DataFrame) -> DataFrame:
    """Two keys for each: the open part's first half agrees, or it does not and the rest agrees."""
    k = F.expr("(short - p - s) div 2").cast("int")
    first = F.struct((F.col("p") + k).alias("p"), F.col("s").alias("s"), F.col("below").alias("below"))
    rest = F.struct(F.col("p").alias("p"), (F.col("short") - F.col("p") - k).alias("s"), F.least("below", F.col("p") + k).alias("below"))
    both = keyed.select("word", "n", "short", F.explode(F.array(first, rest)).alias("x")).select("word", "n", "short", "x.*")
    return both.withColumn("seg", segment())


def segment() -> Column:
    return F.xxhash64(F.substring("word", F.lit(1), F.col("p")), F.substring("word", F.length("word") - F.col("s") + 1, F.col("s")))


def keys_of(words: DataFrame, tile: int) -> DataFrame:
    """``word, n, short, p, s, below, seg``: keys with at most ``tile`` words each, or one open letter."""
    length = F.length("word")
    start = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("short")).withColumns(
        {"p": F.lit(0), "s": F.lit(0), "below": F.lit(FAR)})
    state, done = stored(halves(start), "keys"), None
    while True:
        full = (F.col("size") > tile) | (F.col("size") * F.col("short") > LETTERS)
        hot = stored(state.groupBy(*KEY).agg(F.count("*").alias("size")).filter(full & (F.col("short") - F.col("p") - F.col("s") > 1)).drop("size"), "hot-keys")
        if hot.isEmpty():
            return state if done is None else done.unionAll(state)
        rest = state.join(hot, list(KEY), "left_anti").select(*state.columns)
        done = rest if done is None else done.unionAll(rest)
        state = stored(halves(state.join(hot, list(KEY), "left_semi")), "keys")


def letters(words: np.ndarray, length: int) -> np.ndarray:
    """Code points, one row per word, 0 behind a word's end."""
    return np.asarray(words, f"<U{length}").view(np.uint32).reshape(len(words), length)


class PositionIndex:
    """Bitsets over the words of a block, by position and letter."""

    def __init__(self, table: np.ndarray):
        self.words, length = table.shape
        self.width = -(-self.words // 64)
        code = np.arange(length, dtype=np.int64) * 0x110000 + table
        word, at = np.nonzero(table)
        self.codes, row = np.unique(code[word, at], return_inverse=True)
        bits = np.zeros((len(self.codes) + 1, 64 * self.width), bool)  # the last one is empty
        bits[row, word] = True
        self.slices = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def having(self, at: int, letter: np.ndarray) -> np.ndarray:
        code = at * 0x110000 + letter.astype(np.int64)
        row = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return self.slices[np.where(self.codes[row] == code, row, len(self.codes))]

    def near(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query (all of one length): words with one replaced letter, and words with one letter more, as bitsets.

        Both sets still hold words of other lengths, which the caller masks.
        """
        zero = np.full((len(query), self.width), ~np.uint64(0))
        one, more = np.zeros_like(zero), np.zeros_like(zero)
        for i in range(query.shape[1]):
            here = self.having(i, query[:, i])
            more = (more | zero) & self.having(i + 1, query[:, i])
            one = (one & here) | (zero & ~here)
            zero &= here
        return one, more | zero


def prefix_of(equal: np.ndarray) -> np.ndarray:
    return np.where(equal.all(1), equal.shape[1], equal.argmin(1))


def block_near(words: np.ndarray, counts: np.ndarray, short: int, p: int, s: int, below: int, chunk: int = 512) -> tuple[np.ndarray, ...]:
    """``word, near, best_n, best`` of a block: words of ``short`` letters or one more; near pairs are counted where their key leads."""
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    table = letters(words, short + 1)
    longer = table[:, short] > 0
    queries = np.flatnonzero(~longer)
    index = PositionIndex(table)
    pad = np.zeros(64 * index.width, bool)
    pad[: len(words)] = longer
    is_long = np.packbits(pad, bitorder="little").view(np.uint64)
    pad[: len(words)] = ~longer
    is_short = np.packbits(pad, bitorder="little").view(np.uint64)
    froms, tos = [], []
    for start in range(0, len(queries), chunk):
        own = queries[start : start + chunk]
        one, more = index.near(table[own, :short])
        for found, shift in ((one & is_short, 0), (more & is_long, 1)):
            q, w = np.nonzero(np.unpackbits(found.view(np.uint8), axis=1, bitorder="little"))
            q = own[q]
            ahead = prefix_of(table[q, :short] == table[w, :short])
            behind = prefix_of((table[q, :short] == table[w, shift : short + shift])[:, ::-1])
            here = (ahead >= p) & (ahead < below) & (behind >= s)
            q, w = q[here], w[here]
            froms += [q, w] if shift else [q]
            tos += [w, q] if shift else [w]
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (froms, tos))
    order = np.lexsort((b, -counts[b], a))  # words ascend, so ties take the smaller one
    a, b = a[order], b[order]
    own, first, near = np.unique(a, return_index=True, return_counts=True)
    return words[own], near, counts[b[first]], words[b[first]]


def near_counts(keys: DataFrame, tile: int) -> DataFrame:
    """``word, near, best_n, best``, one row for each block that holds near words of a word."""
    schema = "word string, near long, best_n long, best string"

    def solved(words: np.ndarray, counts: np.ndarray, shapes: np.ndarray) -> pa.RecordBatch:
        short, p, s, below = shapes[0, :4].tolist()
        found = block_near(words.astype(f"<U{short + 1}"), counts, short, p, s, below)
        return pa.RecordBatch.from_arrays([pa.array(found[0].tolist(), pa.string()), pa.array(found[1], pa.int64()),
                                           pa.array(found[2], pa.int64()), pa.array(found[3].tolist(), pa.string())], ["word", "near", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whole keys of one shape are packed into blocks of about ``tile`` words; what a batch leaves open waits for the next one.
        held = np.zeros(0, object), np.zeros(0, np.int64), np.zeros((0, len(KEY)), np.int64)
        for batch in batches:
            new = batch.column(0).to_numpy(False), batch.column(1).to_numpy(), np.stack([batch.column(2 + k).to_numpy() for k in range(len(KEY))], 1)
            held = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            begin = 0
            for end in block_ends(held[2], tile):
                yield solved(*(x[begin:end] for x in held))
                begin = end
            held = tuple(x[begin:] for x in held)
        if len(held[0]):
            yield solved(*held)

    dealt = keys.select("word", "n", *(F.col(c).cast("long").alias(c) for c in KEY)).repartition(*KEY).sortWithinPartitions(*KEY)
    return dealt.mapInArrow(run, schema)


def block_ends(shapes: np.ndarray, tile: int) -> Iterator[int]:
    """Ends of the blocks that are complete in sorted keys: at a new shape, or at a key that would exceed the size."""
    starts = np.flatnonzero((shapes[1:] != shapes[:-1]).any(1)) + 1
    begin = 0
    for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(shapes)], strict=True):
        room = min(tile, max(1, LETTERS // int(shapes[begin, 0])))
        if (shapes[start, :4] != shapes[begin, :4]).any() or stop - begin > room:
            yield start
            begin = start


def variants(docs: DataFrame, least: int = 3, shortest: int = 5, ratio: int = 2, tile: int = 4096) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of the documents.

    Near words differ by one inserted, deleted or replaced letter; the form is the near word of largest count (ties: the
    smallest) if it is at least ``ratio`` times as frequent; the root ends the chain of forms. Null and empty texts have no
    words; repeated rows count again; rows without an id have no planted slips. Other columns are ignored.
    """
    words = stored(vocabulary(docs.select("doc_id", "text"), least, shortest), "words")
    found = near_counts(keys_of(words, tile), tile).groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("b"))
    joined = words.join(found, "word", "left").withColumn("strong", -F.col("b.minus") >= ratio * F.col("n"))
    judged = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("strong"), F.col("b.best")).alias("form"),
        F.when(F.col("strong"), -F.col("b.minus")).alias("form_n")), "forms")
    roots = chain_ends(judged.filter("form is not null").select("word", F.col("form").alias("root")), judged.agg(F.max("n")).first()[0] or 1, ratio)
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def chain_ends(links: DataFrame, largest: int, ratio: int) -> DataFrame:
    """``word, root``: the ends of chains, by doubling. Counts grow by ``ratio`` at each step, which bounds a chain's length."""
    longest, n = 0, 1
    while n < largest:
        longest, n = longest + 1, n * ratio
    links = stored(links, "roots")
    for _ in range(max(0, longest - 1).bit_length()):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return links
