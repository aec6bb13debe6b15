"""Rule-based quality filter with a hashed n-gram log-likelihood ratio.

Two multinomials over hashed token unigrams and bigrams are estimated, one from trusted documents and one from the whole
raw corpus. A document's score is the sum of ``log p_trusted - log p_raw`` over its n-grams divided by their number; a
document is kept if no base rule fails and the score reaches a fixed threshold. The verdict depends on nothing random.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.native import keyed, let, stored, trimmed, words_of

#: Runs of letters, of digits, of one kind of other characters.
TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
SYMBOLS = "[^#*$%&|<>]+"


def repeat_words(words: Column, width: int = 5) -> Column:
    """Words inside ``width``-word windows that occur at least twice, each word counted once; linear-logarithmic in the text."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*(h[i + k] for k in range(width))))

    def covered(keys: Column) -> Column:
        ranked = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        repeated = let(ranked, lambda s: F.transform(F.filter(s, lambda x, j: (
            F.get(s, j - 1)["k"].eqNullSafe(x["k"]) | F.get(s, j + 1)["k"].eqNullSafe(x["k"]))), lambda x: x["i"]))
        return let(F.sort_array(repeated), lambda at: F.aggregate(
            F.transform(at, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - p, F.lit(width)))), F.lit(0), lambda a, x: a + x))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(
        let(let(hashes, windows), lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(covered(keys)))).cast("long")


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` to rows with a ``text``."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: trimmed(line) != "")
    out = docs.withColumn("_words", words_of(text)).withColumn("_lines", lines)
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeat_words(F.col("_words")),
    }).drop("_words", "_lines")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


#: Trusted ids broadcast at once (about 70 bytes each as a join table, so some 35 MB), and blocks of them before a shuffle join takes over.
BLOCK_IDS, MOST_BLOCKS = 500_000, 16


def buckets_of(text: Column, buckets: int) -> Column:
    """Buckets of the hashed token unigrams and bigrams of a text, as one array; empty for null or a text without tokens."""

    def place(h: Column) -> Column:
        return F.pmod(h, F.lit(buckets)).cast("int")

    def both(t: Column) -> Column:
        pairs = F.greatest(F.size(t) - 1, F.lit(0))
        return F.concat(F.transform(t, lambda x: place(F.xxhash64(x))),
                        F.zip_with(F.slice(t, F.lit(1), pairs), F.slice(t, F.lit(2), pairs), lambda x, y: place(F.xxhash64(x, y))))

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), both)


def marked(docs: DataFrame, trusted: DataFrame, block_ids: int, most_blocks: int) -> DataFrame:
    """``text, raw, good`` of documents: each row counts for the raw corpus once, and once as good if its id is trusted.

    The ids go out in blocks of ``block_ids`` hashed parts, so that no text is shuffled: the first block comes with the raw counts,
    each further one takes a scan of its own. Beyond ``most_blocks`` an ordinary join takes their place.
    """
    ids = stored(trusted.select(F.col("doc_id").alias("_id")).filter("_id is not null").distinct(), "trusted-ids")
    blocks = max(1, -(-ids.count() // block_ids))
    if blocks > most_blocks:
        return docs.join(ids, docs.doc_id == ids["_id"], "left").select("text", F.lit(1).alias("raw"), F.when(F.col("_id").isNotNull(), 1).alias("good"))
    parts = [F.broadcast(ids.filter(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == k)) for k in range(blocks)]
    first = docs.join(parts[0], docs.doc_id == F.col("_id"), "left").select("text", F.lit(1).alias("raw"), F.when(F.col("_id").isNotNull(), 1).alias("good"))
    more = [docs.join(part, docs.doc_id == F.col("_id")).select("text", F.lit(0), F.lit(1)) for part in parts[1:]]
    return reduce(DataFrame.unionAll, [first, *more])


def gram_model(docs: DataFrame, trusted: DataFrame, buckets: int, smoothing: float, block_ids: int = BLOCK_IDS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``bucket, weight``: the log ratio of each bucket, ``buckets`` rows whatever the corpus size.

    ``trusted`` gives a ``doc_id`` per trusted document. All of them count, and the raw counts cover every document.
    """
    each = marked(docs, trusted, block_ids, most_blocks).select("raw", "good", F.explode(buckets_of(F.col("text"), buckets)).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.count("good").alias("good"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").fillna(0)
    whole = Window.partitionBy()

    def share(c: str) -> Column:
        return F.log((F.col(c) + smoothing) / (F.sum(c).over(whole) + smoothing * buckets))

    # Without trusted text there is no evidence: all weights are 0.
    weight = F.when(F.sum("good").over(whole) > 0, share("good") - share("raw")).otherwise(0.0)
    return full.select("bucket", weight.alias("weight"))


def judged(docs: DataFrame, trusted: DataFrame, threshold: float = -0.3, buckets: int = 1 << 14, smoothing: float = 1.0) -> DataFrame:
    """``row`` (the columns of ``docs`` as one struct), ``doc_id, text_hash``, the columns of ``base_rules``, ``score`` and ``kept`` of each row."""
    docs = keyed(docs)
    model = stored(gram_model(docs.select("doc_id", "text"), trusted.selectExpr("cast(doc_id as long) doc_id"), buckets, smoothing), "gram-model")
    # ``buckets`` numbers in the order of the buckets: one value of fixed size, looked up in each row.
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("bucket", "weight"))), lambda x: x["weight"])
    rules = base_rules(docs).withColumn("_weights", model.agg(ordered.alias("weights")).scalar())

    def mean(found: Column) -> Column:
        return F.when(F.size(found) == 0, 0.0).otherwise(
            F.aggregate(found, F.lit(0.0), lambda total, b: total + F.get(F.col("_weights"), b)) / F.size(found))

    scored = rules.withColumn("score", let(buckets_of(F.col("text"), buckets), mean)).drop("text", "_weights")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = -0.3, buckets: int = 1 << 14,
                  smoothing: float = 1.0) -> DataFrame:
    """Base counts, score and verdict per row: ``doc_id, text_hash``, the columns of ``base_rules``, ``score``, ``kept``.

    Rows pass through one by one, so null and repeated ids stay. Null or empty text has no words, fails the base rules and
    scores 0. Without trusted documents every score is 0 and the base rules alone decide. Further columns are ignored.
    """
    return judged(docs, trusted, threshold, buckets, smoothing).drop("row")
