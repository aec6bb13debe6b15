"""Merkle manifest of a dataset by nested-interval labels.

Every node of the tree carries the interval ``lo .. hi - 1`` of leaf ranks that it covers. A node of level ``k`` lies in
bucket ``lo div 16^k``, so its ancestor of the next level is found by a join on (tree, bucket) with containment of intervals,
and its siblings are what the interval of the parent holds beside its own. Each source is a tree over its documents;
the roots of the sources are the leaves of a last tree, built by the same functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.native import stored
from fleetlens.llm.ranks import ranked

RUN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def record(values: dict[str, Column]) -> Column:
    """Digest of a row: each field with its length in bytes, null as ``-``."""
    parts = []
    for name in FIELDS:
        text = values[name].cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, tree, digest, forged`` of each row: tree names the source (null before all others), forged is the digest of a tampered text or null."""
    values = {name: F.col(f"`{name}`") for name in FIELDS}
    tampered = F.crc32(values["doc_id"].cast("string").cast("binary")) % 5 == 0
    changed = values | {"text": F.translate(values["text"], UPPER, LOWER)}
    return docs.select(
        values["doc_id"].alias("doc_id"), F.when(values["source"].isNull(), "0").otherwise(F.concat(F.lit("1"), values["source"])).alias("tree"),
        record(values).alias("digest"), F.when(tampered, record(changed)).alias("forged"))


def families(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes of ``level`` with their children: ``tree, size, bucket, kids, lo, hi, digest``; ``nodes`` are those of the level below."""
    grouped = nodes.groupBy("tree", "size", F.expr(f"lo div {RUN**level}L").alias("bucket")).agg(
        F.sort_array(F.collect_list(F.struct(*(c for c in nodes.columns if c not in ("tree", "size"))))).alias("kids"))
    return grouped.withColumns({
        "lo": F.col("kids")[0]["lo"], "hi": F.element_at("kids", -1)["hi"], "digest": F.sha2(joined(F.col("kids")), 256)})


def joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: x["digest"]), "")


def spans_tree() -> Column:
    return F.col("hi") - F.col("lo") == F.col("size")


def build(rows: DataFrame) -> list[DataFrame]:
    """Families by level, the first one above the leaves ``tree, size, lo, hi, digest`` (further columns stay with the leaf).

    A tree grows until one node spans it; a lone leaf is its own root. The number of levels follows the largest tree.
    """
    largest = rows.agg(F.max("size")).first()[0] or 0
    levels, nodes = [], rows
    while largest > RUN ** len(levels):
        grown = stored(families(nodes.filter(F.col("size") > RUN ** len(levels)), len(levels) + 1), "families")
        levels.append(grown)
        nodes = grown.select("tree", "size", "lo", "hi", "digest")
    return levels


def roots(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``tree, subroot`` for each tree."""
    found = rows.filter("size = 1").select("tree", "digest")
    for level in levels:
        found = found.unionAll(level.filter(spans_tree()).select("tree", "digest"))
    return found.withColumnRenamed("digest", "subroot")


def step(kids: Column, lo: Column, hi: Column) -> Column:
    """The siblings of the node ``lo .. hi`` in its parent's interval, left and right of it, as joined digests."""
    return F.struct(joined(F.filter(kids, lambda x: x["hi"] <= lo)).alias("left"), joined(F.filter(kids, lambda x: x["lo"] >= hi)).alias("right"))


def attach(rows: DataFrame, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with ``ups``, their steps to the root; ``above`` has ``tree, ups`` and more for each whole tree."""
    more = [c for c in above.columns if c not in ("tree", "ups")]
    payload = [c for c in rows.columns if c not in ("tree", "size")]
    lone = rows.filter("size = 1").join(above, "tree").select("tree", *payload, *more, "ups")
    known: DataFrame | None = None
    for k in range(len(levels), 0, -1):
        level = levels[k - 1]
        own = level.filter(spans_tree()).join(above, "tree").select("tree", "lo", "hi", "kids", *more, "ups")
        if known is not None:
            parent = known.select(*(F.col(c).alias(f"p_{c}") for c in known.columns), F.expr(f"lo div {RUN**(k + 1)}L").alias("p_bucket"))
            inside = (F.col("p_tree") == F.col("tree")) & (F.col("p_bucket") == F.expr(f"lo div {RUN**(k + 1)}L")) & (
                F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
            found = level.join(parent, inside)
            ups = F.concat(F.array(step(F.col("p_kids"), F.col("lo"), F.col("hi"))), F.col("p_ups"))
            own = own.unionAll(found.select("tree", "lo", "hi", "kids", *(F.col(f"p_{c}").alias(c) for c in more), ups.alias("ups")))
        known = own
    if known is None:
        return lone
    each = known.select("tree", "kids", *more, F.col("ups").alias("rest"), F.explode("kids").alias("leaf"))
    ups = F.concat(F.array(step(F.col("kids"), F.col("leaf")["lo"], F.col("leaf")["hi"])), F.col("rest"))
    return lone.unionAll(each.select("tree", *(F.col("leaf")[c].alias(c) for c in payload), *more, ups.alias("ups")))


def folded(leaf: Column, ups: Column) -> Column:
    return F.aggregate(ups, leaf, lambda value, s: F.sha2(F.concat(s["left"], value, s["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, ups, forged, folded_root, verified`` of every row.

    ``ups`` are the steps from the leaf to the root (joined digests of the siblings on the left and on the right); ``forged``
    is the digest of a tampered row, null elsewhere. Leaves of a source ascend by ``doc_id`` (null first), rows that repeat
    an id by digest. A null source is a tree of its own; null fields count as ``-``, so null and empty text differ. Rows without
    an id are never tampered with. An empty table gives an empty result. Other columns are ignored.
    """
    labelled = ranked(stored(leaves(docs), "leaves"), "tree", F.col("doc_id").asc_nulls_first(), F.col("digest"))
    rows = stored(labelled.select("tree", "size", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "doc_id", "forged"), "labelled")
    levels = build(rows)
    tops = roots(rows, levels)
    places = ranked(stored(tops.withColumnRenamed("tree", "name").withColumn("tree", F.lit("")), "subroots"), "tree", F.col("name"))
    top_rows = stored(places.select("tree", "size", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col("subroot").alias("digest"), "name"), "tops")
    top_levels = build(top_rows)
    root = roots(top_rows, top_levels).select("tree", F.col("subroot").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("ups"))
    above = stored(attach(top_rows, top_levels, root).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "ups"), "paths")
    out = attach(rows, levels, above).withColumn("folded_root", folded(F.coalesce("forged", "digest"), F.col("ups")))
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "ups", "forged", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


def proof(ups: Column) -> Column:
    """All siblings from the leaf to the root, joined."""
    return F.array_join(F.transform(ups, lambda s: F.concat(s["left"], s["right"])), "")
