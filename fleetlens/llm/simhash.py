"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, in which neighbours differ in few bits. Consecutive ones form blocks, consecutive
blocks form upper nodes. A node keeps the bits on which everything below it agrees (its mask) and their values (its
pattern); two nodes differ at least in the bits that both masks hold and the patterns tell apart. Starting from the top,
pairs of nodes are expanded level by level: differences of bits that are new in the masks are added to those found
above, and a pair over the limit is dropped with everything below. Inside a pair of blocks the same is done with groups of 32.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.components import components
from fleetlens.llm.native import stored
from fleetlens.llm.ranks import ranked

SEED, WIDTH = 42, 3
GROUP, FAN = 32, 8
U = np.uint64


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the reflected Gray code."""
    out = codes.astype(np.uint64)
    for k in (1, 2, 4, 8, 16, 32):
        out = out ^ (out >> U(k))
    return out


def shingle_hashes(data: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words joined by spaces; fewer words are one shingle, none give an empty array."""
    words = data.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    line = b" ".join(words)
    last = max(0, len(words) - width)
    starts = [0, *ends[:last].tolist()]
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray, piece: int = 1 << 16) -> int:
    """Bits that are set in over half of the hashes; counted in pieces, so that memory does not grow with the text."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), piece):
        counts += np.unpackbits(hashes[at : at + piece].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((U(1) << np.arange(64, dtype=np.uint64))[2 * counts > len(hashes)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, code, gray`` of every row, both numbers as signed 64-bit; the signed order of ``gray`` is the Gray order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(shingle_hashes(x.as_py() or b"")) for x in batch.column(1)], np.uint64)
            gray = gray_rank(codes) ^ U(1 << 63)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64)), pa.array(gray.view(np.int64))], ["doc_id", "code", "gray"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, code long, gray long")


def nodes_above(nodes: DataFrame) -> DataFrame:
    """Upper nodes over ``FAN`` consecutive ones: ``node, mask, pattern``."""
    grown = nodes.groupBy(F.shiftright("node", FAN.bit_length() - 1).alias("node")).agg(
        F.bit_and("mask").alias("kept"), F.bit_and(F.col("pattern").bitwiseAND(F.col("mask"))).alias("ones"),
        F.bit_or(F.col("pattern").bitwiseAND(F.col("mask"))).alias("some"))
    mask = F.col("kept").bitwiseAND(F.bitwise_not(F.col("ones").bitwiseXOR(F.col("some"))))
    return grown.select("node", mask.alias("mask"), F.col("ones").bitwiseAND(mask).alias("pattern"))


def blocks_of(codes: DataFrame, block: int) -> DataFrame:
    """``node, mask, pattern, codes``: ``block`` fingerprints that follow each other in Gray order; ``codes`` are distinct and ranked."""
    grown = codes.groupBy(F.expr(f"rank div {block}").alias("node")).agg(
        F.bit_and("code").alias("ones"), F.bit_or("code").alias("some"),
        F.transform(F.sort_array(F.collect_list(F.struct("gray", "code"))), lambda x: x["code"]).alias("codes"))
    mask = F.bitwise_not(F.col("ones").bitwiseXOR(F.col("some")))
    return grown.select("node", mask.alias("mask"), F.col("ones").bitwiseAND(mask).alias("pattern"), "codes")


def expanded(pairs: DataFrame, below: DataFrame, limit: int) -> DataFrame:
    """Pairs ``x <= y`` of the next lower level: ``x, y, seen, apart``; ``seen`` are the bits already compared, ``apart`` their differences."""
    shift = FAN.bit_length() - 1
    left, right = (below.select(F.shiftright("node", shift).alias(up), F.col("node").alias(v), F.col("mask").alias(f"m{v}"), F.col("pattern").alias(f"p{v}"))
                   for up, v in (("ux", "x"), ("uy", "y")))
    met = pairs.withColumnsRenamed({"x": "ux", "y": "uy"}).join(left, "ux").join(right, "uy").filter("x <= y")
    common = F.col("mx").bitwiseAND(F.col("my"))
    new = F.col("px").bitwiseXOR(F.col("py")).bitwiseAND(common).bitwiseAND(F.bitwise_not(F.col("seen")))
    return met.select("x", "y", common.bitwiseOR(F.col("seen")).alias("seen"), (F.col("apart") + F.bit_count(new)).alias("apart")).filter(F.col("apart") <= limit)


def near_links(a: np.ndarray, b: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is at most ``limit`` bits apart between two Gray-sorted blocks (``b`` None: inside one).

    Groups of ``GROUP`` neighbours are pruned by their masks; of all near pairs a spanning forest is returned as stars.
    """
    codes = a if b is None else np.concatenate((a, b))
    parts = [(0, len(a))] if b is None else [(0, len(a)), (len(a), len(codes))]
    at, masks, patterns, edges = [], [], [], []
    for start, stop in parts:
        firsts = np.arange(start, stop, GROUP)
        ones, some = np.bitwise_and.reduceat(codes[:stop], firsts), np.bitwise_or.reduceat(codes[:stop], firsts)
        at.append(firsts)
        masks.append(~(ones ^ some))
        patterns.append(ones)
        edges.append(np.minimum(firsts + GROUP, stop))
    one, two = 0, len(at) - 1
    apart = np.bitwise_count((patterns[one][:, None] ^ patterns[two][None]) & masks[one][:, None] & masks[two][None])
    rows, cols = np.nonzero(apart <= limit)
    if b is None:
        rows, cols = rows[rows <= cols], cols[rows <= cols]
    label = np.arange(len(codes))
    lane = np.arange(GROUP)
    for piece in range(0, len(rows), 512):
        r, c = rows[piece : piece + 512], cols[piece : piece + 512]
        i, j = at[one][r][:, None] + lane, at[two][c][:, None] + lane
        inside_i, inside_j = i < edges[one][r][:, None], j < edges[two][c][:, None]
        i, j = np.minimum(i, len(codes) - 1), np.minimum(j, len(codes) - 1)
        near = np.bitwise_count(codes[i][:, :, None] ^ codes[j][:, None, :]) <= limit
        near &= inside_i[:, :, None] & inside_j[:, None, :]
        p, s, t = np.nonzero(near)
        x, y = i[p, s], j[p, t]
        x, y = x[x != y], y[x != y]
        while True:  # hook the larger label to the smaller one, then shorten
            lx, ly = label[x], label[y]
            differ = lx != ly
            if not differ.any():
                break
            x, y = x[differ], y[differ]
            np.minimum.at(label, np.maximum(lx, ly)[differ], np.minimum(lx, ly)[differ])
            while (label[label] != label).any():
                label = label[label]
    linked = np.flatnonzero(label != np.arange(len(codes)))
    return codes[linked], codes[label[linked]]


def block_links(pairs: DataFrame, blocks: DataFrame, limit: int) -> DataFrame:
    """``a, b``: links found between the blocks of each pair ``x, y``."""
    held = blocks.select("node", "codes")
    met = pairs.join(held.withColumnsRenamed({"node": "x", "codes": "cx"}), "x").join(held.withColumnsRenamed({"node": "y", "codes": "cy"}), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, cx, cy in zip(*(batch.column(k) for k in range(4)), strict=True):
                left, right = (c.values.to_numpy().view(np.uint64) for c in (cx, cy))
                found = near_links(left, None if x.as_py() == y.as_py() else right, limit)
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)) for f in found], ["a", "b"])

    return met.select("x", "y", "cx", "cy").repartition("x", "y").mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, limit: int = 2, block: int = 1024) -> DataFrame:
    """``doc_id, code, component_id`` of every row: fingerprints link at ``limit`` or fewer differing bits.

    ``component_id`` is the least id reachable by links; rows without an id count, get the id of their component, and null if
    no row of it has one. Null, empty and blank texts have the fingerprint zero, which links like any other. Repeated
    rows share a fingerprint. Other columns are ignored.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    classes = stored(rows.groupBy("code", "gray").agg(F.min("doc_id").alias("least")), "codes")
    places = ranked(classes.select(F.lit(0).alias("all"), "gray", "code"), "all", F.col("gray")).select("gray", "code", "rank")
    blocks = stored(blocks_of(places, block), "blocks")
    levels, count = [blocks.select("node", "mask", "pattern")], blocks.count()
    while count > 1:
        levels.append(stored(nodes_above(levels[-1]), "nodes"))
        count = -(-count // FAN)
    pairs = levels[-1].select(F.col("node").alias("x"), F.col("node").alias("y"), F.col("mask").alias("seen"), F.lit(0).alias("apart"))
    for level in reversed(levels[:-1]):
        pairs = stored(expanded(pairs, level, limit), "pairs")
    roots = components(stored(block_links(pairs.select("x", "y"), blocks, limit), "links"))
    named = classes.join(roots.withColumnRenamed("node", "code"), "code", "left").withColumn("root", F.coalesce("root", "code"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    member = stored(named.select("code", "root").join(least, "root").select("code", "component_id"), "members")
    return rows.select("doc_id", "code").join(member, "code").select("doc_id", "code", "component_id")


def hex_code(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))
