"""Jaccard join of word n-gram sets through a count-vector R-tree.

Shingles are hashed into groups, and a document is a point whose coordinates count its shingles per group. The sum of
coordinate minima of two points, or of the corners of two boxes, bounds the overlap of the sets from above.

1. Equal sets form one class; everything below works on classes.
2. The first level of the tree names nodes by what two sets that link are bound to share. From 90 % on it cuts the groups of a size
   band into ``m`` slices, one more than two sets of that band that link can differ in, so one slice of both holds the same
   shingles; a hash of the slice's shingles (and so of its counts) is the node. A slice that holds hardly anything says
   little; it is joined with one half of the next slice, which loses no link: were every equal slice light and followed by
   one with two differences, the differences would outnumber the slices. Below 90 % nodes are windows (see ``window_keys``).
3. In each node every class is compared with the least one. Pairs whose bound allows a link are verified on the sets.
4. Nodes whose classes are not yet connected are gathered and cut by size and coordinates into tiles of bounded size; all pairs
   of tiles whose boxes allow a link are searched by a packed R-tree each, up to verified links. Pairs that are connected already are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.components import components
from fleetlens.llm.native import Scratch, keyed, stored
from fleetlens.llm.ranks import ranked
from fleetlens.llm.texts import MIX, MIX2, ascii_lower, byte_blocks, scramble, span_hashes, word_spans

GROUPS = 64
#: Smallest size of each band, for 90 % and more; smaller sets link only if they are equal. Sizes of sets that link lie in one band or in neighbours.
FIRST, RATIO = 9, 1.25
LIGHT = 2
U = np.uint64
SALTS = scramble(np.arange(1, 9, dtype=np.uint64) * MIX2)


def band_starts(largest: int) -> np.ndarray:
    starts = [FIRST]
    while starts[-1] <= largest * 2:
        starts.append(max(starts[-1] + 2, int(np.ceil(starts[-1] * RATIO))))
    return np.array(starts, np.int64)


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per block of rows: first row, number of rows, and the distinct shingle hashes with their row, sorted by both."""
    for block in byte_blocks(column):
        rows = len(block.starts)
        data = ascii_lower(block.data)
        starts, ends, row = word_spans(block)
        words = span_hashes(data, starts, ends)
        count = np.bincount(row, minlength=rows)
        last = len(words) - width + 1
        if last > 0:
            mixed = np.zeros(last, np.uint64)
            for k in range(width):
                mixed = scramble(mixed * MIX + words[k : k + last])
            whole = row[:last] == row[width - 1 :]
            keys, of = mixed[whole], row[:last][whole]
        else:
            keys, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            first = np.searchsorted(row, short)
            extra = np.array([_sequence(words[f : f + count[r]]) for f, r in zip(first, short, strict=True)], np.uint64)
            keys, of = np.concatenate((keys, extra)), np.concatenate((of, short))
        order = np.lexsort((keys, of))
        keys, of = keys[order], of[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
        yield block.first, rows, keys[new], of[new]


def _sequence(words: np.ndarray) -> np.uint64:
    value = np.zeros(1, np.uint64)
    for word in words:
        value = scramble(value * MIX + word)
    return scramble(value + SALTS[7] + U(len(words)))[0]


def row_sums(values: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros(rows, np.uint64)
    np.add.at(out, of, values)
    return out


def slice_keys(keys: np.ndarray, of: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of the tree's first level and the row each belongs to, sorted by row."""
    starts = band_starts(int(sizes.max(initial=0)))
    band = np.searchsorted(starts, sizes, side="right") - 1
    rows = np.flatnonzero(sizes >= FIRST)
    follows = rows[10 * sizes[rows] >= 9 * starts[band[rows] + 1]]
    entry_row = np.concatenate((rows, follows))
    entry_band = np.concatenate((band[rows], band[follows] + 1))
    slices = (starts[entry_band + 1] - 1) // 9 + 1
    base = np.concatenate(([0], np.cumsum(slices)))
    first = np.searchsorted(of, entry_row)
    length = sizes[entry_row]
    total = int(length.sum())
    entry = np.repeat(np.arange(len(entry_row)), length)
    at = np.arange(total) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first, length)
    shingle = keys[at]
    part = ((scramble(shingle ^ SALTS[0]) >> U(32)) * slices[entry].astype(np.uint64) >> U(32)).astype(np.int64)
    half = (scramble(shingle ^ SALTS[1]) >> U(63)).astype(np.int64)
    cell = 2 * (base[entry] + part) + half
    counts = np.bincount(cell, minlength=2 * int(base[-1]))
    sums = row_sums(scramble(shingle ^ SALTS[2]), cell, len(counts)) + counts.astype(np.uint64) * MIX
    slot_entry = np.repeat(np.arange(len(entry_row)), slices)
    within = np.arange(int(base[-1])) - base[slot_entry]
    name = scramble(entry_band[slot_entry].astype(np.uint64) * MIX + within.astype(np.uint64) * MIX2)
    full = scramble(name + sums[0::2] + sums[1::2])
    light = counts[0::2] + counts[1::2] <= LIGHT
    following = base[slot_entry] + (within + 1) % slices[slot_entry]
    heavy = np.flatnonzero(~light)
    thin = np.flatnonzero(light)
    out = [full[heavy], *(scramble(full[thin] + SALTS[3 + h] + scramble(sums[2 * following[thin] + h])) for h in (0, 1))]
    owner = np.concatenate((heavy, thin, thin))
    owner = entry_row[slot_entry[owner]]
    order = np.argsort(owner, kind="stable")
    return np.concatenate(out)[order], owner[order]


def window_length(percent: int) -> int:
    """Shingles that two unequal sets which link hold one after the other, and so the smallest size of such a set."""
    return -(-percent // (100 - percent))


def window_keys(keys: np.ndarray, of: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of windows of consecutive shingles in rings of sorted hashes, and the row each belongs to, sorted by row.

    Let ``u`` be the size of the union of two sets that link. At most ``(100 - percent) u / 100`` of it are in one set only, and
    each of those lies in ``length`` windows of the union's ring; the windows without any of them are windows of both
    sets. So the sets share at least ``u (100 - length (100 - percent)) / 100`` windows, and of a set's windows in the order of their
    hashes only the first ones are needed, all but one less than it is bound to share.
    """
    length = max(1, window_length(percent) - 1)
    inside = sizes[of] >= length
    keys, owner = keys[inside], of[inside]
    size = sizes[owner]
    first = np.searchsorted(owner, owner)
    within = np.arange(len(keys)) - first
    out = np.zeros(len(keys), np.uint64)
    for k in range(length):
        out = scramble(out * MIX + keys[first + (within + k) % size])
    order = np.lexsort((out, owner))
    shared = -(-size * (100 - length * (100 - percent)) // 100)
    first_ones = within <= size - shared
    return out[order][first_ones], owner[first_ones]


def profiles(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, text_hash, n, s1, s2, keys``: set size, 128-bit name of the set and first-level join keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, keys, of in shingle_sets(batch.column(1), width):
                sizes = np.bincount(of, minlength=rows)
                names = [row_sums(scramble(keys ^ SALTS[k]), of, rows).view(np.int64) for k in (5, 6)]
                cells, owner = slice_keys(keys, of, sizes) if percent >= 90 else window_keys(keys, of, sizes, percent)
                offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), batch.column(2).slice(first, rows), pa.array(sizes), pa.array(names[0]), pa.array(names[1]), lists],
                    ["doc_id", "text_hash", "n", "s1", "s2", "keys"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, n long, s1 long, s2 long, keys array<long>")


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, cls, s2, n, groups, members``: group counts (``GROUPS`` coordinates) and sorted shingle hashes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, keys, of in shingle_sets(batch.column(1), width):
                sizes = np.bincount(of, minlength=rows)
                names = [row_sums(scramble(keys ^ SALTS[k]), of, rows).view(np.int64) for k in (5, 6)]
                group = of * GROUPS + (keys >> U(58)).astype(np.int64)
                points = np.bincount(group, minlength=rows * GROUPS).astype(np.int32)
                edges = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.array(names[0]), pa.array(names[1]), pa.array(sizes),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, rows * GROUPS + 1, GROUPS, dtype=np.int32)), pa.array(points)),
                     pa.ListArray.from_arrays(pa.array(edges), pa.array(keys.view(np.int64)))],
                    ["doc_id", "cls", "s2", "n", "groups", "members"])

    return docs.mapInArrow(run, "doc_id long, cls long, s2 long, n long, groups array<int>, members array<long>")


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    """Least intersection with which sets of sizes ``a`` and ``b`` link."""
    return F.ceil(percent * (a + b) / F.lit(100 + percent))


class Links:
    """Union-find over positions 0 .. n-1."""

    def __init__(self, labels: np.ndarray):
        _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
        self.parent = first[inverse].tolist()

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def packed_leaves(points: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Leaves of a packed R-tree: halve along the coordinate of the largest spread down to ``size`` points."""
    pending, leaves = [at], []
    while pending:
        own = pending.pop()
        if len(own) <= size:
            leaves.append(own)
            continue
        block = points[own]
        axis = int(np.argmax(block.max(0) - block.min(0)))
        order = np.argsort(block[:, axis], kind="stable")
        pending += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return leaves


def tree_links(points: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], roots: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Verified links that connect different components; ``side`` 0 and 1 tell the two tiles apart (all 0: one tile with itself)."""
    links, found = Links(roots), []
    leaves = [leaf for s in np.unique(side) for leaf in packed_leaves(points, np.flatnonzero(side == s), 32)]
    corner = np.stack([points[leaf].max(0) for leaf in leaves])
    smallest = np.array([sizes[leaf].min() for leaf in leaves])
    leaf_side = np.array([side[leaf[0]] for leaf in leaves])
    both = side.any()
    for i, leaf in enumerate(leaves):
        bound = np.minimum(corner[i], corner[i:]).sum(1)
        near = i + np.flatnonzero((100 + percent) * bound >= percent * (smallest[i] + smallest[i:]))
        for j in near:
            if both and leaf_side[i] == leaf_side[j]:
                continue
            other = leaves[j]
            overlap = np.minimum(points[leaf][:, None], points[other][None]).sum(2)
            need = percent * (sizes[leaf][:, None] + sizes[other][None])
            own, theirs = (np.array([links.find(int(v)) for v in at]) for at in (leaf, other))
            apart = own[:, None] != theirs[None]
            for x, y in np.argwhere(apart & ((100 + percent) * overlap >= need)):
                a, b = int(leaf[x]), int(other[y])
                if links.find(a) == links.find(b):
                    continue
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if (100 + percent) * common >= percent * (sizes[a] + sizes[b]):
                    links.join(a, b)
                    found.append((a, b))
    return found


def ngram_join(docs: DataFrame, width: int = 3, percent: int = 90, tile: int = 2048) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id`` of every row: links are sets with ``100 * common >= percent * union``.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer than ``width`` words is one shingle. Null, empty
    and blank texts have no shingles and are alone; their ``component_id`` is their own id. Repeated rows share a set and
    so a component, whose id is the least id in it; rows without an id get the id of their component, or null if no row of it has one.
    Other columns are ignored.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    docs = keyed(docs).select("doc_id", "text", "text_hash")
    scratch = Scratch()
    profile = scratch.stored(profiles(docs, width, percent), "profiles")
    name = ["s1", "s2", "n"]
    rows = stored(profile.drop("keys"), "sizes")
    classes = scratch.stored(rows.filter("n > 0").groupBy(*name).agg(F.min("doc_id").alias("rep")), "classes")
    cells = profile.select(F.explode("keys").alias("key"), F.col("s1").alias("cls"))
    shared = cells.groupBy("key").agg(F.min("cls").alias("center"), F.max("cls").alias("top")).filter("center <> top").drop("top")
    hits = scratch.stored(cells.join(scratch.stored(shared, "nodes"), "key").distinct(), "node-members")
    involved = hits.select("cls").distinct()
    reps = classes.filter("rep is not null").join(involved.withColumnRenamed("cls", "s1"), "s1", "left_semi").select("rep").distinct()
    sets = sets_of(docs.join(reps.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi"), width)
    sets = scratch.stored(sets.drop("doc_id").dropDuplicates(["cls", "s2", "n"]), "sets")
    # A 64-bit class name that two sets share only adds candidates: links are made between sets.
    sets = sets.withColumn("uid", F.xxhash64("cls", "s2", "n"))
    stars = _verified(hits.filter("cls <> center").select(F.col("cls").alias("x"), F.col("center").alias("y")).distinct(), sets, percent)
    links = scratch.stored(stars, "links")
    roots = components(links)
    links = links.unionAll(scratch.stored(_tile_links(hits, sets, roots, percent, tile, scratch), "links"))
    final = components(links)
    ids = classes.withColumn("uid", F.xxhash64("s1", "s2", "n")).join(final.withColumnRenamed("node", "uid"), "uid", "left")
    ids = ids.withColumn("root", F.coalesce("root", "uid"))
    least = ids.groupBy("root").agg(F.min("rep").alias("component_id"))
    member = stored(ids.select(*name, "root").join(least, "root").drop("root"), "components")
    scratch.drop()
    out = rows.select("doc_id", "text_hash", *name).join(member, name, "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of the pairs of classes ``x, y`` that link: bounded by the sum of coordinate minima, then compared."""
    left = sets.select(F.col("cls").alias("x"), F.col("uid").alias("a"), F.col("n").alias("na"), F.col("groups").alias("ga"), F.col("members").alias("ma"))
    right = sets.select(F.col("cls").alias("y"), F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("groups").alias("gb"), F.col("members").alias("mb"))
    joined = pairs.join(left, "x").join(right, "y").withColumn("need", least_overlap(F.col("na"), F.col("nb"), percent))
    bound = F.aggregate(F.zip_with("ga", "gb", lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v)
    return joined.filter(bound >= F.col("need")).filter(F.size(F.array_intersect("ma", "mb")) >= F.col("need")).select("a", "b")


def _tile_links(hits: DataFrame, sets: DataFrame, roots: DataFrame, percent: int, tile: int, scratch: Scratch) -> DataFrame:
    """Links between components that meet in a node without being connected yet."""
    spark = hits.sparkSession
    labelled = sets.select("cls", "uid").join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    met = hits.select("key", "cls").join(labelled, "cls").groupBy("key", "root").agg(F.min("cls"))
    first = met.groupBy("key").agg(F.min("root").alias("b"), F.max("root").alias("top")).filter("b <> top").drop("top")
    open_ = scratch.stored(met.join(first, "key").filter("root <> b").select(F.col("root").alias("a"), "b").distinct(), "open")
    meta = scratch.stored(components(open_).select(F.col("node").alias("root"), F.col("root").alias("meta")), "meta")
    members = scratch.stored(labelled.join(meta, "root").select("meta", "root", "uid").join(sets.select("uid", "n", "groups", "members"), "uid"), "open-sets")
    # Tiles of about ``tile`` classes of a meta group, however large the group or one of its components is.
    # Sets that follow each other by size, then by coordinates, make a tile: its box is narrow in size, so tiles whose sizes are
    # too far apart to link are not searched.
    points = scratch.stored(members.select("meta", "uid", "n", "groups"), "points")
    place = ranked(points, "meta", F.col("n"), F.col("groups"), F.col("uid"), scratch=scratch)
    tiles = members.join(place.select("meta", "uid", F.expr(f"rank div {tile}").alias("tile")), ["meta", "uid"])
    corners = tiles.select("meta", "tile", F.posexplode("groups").alias("axis", "v"), "n").groupBy("meta", "tile", "axis").agg(
        F.max("v").alias("v"), F.min("n").alias("n"), F.max("n").alias("most"))
    boxes = scratch.stored(corners.groupBy("meta", "tile").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("axis", "v"))), lambda x: x["v"]).alias("corner"), F.min("n").alias("n"), F.max("most").alias("most")), "boxes")
    one, two = boxes.select("meta", F.col("tile").alias("i"), F.col("corner").alias("ci"), F.col("n").alias("ni"), F.col("most").alias("ti")), boxes.select(
        "meta", F.col("tile").alias("j"), F.col("corner").alias("cj"), F.col("n").alias("nj"), F.col("most").alias("tj"))
    # The size is one more coordinate: no overlap exceeds the largest set of either tile.
    bound = F.least(F.aggregate(F.zip_with("ci", "cj", lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v), "ti", "tj")
    pairs = one.join(two, "meta").filter("i <= j").filter(bound >= least_overlap(F.col("ni"), F.col("nj"), percent)).select("meta", "i", "j")
    ends = pairs.select("*", F.col("i").alias("tile"), F.lit(0).alias("side")).unionAll(
        pairs.filter("i < j").select("*", F.col("j").alias("tile"), F.lit(1).alias("side")))
    work = ends.join(tiles, ["meta", "tile"]).select("meta", "i", "j", "side", "root", "uid", "n", "groups", "members")

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "uid"]).reset_index(drop=True)
        uid = frame["uid"].to_numpy()
        found = tree_links(np.stack(frame["groups"].to_numpy()), frame["n"].to_numpy(), list(frame["members"]),
                           frame["root"].to_numpy(), frame["side"].to_numpy(), percent)
        return pd.DataFrame({"a": [uid[a] for a, _ in found], "b": [uid[b] for _, b in found]}, dtype="int64")

    return work.groupBy("meta", "i", "j").applyInPandas(search, "a long, b long")
