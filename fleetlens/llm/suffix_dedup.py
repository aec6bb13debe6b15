"""Removal of repeated byte strings with a logarithmic family of indexes of minimiser units.

Of every ``length`` bytes the least ``ANCHOR``-byte string by hash is the anchor, so equal strings of that length have equal
anchors at equal places. The window starts that share an anchor form a unit. An index holds the units of a set of
documents by names (hashes of the anchor and of the unit's bytes), 24 bytes an entry. It takes the place of a suffix array: there
are no suffixes, no byte order and no common-prefix lengths in it, and matches are found by equality of names.

Documents come in batches of ascending ids. A batch gets its own index, which is joined with the levels stored so far;
what no level holds becomes a new index of level 0, and two indexes of one level are merged into one of the
next. A unit found before is removed with all its bytes. Where an anchor stands in different units, a match begins or ends
inside a unit; the windows of these units are sorted and compared on their own: within one task for the units of an anchor,
or, where an anchor has more than ``GROUP`` different units, spread over all tasks by the names of the windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.native import keyed, stored, stored_at
from fleetlens.llm.texts import BYTE_CODES, MIX, MIX2, Block, byte_blocks, scramble
from fleetlens.sources.shared import delete_path

ANCHOR = 24
GROUP = 20_000
U = np.uint64
NAME = ["anchor", "name"]
#: Place of a unit in one long: start, number of windows, row of an id.
ROW_BITS, WINDOW_BITS = 16, 16


def odd_inverse(value: int) -> int:
    return pow(value, -1, 1 << 64)


class RangeHash:
    """Hashes of byte ranges of a block by prefix sums of a polynomial over 64-bit integers."""

    def __init__(self, data: np.ndarray, base: np.uint64):
        size = len(data) + 1
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        self.back = np.full(size, U(odd_inverse(int(base))), np.uint64)
        self.back[0] = 1
        self.back = np.multiply.accumulate(self.back)
        self.sums = np.zeros(size, np.uint64)
        np.cumsum(BYTE_CODES[data] * powers[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return scramble((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of ``width`` bytes, composed from powers of two."""
    level, size, out, done = BYTE_CODES[data], 1, None, 0
    while True:
        if width & size:
            out = level.copy() if out is None else out[: len(level) - done] * (MIX + U(2 * size)) + level[done:] if len(level) > done else out[:0]
            done += size
        if size * 2 > width:
            return scramble(out[: max(0, len(data) - width + 1)])
        level = level[:-size] * (MIX2 + U(2 * size)) + level[size:] if len(level) > size else level[:0]
        size *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    level, size = values, 1
    while size * 2 <= width:
        level = np.minimum(level[:-size], level[size:])
        size *= 2
    rest = width - size
    return np.minimum(level[: len(level) - rest], level[rest:]) if rest else level


def units(block: Block, length: int) -> tuple[np.ndarray, ...]:
    """Row, start (in the row), number of windows, anchor and name of each unit of a block, and whether its row had it before."""
    data = block.data
    long = np.flatnonzero(block.ends - block.starts >= length)
    if not len(long):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    hashes = rolling(data, ANCHOR)
    bits = U(max(1, int(len(data)).bit_length()))
    ranked = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    chosen = (sliding_min(ranked, length - ANCHOR + 1) & ((U(1) << bits) - U(1))).astype(np.int64)
    first, count = block.starts[long], block.ends[long] - block.starts[long] - length + 1
    total = int(count.sum())
    at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    of = np.repeat(long, count)
    anchor_at = chosen[at]
    begin = np.ones(total, bool)
    begin[1:] = (anchor_at[1:] != anchor_at[:-1]) | (of[1:] != of[:-1])
    opening = np.flatnonzero(begin)
    windows = np.diff(np.append(opening, total))
    start, row, anchor = at[opening], of[opening], hashes[anchor_at[opening]]
    name = RangeHash(data, MIX)(start, start + windows + length - 1)
    order = np.lexsort((start, name, anchor, row))
    again = np.zeros(len(row), bool)
    a, b = order[1:], order[:-1]
    again[a] = (row[a] == row[b]) & (name[a] == name[b]) & (anchor[a] == anchor[b])
    return row, start - block.starts[row], windows, anchor, name, again


def unit_table(docs: DataFrame, length: int) -> DataFrame:
    """``anchor, name, doc_id, place, again``; place packs start, windows and row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, subs = batch.column(0), batch.column(1)
            for block in byte_blocks(batch.column(2)):
                row, start, windows, anchor, name, again = units(block, length)
                at = pa.array(row + block.first)
                place = (start << (ROW_BITS + WINDOW_BITS)) | (windows << ROW_BITS) | np.asarray(subs.take(at)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(name.view(np.int64)), ids.take(at), pa.array(place), pa.array(again)],
                    ["anchor", "name", "doc_id", "place", "again"])

    return docs.select("doc_id", "sub", "text").mapInArrow(run, "anchor long, name long, doc_id long, place long, again boolean")


class Levels:
    """The index family: at most one index per level, each ``anchor, name, first, repeated``; each task's part is sorted by names."""

    def __init__(self) -> None:
        self.arrays: dict[int, tuple[DataFrame, str]] = {}

    def add(self, batch: DataFrame) -> None:
        """``batch`` has units whose ids are all greater than those added before."""
        own = batch.groupBy(*NAME).agg(F.min("doc_id").alias("first"), (F.count("*") > 1).alias("repeated"))
        if self.arrays:
            known = self.all().filter("first is not null").select(*NAME, F.lit(True).alias("known"))
            # Known names keep their first document, in one array only; what is new is their repetition.
            own = own.join(known, NAME, "left").select(
                *NAME, F.when(F.col("known").isNull(), F.col("first")).alias("first"),
                (F.col("repeated") | F.col("known").isNotNull()).alias("repeated"))
        array, level = stored_at(own.sortWithinPartitions(*NAME), "suffixes"), 0
        while level in self.arrays:
            pair = (self.arrays.pop(level), array)
            array, level = stored_at(self.merged(pair[0][0].unionAll(pair[1][0])).sortWithinPartitions(*NAME), "suffixes"), level + 1
            for _, path in pair:
                delete_path(own.sparkSession, path)
        self.arrays[level] = array

    @staticmethod
    def merged(arrays: DataFrame) -> DataFrame:
        return arrays.groupBy(*NAME).agg(F.min("first").alias("first"), F.max("repeated").alias("repeated"))

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionAll, [array for array, _ in self.arrays.values()])

    def whole(self) -> DataFrame:
        return self.merged(self.all()) if len(self.arrays) > 1 else self.all()

    def discard(self, spark: SparkSession) -> None:
        for _, path in self.arrays.values():
            delete_path(spark, path)


def remove_repeats(docs: DataFrame, length: int = 100, batches: int = 4, group: int = GROUP, shards: int = 2) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, spans, kept`` per row of ``docs``.

    Every byte goes that a ``length``-byte string covers which also starts earlier: in a document of a smaller id, or before in
    the same text. Strings are judged on the input. ``spans`` are the maximal removed runs ``(start, end)`` in bytes, ``kept``
    is binary, as a cut may fall inside a character. Null is empty; texts shorter than ``length`` lose nothing, nor do rows
    without an id, which are not compared. Different rows of one id are not compared with each other; identical ones have
    equal results. At most 65,536 different rows may share an id (more raise an error).
    """
    rows = keyed(docs).drop("row")
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1 and doc_id is not null").select("doc_id")
    if repeated.isEmpty():
        rows = rows.withColumn("sub", F.lit(0))
    else:
        order = Window.partitionBy("doc_id").orderBy("text_hash")
        subs = rows.join(repeated, "doc_id").select("doc_id", "text_hash").distinct().withColumn("sub", F.row_number().over(order) - 1)
        subs = subs.withColumn("sub", F.when(F.col("sub") < (1 << ROW_BITS), F.col("sub")).otherwise(F.raise_error(F.lit("too many rows of one id"))))
        rows = rows.join(subs, ["doc_id", "text_hash"], "left").fillna(0, ["sub"])
    rows = rows.select("doc_id", "sub", "text")
    table, table_path = stored_at(unit_table(rows.filter("doc_id is not null"), length), "units")
    once = table.filter("not again").select(*NAME, "doc_id", "place")
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    # The index is built shard by shard, by anchors, so that only one shard's arrays and shuffles take room at a time.
    hits = reduce(DataFrame.unionAll, [
        _repeated_units(once.filter(F.pmod("anchor", F.lit(shards)) == shard), sorted(set(cuts))) for shard in range(shards)])
    whole = stored(hits.filter("k is null").select("doc_id", "place").unionAll(table.filter("again").select("doc_id", "place")), "whole-units")
    delete_path(docs.sparkSession, table_path)
    late = _late_in_groups(_contexts(rows, hits.filter(F.col("k") <= group).drop("k"), length), length)
    large = hits.filter(F.col("k") > group)
    if not large.isEmpty():
        late = late.unionAll(_late_windows(_contexts(rows, large.drop("k"), length), length))
    return _cut(rows, _by_row(whole.unionAll(stored(late, "late-windows")), "spans"), length)


def _repeated_units(once: DataFrame, cuts: list[int]) -> DataFrame:
    """``anchor, doc_id, place, k``: units found before (``k`` null) and first units of an anchor that has ``k`` different ones."""
    levels, below = Levels(), None
    for high in [*cuts, None]:
        batch = once if below is None else once.filter(F.col("doc_id") > below)
        levels.add(batch if high is None else batch.filter(F.col("doc_id") <= high))
        below = high
    index = levels.whole()
    several = index.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1")
    found = stored(index.join(several, "anchor", "left").filter("repeated or k is not null").select(*NAME, "first", "k"), "repeats")
    levels.discard(once.sparkSession)
    return stored(once.join(found, NAME).filter("first < doc_id or k is not null").select(
        "anchor", "doc_id", "place", F.when(F.col("first") == F.col("doc_id"), F.col("k")).alias("k")), "hits")


def _by_row(places: DataFrame, name: str) -> DataFrame:
    """One row per text with the list of its places, which its length bounds."""
    return places.withColumn("sub", F.pmod("place", F.lit(1 << ROW_BITS)).cast("int")).groupBy("doc_id", "sub").agg(
        F.collect_list(F.shiftright("place", ROW_BITS)).alias(name))


def _unpack(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return places >> WINDOW_BITS, places & ((1 << WINDOW_BITS) - 1)


def _contexts(rows: DataFrame, units_: DataFrame, length: int) -> DataFrame:
    """``anchor, doc_id, place, bytes``: what the windows of each unit cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            for block in byte_blocks(batch.column(2)):
                own = lists.slice(block.first, len(block.starts))
                flat = own.flatten()
                place = np.asarray(flat.field("place"))
                start, windows = _unpack(place >> ROW_BITS)
                row = np.repeat(np.arange(len(own)), np.asarray(own.value_lengths()))
                first, size = start + block.starts[row], windows + length - 1
                offsets = np.concatenate(([0], np.cumsum(size)))
                at = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1] - first, size)
                covered = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(block.data[at])])
                yield pa.RecordBatch.from_arrays(
                    [flat.field("anchor"), batch.column(0).take(pa.array(row + block.first)), pa.array(place), covered], ["anchor", "doc_id", "place", "bytes"])

    sub = F.pmod("place", F.lit(1 << ROW_BITS)).cast("int")
    grouped = units_.groupBy("doc_id", sub.alias("sub")).agg(F.collect_list(F.struct("anchor", "place")).alias("units"))
    joined = rows.join(grouped, ["doc_id", "sub"]).select("doc_id", "sub", "text", "units")
    return joined.mapInArrow(run, "anchor long, doc_id long, place long, bytes binary")


class Windows(NamedTuple):
    """All windows of a table of contexts, with two names each."""

    unit: np.ndarray
    offset: np.ndarray
    names: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def of(contexts: pa.Array, length: int) -> Windows:
        (block,) = byte_blocks(contexts, 1 << 40)
        count = block.ends - block.starts - length + 1
        unit = np.repeat(np.arange(len(count)), count)
        offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        begin = offset + block.starts[unit]
        return Windows(unit, offset, tuple(RangeHash(block.data, base)(begin, begin + length) for base in (MIX, MIX2)))


def _runs(batch: pa.RecordBatch, unit: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
    """``doc_id, place`` of the runs of chosen windows, which are sorted by unit and offset."""
    opens = np.ones(len(unit), bool)
    opens[1:] = (unit[1:] != unit[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(opens)
    count = np.diff(np.append(first, len(unit)))
    place = np.asarray(batch.column("place"))[unit[first]]
    start = (place >> (ROW_BITS + WINDOW_BITS)) + offset[first]
    packed = (start << (ROW_BITS + WINDOW_BITS)) | (count << ROW_BITS) | (place & ((1 << ROW_BITS) - 1))
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(unit[first])), pa.array(packed)], ["doc_id", "place"])


def _late_in_groups(contexts: DataFrame, length: int) -> DataFrame:
    """``doc_id, place`` of the windows that an earlier unit of the same anchor has; whole groups are compared at once."""

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        windows = Windows.of(batch.column("bytes").cast(pa.large_binary()), length)
        doc, place = (np.asarray(batch.column(c))[windows.unit] for c in ("doc_id", "place"))
        row, at = place & ((1 << ROW_BITS) - 1), (place >> (ROW_BITS + WINDOW_BITS)) + windows.offset
        order = np.lexsort((at, row, doc, windows.names[1], windows.names[0]))
        one, two, d, r = (v[order] for v in (*windows.names, doc, row))
        same = np.zeros(len(order), bool)
        same[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        late = d[lead] < d if len(order) else same
        late[1:] |= same[1:] & (d[1:] == d[:-1]) & (r[1:] == r[:-1])
        chosen = np.sort(order[late])
        return _runs(batch, windows.unit[chosen], windows.offset[chosen])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            anchors = np.asarray(batch.column("anchor"))
            turns = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
            cut = 0 if not len(turns) else int(turns[-1])
            if held and len(anchors) and held[-1].column("anchor")[-1].as_py() != anchors[0]:
                yield from map(judge, _slices(held))
                held = []
            if cut:
                yield from map(judge, _slices([*held, batch.slice(0, cut)]))
                held = []
            if len(anchors):
                held.append(batch.slice(cut))
        if held:
            yield from map(judge, _slices(held))

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc_id long, place long")


def _slices(batches: list[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The rows of some batches in slices of whole anchors of at least ``rows`` rows."""
    whole = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    anchors = np.asarray(whole.column("anchor"))
    ends = np.append(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, len(anchors))
    first = 0
    while first < len(anchors):
        stop = int(ends[min(np.searchsorted(ends, first + rows), len(ends) - 1)])
        yield whole.slice(first, stop - first)
        first = stop


def _late_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same for any number of units per anchor: one row per window, joined by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = Windows.of(batch.column("bytes").cast(pa.large_binary()), length)
            place = np.asarray(batch.column("place"))[windows.unit]
            at = (place >> (ROW_BITS + WINDOW_BITS)) + windows.offset
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(n.view(np.int64)) for n in windows.names), batch.column("doc_id").take(pa.array(windows.unit)),
                 pa.array(place & ((1 << ROW_BITS) - 1)), pa.array(at)], ["w1", "w2", "doc_id", "sub", "at"])

    key = ["w1", "w2"]
    windows = stored(contexts.mapInArrow(run, "w1 long, w2 long, doc_id long, sub long, at long").groupBy(*key, "doc_id", "sub").agg(
        F.collect_list("at").alias("at")), "windows")
    firsts = windows.groupBy(*key).agg(F.min("doc_id").alias("first"))
    judged = windows.join(firsts, key).select("doc_id", "sub", F.explode(F.when(F.col("first") < F.col("doc_id"), F.col("at")).otherwise(
        F.array_except("at", F.array(F.array_min("at"))))).alias("at"))
    return judged.select("doc_id", (F.shiftleft("at", ROW_BITS + WINDOW_BITS) + (1 << ROW_BITS) + F.col("sub")).alias("place"))


def _cut(rows: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for block in byte_blocks(batch.column(1)):
                size = len(block.starts)
                own = lists.slice(block.first, size)
                counts = np.asarray(own.value_lengths().fill_null(0))
                start, windows = _unpack(np.asarray(own.flatten()))
                start = start + block.starts[np.repeat(np.arange(size), counts)]
                change = np.zeros(len(block.data) + 1, np.int32)
                np.add.at(change, start, 1)
                np.add.at(change, start + windows + length - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                before = np.concatenate(([False], gone[:-1])) if len(gone) else gone
                first = np.zeros(len(block.data) + 1, bool)
                first[block.starts] = True
                first = first[:-1]
                opening = np.flatnonzero(gone & (~before | first))
                last = np.concatenate((first[1:], [True])) if len(gone) else first
                after = np.concatenate((gone[1:], [False])) if len(gone) else gone
                closing = np.flatnonzero(gone & (~after | last)) + 1
                row = np.searchsorted(block.ends, opening, side="right")
                edges = pa.array(np.searchsorted(row, np.arange(size + 1)).astype(np.int32))
                removed = np.concatenate(([0], np.cumsum(gone)))
                lost = removed[block.ends] - removed[block.starts]
                left = block.data[~gone]
                bounds = np.append(block.starts - removed[block.starts], len(left)).astype(np.int32)
                kept = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(bounds), pa.py_buffer(left)])
                pairs = pa.StructArray.from_arrays([pa.array(opening - block.starts[row]), pa.array(closing - block.starts[row])], ["start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, size), pa.array(block.ends - block.starts), pa.array(lost),
                     pa.array(np.bincount(row, minlength=size)), pa.ListArray.from_arrays(edges, pairs), kept],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    joined = rows.join(spans, ["doc_id", "sub"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary")
