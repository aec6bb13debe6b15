"""Rewrite-based upsert: Parquet tables have no MERGE, so each returns the full new target."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fleetlens.functions.columns import ci, date_lit
from fleetlens.functions.keys import allocate


def text_keys(df: DataFrame, keys: Sequence[str]) -> set[str]:
    """Those of ``keys`` that hold text; they compare without case and padding."""
    return {f.name for f in df.schema.fields if f.name in keys and isinstance(f.dataType, StringType)}


def _key(name: str, text: set[str]) -> Column:
    return ci(name) if name in text else F.col(name)


def join_ci(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join in which text keys compare without case and padding; the left spelling stays."""
    text = text_keys(left, keys) & text_keys(right, keys)
    marked = right.select(*[_key(k, text).alias(f"_j_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [f"_j_{k}" for k in keys]
    return left.withColumns({f"_j_{k}": _key(k, text) for k in keys}).join(marked, on, how).drop(*on)


def with_ids(new: DataFrame, keys: Sequence[str], stored: DataFrame, id_col: str) -> DataFrame:
    """``new`` rows with an id each that no stored row has; see :func:`allocate`."""
    text = text_keys(new, keys)
    return allocate(new, [_key(k, text) for k in keys], stored, id_col)


def one_per_key(source: DataFrame, keys: Sequence[str], latest_by: str | None = None) -> DataFrame:
    """One row per key: the latest by ``latest_by``, else the largest payload, so reruns pick the same row.

    Aggregates on the map side first; a key repeated in much of a batch is one
    row per task before the shuffle.  Spellings of a text key that differ in case only are one key.
    """
    text = text_keys(source, keys)
    payload = [c for c in source.columns if c not in keys] + [k for k in keys if k in text]
    if not payload:
        return source.select(*keys).distinct()
    grouped = source.groupBy(*[_key(k, text).alias(f"_g_{k}" if k in text else k) for k in keys])
    if latest_by is not None:
        best = F.max_by(F.struct(*payload), F.struct(latest_by, *payload))
    elif len(payload) == 1:
        return grouped.agg(F.max(payload[0]).alias(payload[0])).select(*source.columns)
    else:
        best = F.max(F.struct(*payload))
    return grouped.agg(best.alias("_p")).select(*[k for k in keys if k not in text], "_p.*").select(*source.columns)


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str] = (),
    insert_defaults: Mapping[str, Column] | None = None,
    as_of: str | None = None,
    touch: str = "LastUpdated",
    id_col: str | None = None,
    latest_by: str | None = None,
    ids_of: DataFrame | None = None,
) -> DataFrame:
    """Matched rows take ``update_cols`` and the touch date; new keys are inserted; the rest stays.

    Text keys compare without case and padding, and the stored spelling stays.  ``insert_defaults`` gives values of target
    columns the source lacks; ``id_col`` of a new row is the next free number after those of ``ids_of``, by default the target.
    Rows whose key has a null never match, as in an equality merge.  After ``one_per_key`` the join has at most one source
    row per key; ``latest_by`` (a source column) says which.
    """
    defaults = dict(insert_defaults or {})
    text = text_keys(target, keys)
    present = [c for c in target.columns if c in source.columns and c not in keys]
    order = [latest_by] if latest_by and latest_by not in (*keys, *present) else []
    src = one_per_key(source.select(*keys, *present, *order), keys, latest_by)
    types = dict((f.name, f.dataType) for f in target.schema.fields)
    made = [F.col(id_col).alias("_s_new_id")] if id_col in types and id_col not in present else []
    if made:
        known = target.select(*keys)
        old = join_ci(src, known, keys, "left_semi").withColumn(id_col, F.lit(None).cast(types[id_col]))
        src = old.unionByName(with_ids(join_ci(src, known, keys, "left_anti"), keys, ids_of or target, id_col))
    on = [f"_k_{k}" for k in keys]
    src = src.select(*[_key(k, text).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_s_{c}") for c in (*keys, *present)], *made, F.lit(True).alias("_s"))
    both = target.withColumns({"_t": F.lit(True)} | {f"_k_{k}": _key(k, text) for k in keys}).join(src, on, "full_outer")
    incoming, is_new = F.col("_s").isNotNull(), F.col("_t").isNull()

    def value(c: str) -> Column:
        if c in keys:
            return F.when(is_new, F.col(f"_s_{c}")).otherwise(F.col(c)).cast(types[c]).alias(c)
        if c == touch and as_of is not None:
            return F.when(incoming, date_lit(as_of)).otherwise(F.col(c)).cast(types[c]).alias(c)
        if c in present:
            take = incoming if c in update_cols else is_new
            return F.when(take, F.col(f"_s_{c}")).otherwise(F.col(c)).cast(types[c]).alias(c)
        default = F.col("_s_new_id") if c == id_col else defaults.get(c, F.lit(None))
        return F.when(is_new, default).otherwise(F.col(c)).cast(types[c]).alias(c)

    return both.select(*[value(c) for c in target.columns])


def insert_missing(
    target: DataFrame, source: DataFrame, keys: Sequence[str], insert_defaults: Mapping[str, Column] | None = None,
    id_col: str | None = None,
) -> DataFrame:
    """Add keys the target lacks and change nothing else (anti join plus union)."""
    return target.unionByName(missing_rows(target, source, keys, insert_defaults, id_col))


def missing_rows(
    target: DataFrame, source: DataFrame, keys: Sequence[str], insert_defaults: Mapping[str, Column] | None = None,
    id_col: str | None = None,
) -> DataFrame:
    """The rows of ``source``, one per key, whose key the target lacks, in the form of the target: what an append needs."""
    defaults = dict(insert_defaults or {})
    one = one_per_key(source.select(*[c for c in target.columns if c in source.columns]), keys)
    new = join_ci(one, target.select(*keys), keys, "left_anti")
    types = dict((f.name, f.dataType) for f in target.schema.fields)
    if id_col in types and id_col not in new.columns:
        new = with_ids(new, keys, target, id_col)
    return new.select(*[
        (F.col(c) if c in new.columns else defaults.get(c, F.lit(None))).cast(types[c]).alias(c) for c in target.columns])


def archive_upsert(
    target: DataFrame, feed: DataFrame, keys: Sequence[str], as_of: str,
    scope: DataFrame | None = None, update_cols: Sequence[str] = (), id_col: str | None = None,
) -> DataFrame:
    """Upsert among active rows, then archive active rows of ``scope`` not seen on ``as_of``.

    ``scope`` names the entities that were collected (its columns are target
    columns); ``None`` archives every active row that was not touched.
    """
    merged = upsert(
        target.filter(~F.col("IsArchived")), feed, keys, update_cols,
        {"IsArchived": F.lit(False), "DiscoveryOn": date_lit(as_of)}, as_of, id_col=id_col, ids_of=target)
    stale = F.col("LastUpdated") < date_lit(as_of)
    if scope is not None:
        marks = scope.distinct().withColumn("_in_scope", F.lit(True))
        merged = merged.join(marks, scope.columns, "left")
        stale = stale & F.col("_in_scope").isNotNull()
    flagged = merged.withColumn("IsArchived", F.coalesce(stale, F.lit(False))).select(*target.columns)
    return flagged.unionByName(target.filter(F.col("IsArchived")))
