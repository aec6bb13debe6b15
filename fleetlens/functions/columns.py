"""Column helpers that fix the comparison, rounding and date rules once.

All of them return Catalyst expressions, so they stay inside whole-stage
code generation and constant arguments are folded at planning time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_INSTANCE = "mssqlserver"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def date_lit(value: str | dt.date | Column) -> Column:
    """A DATE constant from ``YYYY-MM-DD`` text or a ``date``."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)[:10]).cast("date")


def ts_lit(value: str | dt.datetime | dt.date | Column) -> Column:
    """A zone-less timestamp constant, comparable with zone-less columns without a cast on them."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def ci(value: Column | str) -> Column:
    """Canonical form for case-insensitive, padding-insensitive comparison."""
    return F.lower(F.rtrim(as_col(value)))


def ci_eq(left: Column | str, right: Column | str) -> Column:
    """Equality under the case-insensitive rule; ``right`` text is a constant, not a column name."""
    other = F.lit(right) if isinstance(right, str) else right
    return ci(left) == ci(other)


def like_ci(value: Column | str, pattern: Column | str) -> Column:
    """Case-insensitive LIKE in which a backslash is an ordinary character.

    ``pattern`` text is a constant.  ``[set]`` wildcards, which Spark's LIKE does
    not know, are translated to a regular expression when a pattern has one.
    """
    text = F.lower(as_col(value))
    raw = F.lower(F.lit(pattern) if isinstance(pattern, str) else pattern)
    plain = F.like(text, F.replace(raw, F.lit("~"), F.lit("~~")), F.lit("~"))
    if isinstance(pattern, str) and "[" not in pattern:
        return plain
    regex = F.regexp_replace(raw, r"([\\^$.|?*+(){}])", r"\\$1")
    regex = F.replace(F.replace(regex, F.lit("%"), F.lit(".*")), F.lit("_"), F.lit("."))
    return F.when(raw.contains("["), F.rlike(text, F.concat(F.lit("(?s)^"), regex, F.lit("$")))).otherwise(plain)


def idiv(num: Column, den: Column | int) -> Column:
    """Integer division that truncates; null where the divisor is zero."""
    den = F.lit(den) if isinstance(den, int) else den
    return F.call_function("div", num.cast("bigint"), F.nullif(den.cast("bigint"), F.lit(0).cast("bigint")))


def avg_big(value: Column | str) -> Column:
    """Aggregate: average of integers as a truncated integer."""
    value = as_col(value)
    return idiv(F.sum(value), F.count(value))


def ratio4(num: Column, den: Column) -> Column:
    """``num / den`` of integers rounded half away from zero to four decimals.

    Integer arithmetic keeps the result exact; a zero divisor gives null.
    """
    magnitude = idiv(F.abs(num) * F.lit(20000).cast("bigint") + F.abs(den), F.abs(den) * 2)
    return F.signum(num) * F.signum(den) * magnitude / F.lit(10000.0)


def percent_text(num: Column, den: Column) -> Column:
    """``num / den`` as text such as ``24.24 %``, exact half-up on two decimals."""
    basis = idiv(num * F.lit(20000).cast("bigint") + den, den * 2)
    return F.concat(
        idiv(basis, 100).cast("string"), F.lit("."),
        F.lpad((basis % 100).cast("string"), 2, "0"), F.lit(" %"),
    )


def yyyymm(value: Column | str) -> Column:
    value = as_col(value)
    return F.year(value) * 100 + F.month(value)


def is_default_instance(name: Column | str) -> Column:
    return ci_eq(name, DEFAULT_INSTANCE)


def instance_label(computer: Column | str, name: Column | str) -> Column:
    """``Computer`` for the default instance, ``Computer\\Instance`` otherwise."""
    return F.when(is_default_instance(name), as_col(computer)).otherwise(
        F.concat(as_col(computer), F.lit("\\"), as_col(name))
    )


def version_family(version: Column | str) -> Column:
    """Product label cut before `` Service Pack`` or `` RTM``, vendor prefix removed.

    The cut keeps the separating blank, as the published trend labels do; a label with
    neither marker becomes empty, and ``Unknown`` is left alone.
    """
    version = as_col(version)
    pack = F.locate(" Service Pack", version)
    cut = F.when(pack > 0, pack).otherwise(F.locate(" RTM", version))
    return F.when(version == "Unknown", version).otherwise(
        F.replace(F.substring(version, F.lit(1), cut), F.lit("Microsoft "), F.lit(""))
    )


def edition_label(edition: Column | str) -> Column:
    out = as_col(edition)
    for noise in (" (64-bit)", ": Core-based Licensing", " with Advanced Services"):
        out = F.replace(out, F.lit(noise), F.lit(""))
    return out


def unless_all(column: Column | str, wanted, any_value: str = "ALL") -> Column | None:
    """Equality predicate, or ``None`` when the parameter means "no filter"."""
    if wanted is None or wanted == any_value:
        return None
    return ci_eq(as_col(column), F.lit(wanted)) if isinstance(wanted, str) else as_col(column) == F.lit(wanted)


def apply_filters(df, *predicates: Column | None):
    """Apply the predicates that are set; unset ones never reach the plan."""
    for predicate in predicates:
        if predicate is not None:
            df = df.filter(predicate)
    return df


def surrogate_id(*columns: Column | str) -> Column:
    """Stable 64-bit key from the natural key, in place of an identity column."""
    return F.xxhash64(*[as_col(c) for c in columns])
