"""Column expressions shared by the operators that use DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.sources.shared import delete_path, shared_dir

#: The white space of all contracts, and its regular expression class.
BLANKS = " \t\n\u000b\f\r"
BLANK_CLASS = r"[ \t\n\x0B\f\r]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also if ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words_of(text: Column) -> Column:
    """Runs without ASCII white space; empty array for null or blank text."""
    return F.when(trimmed(text) == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed(text), BLANK_CLASS + "+"))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored_at(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """Write to the shared folder and read again: cuts lineage and survives the loss of executors. Also returns the folder.

    The shuffle files of the write are not needed once it is done; Spark is told to remove them with the execution, and
    keeps doing so in this session.
    """
    spark: SparkSession = df.sparkSession
    path = shared_dir(spark, f"llm-{purpose}")
    spark.conf.set(CLEANUP, "true")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Stored tables that go as soon as what is built on them is stored itself."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def stored(self, df: DataFrame, purpose: str) -> DataFrame:
        out, path = stored_at(df, purpose)
        self.paths.append((df.sparkSession, path))
        return out

    def drop(self, keep_last: int = 0) -> None:
        """Delete all tables but the last ones; nothing that is still to be computed may read them."""
        gone, self.paths = self.paths[: len(self.paths) - keep_last], self.paths[len(self.paths) - keep_last :]
        for spark, path in gone:
            delete_path(spark, path)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    return stored_at(df, purpose)[0]


def keyed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns as one struct, so that no name can clash), ``doc_id``, ``text`` (null: empty) and ``text_hash``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       text.alias("text"), F.xxhash64(text).alias("text_hash"))
