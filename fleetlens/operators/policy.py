"""Policy results: shredding of landed XML documents and the current-state summary.

Each document is parsed once, whole, by a streaming XML parser that runs over Arrow batches: details may lie at any depth, which
a declared XML schema cannot say, and only a parser tells tags from CDATA sections, comments, quoted attributes and processing
instructions. Documents are shredded before anything is joined, so no XML is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import apply_filters, ci, ci_eq

NO_TARGET = "No Targets Found"
RESULT_SOURCE = "Policy evaluation framework"
RESULTS = ("PASS", "FAIL", "ERROR")
FIELDS = ("ServerInstance", "TargetQueryExpression", "Result", "Exception", "ResultDetail")
DETAIL = "EvaluationDetail"
#: What is kept of a document or of each of its details, in this order.
READ = ("_target", "_first", "_instance", *FIELDS[1:])


def policy_result(result: Column, exception: Column) -> Column:
    """FALSE without exception text fails, FALSE with it is an error, all else passes."""
    failed = F.coalesce(ci_eq(result, "FALSE"), F.lit(False))
    return (
        F.when(failed & (exception == ""), F.lit("FAIL"))
        .when(failed & (exception != ""), F.lit("ERROR"))
        .otherwise(F.lit("PASS")))


class _Document:
    """Values of one document, by local names: the first child of each name counts; '' is an empty element, None an absent one."""

    def __init__(self, text: str):
        self.open: list[dict[str, str]] = []  # the fields of every open element
        self.names: list[str] = []
        self.values: list[list[str]] = []  # pieces of every open field
        self.details: list[dict[str, str]] = []
        self.beside: dict[str, tuple[int, str]] = {}  # field -> its place in the document and text, beside a server instance
        self.places: list[dict[str, int]] = []
        self.seen = 0
        parser = expat.ParserCreate("utf-8")
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = self._start, self._end, self._text
        parser.Parse(text.encode("utf-8"), True)

    def _start(self, name: str, _: dict) -> None:
        name = name.rpartition(":")[2]
        fields: dict[str, str] = {}
        self.names.append(name)
        self.open.append(fields)
        self.places.append({})
        if name == DETAIL:
            self.details.append(fields)
        elif name in FIELDS:
            self.values.append([])

    def _text(self, data: str) -> None:
        for pieces in self.values:
            pieces.append(data)

    def _end(self, _: str) -> None:
        name, fields, places = self.names.pop(), self.open.pop(), self.places.pop()
        if "ServerInstance" in fields:
            for field, place in places.items():
                self.beside[field] = min((place, fields[field]), self.beside.get(field, (place, fields[field])))
        if name in FIELDS:
            value = "".join(self.values.pop())
            self.seen += 1
            if self.open and name not in self.open[-1]:
                self.open[-1][name] = value
                self.places[-1][name] = self.seen


def read_document(text: str | None) -> list[tuple]:
    """One tuple of ``READ`` per detail of a document, or one for a document without details.

    A text that is not well-formed counts as a failed result with the parser's message, so that it is seen.
    """
    if text is None:
        return [(False, True, False, None, None, None, None)]
    try:
        document = _Document(text)
    except expat.ExpatError as error:
        return [(False, True, True, None, "FALSE", f"malformed document: {error}", None)]
    if not document.details:
        value = {field: text for field, (_, text) in document.beside.items()}
        return [(False, True, "ServerInstance" in value, *map(value.get, FIELDS[1:]))]
    out, objects = [], set()
    for detail in document.details:
        name = detail.get("TargetQueryExpression")
        out.append((True, name not in objects, "ServerInstance" in detail, *map(detail.get, FIELDS[1:])))
        objects.add(name)
    return out


def details(history: DataFrame) -> DataFrame:
    """One narrow row per evaluation detail of each document, and one for a document without details."""
    keys = ["PolicyHistoryID", "EvaluatedServer", "EvaluationDateTime", "EvaluatedPolicy"]
    rows = history.select(*keys, "EvaluationResults")
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys),
                        *(f"{c} boolean" for c in READ[:3]), *(f"{c} string" for c in READ[3:])])
    kinds = [pa.bool_()] * 3 + [pa.string()] * (len(READ) - 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_document(x.as_py()) for x in batch.column(len(keys))]
            at = pa.array([i for i, own in enumerate(found) for _ in own], pa.int64())
            columns = list(zip(*(row for own in found for row in own), strict=True)) or [()] * len(READ)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(at) for k in range(len(keys))), *map(pa.array, columns, kinds)], [*keys, *READ])

    return rows.mapInArrow(run, schema)


def _of_known(rows: DataFrame, policies: DataFrame, category: str | None) -> DataFrame:
    """Rows of known policies; ``policies`` carries its category name."""
    known = policies.select(ci("PolicyName").alias("_policy"), F.col("policy_id").alias("Policy_id"), "CategoryName")
    known = apply_filters(known, ci_eq(F.col("CategoryName"), category) if category else None)
    return rows.withColumn("_policy", ci("EvaluatedPolicy")).join(known, "_policy").drop("_policy")


def shred_documents(
    history: DataFrame, policies: DataFrame, loaded: DataFrame | None = None, category: str | None = None,
    targets: bool = True, no_targets: bool = True, source: str = RESULT_SOURCE,
) -> DataFrame:
    """One row per target of each document, and one row for a document without details, in one pass.

    Of several results for one object the first in document order is kept. ``loaded`` holds rows of earlier loads: a
    document with targets counts as loaded when it has a row with a result detail, one without when it has a row without.
    ``source`` is stored with every row.
    """
    wanted = (F.lit(targets) & F.col("_target") & F.col("TargetQueryExpression").isNotNull() & F.col("_first")) | (
        F.lit(no_targets) & ~F.col("_target") & F.col("_instance"))
    rows = _of_known(details(history).filter(wanted), policies, category)
    if loaded is not None:
        done = loaded.select("PolicyHistoryID", F.col("ResultDetail").isNotNull().alias("_target")).distinct()
        rows = rows.join(done, ["PolicyHistoryID", "_target"], "left_anti")
    return rows.select(
        "PolicyHistoryID", "EvaluatedServer", "EvaluationDateTime", "EvaluatedPolicy",
        F.when(F.col("_target"), F.col("TargetQueryExpression")).otherwise(F.lit(NO_TARGET)).alias("EvaluatedObject"),
        policy_result(F.col("Result"), F.col("Exception")).alias("PolicyResult"), F.col("Exception").alias("ExceptionMessage"),
        F.when(F.col("_target"), F.col("ResultDetail")).alias("ResultDetail"), "Policy_id", "CategoryName",
        F.date_format("EvaluationDateTime", "MMMM yyyy").alias("MonthYear"), F.lit(source).alias("PolicyHistorySource"))


def shred_policy_results(
    history: DataFrame, policies: DataFrame, loaded: DataFrame | None = None, category: str | None = None,
) -> DataFrame:
    """Rows of documents with targets only."""
    return shred_documents(history, policies, loaded, category, no_targets=False)


def shred_no_target_results(
    history: DataFrame, policies: DataFrame, loaded: DataFrame | None = None, category: str | None = None,
) -> DataFrame:
    """Rows of documents without any evaluation detail, under a fixed object name."""
    return shred_documents(history, policies, loaded, category, targets=False)


def shred_policy_errors(
    history: DataFrame, policies: DataFrame, errors: DataFrame | None = None, category: str | None = None,
) -> DataFrame:
    """Exception texts of documents whose (server, time, policy) is not in the error history yet."""
    keys = ["EvaluatedServer", "EvaluationDateTime", "EvaluatedPolicy"]
    rows = _of_known(details(history).filter(F.col("_instance") & (F.col("Exception") != "")), policies, category)
    if errors is not None:
        rows = rows.join(errors.select(*keys).distinct(), keys, "left_anti")
    return rows.select(*keys, F.col("Exception").alias("EvaluationResults"))


def load_policy_history(
    history: DataFrame, policies: DataFrame, loaded: DataFrame | None = None, errors: DataFrame | None = None,
    category: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """New detail rows (with and without targets) and new error rows of one load."""
    detail = shred_documents(history, policies, loaded, category)
    return detail, shred_policy_errors(history, policies, errors, category)


def policy_summary(detail: DataFrame) -> DataFrame:
    """Latest result per policy, server and object (inferred rule); combines on the map side."""
    keys = ["CategoryName", "Policy_id", "PolicyName", "EvaluatedServer", "ObjectName"]
    rows = detail.withColumnRenamed("EvaluatedPolicy", "PolicyName").withColumnRenamed("EvaluatedObject", "ObjectName")
    # Fixed-width values only, so that a hash aggregation combines them: time and id as one number, the result as its place.
    order = F.unix_micros(F.col("EvaluationDateTime").cast("timestamp")).cast("decimal(18,0)") * F.lit(str(10**19)).cast("decimal(20,0)") + F.col("PolicyHistoryID")
    place = F.array_position(F.array(*map(F.lit, RESULTS)), F.col("PolicyResult")).cast("int")
    latest = F.max_by(place, order)
    return rows.groupBy(*keys).agg(F.max("EvaluationDateTime").alias("EvaluationDateTime"), F.get(F.array(*map(F.lit, RESULTS)), latest - 1).alias("PolicyResult"))
