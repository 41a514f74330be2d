"""Table functions for SQL: segmenters by ``LATERAL``, views by a TABLE argument.

    SELECT d.doc_id, s.* FROM traces d, LATERAL segment_trace(d.text) s
    SELECT * FROM prefix_views(TABLE(records) PARTITION BY (doc_id), 4)

``register`` gives a session the functions.  Each says in ``analyze`` what it
returns and refuses arguments of other kinds before the query runs.  Null texts
and records have no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators import traces
from ..operators.layout import IGNORED


def _struct(**fields: DataType) -> StructType:
    """Built without a session: analyze runs in a Python worker."""
    return StructType([StructField(name, kind) for name, kind in fields.items()])


_INT, _STRING, _LONGS = IntegerType(), StringType(), ArrayType(LongType())
SEGMENT = _struct(start=_INT, end=_INT, kind=_STRING)
CRITERION = _struct(response=_STRING, number=_INT, kind=_STRING, status=_STRING, justification=_STRING)
CUT = _struct(cut=_INT)
VIEW = _struct(view=_INT, frontier=_INT, target_start=_INT, input=_LONGS, labels=_LONGS)


def _asked(argument: AnalyzeArgument, kind: type[DataType], what: str) -> None:
    if argument.isTable or not isinstance(argument.dataType, kind):
        raise ValueError(f"{what} must be of {kind.typeName()}")


def _of_texts(name: str, schema: StructType, scan) -> type:  # noqa: ANN001
    """A table function of one text, a row for all that scan gives for it."""

    class OfText:
        @staticmethod
        def analyze(text: AnalyzeArgument) -> AnalyzeResult:
            _asked(text, StringType, "the text")
            return AnalyzeResult(schema)

        def eval(self, text: str | None) -> Iterator[tuple]:
            yield from (scan(text) or []) if text is not None else []

    OfText.__name__ = OfText.__qualname__ = name
    return OfText


class SentenceCuts:
    """Cuts of a text between sentences, or between clauses too if soft."""

    @staticmethod
    def analyze(text: AnalyzeArgument, soft: AnalyzeArgument) -> AnalyzeResult:
        _asked(text, StringType, "the text")
        _asked(soft, BooleanType, "soft")
        return AnalyzeResult(CUT)

    def eval(self, text: str | None, soft: bool | None) -> Iterator[tuple]:
        if text is not None:
            yield from ((p,) for p in traces.cuts(text, bool(soft)))


class PrefixViews:
    """Views of the records of a table (key, prefix, ids, ends), each up to an
    even share of its chunks: the prefix, a marker, a place for each latent, the
    explicit ids up to there as targets, and an end marker.

    The table is partitioned by its first column, and every record of a
    partition gives its views."""

    LEFT, RIGHT, FILL = -1, -2, 0

    @staticmethod
    def analyze(records: AnalyzeArgument, views: AnalyzeArgument) -> AnalyzeResult:
        if not records.isTable:
            raise ValueError("the records must be a TABLE argument")
        kinds = {f.name: f.dataType for f in records.dataType}
        for name in ("prefix", "ids", "ends"):
            if not isinstance(kinds.get(name), ArrayType) or not isinstance(kinds[name].elementType, IntegerType | LongType):
                raise ValueError(f"the records need {name}, an array of integers")
        if views.isTable or not isinstance(views.dataType, IntegerType) or not views.value or views.value < 1:
            raise ValueError("the number of views must be a constant of at least 1")
        return AnalyzeResult(StructType([records.dataType.fields[0], *VIEW.fields]))

    def eval(self, record: Row, views: int) -> Iterator[tuple]:
        prefix, ids, ends = record["prefix"], record["ids"], record["ends"]
        if not ends or ids is None or prefix is None:
            return
        for view in range(views):
            frontier = max(1, min(len(ends), -(-len(ends) * (view + 1) // views)))
            start = [*prefix, self.LEFT, *[self.FILL] * frontier]
            target = [*ids[: ends[frontier - 1]], self.RIGHT]
            yield record[0], view, frontier, len(start), start + target, [IGNORED] * len(start) + target


FUNCTIONS = {
    "segment_trace": _of_texts("SegmentTrace", SEGMENT, traces.segments),
    "trace_criteria": _of_texts("TraceCriteria", CRITERION, traces.criteria),
    "sentence_cuts": SentenceCuts,
    "prefix_views": PrefixViews,
}


def register(spark: SparkSession) -> SparkSession:
    """The session, with the table functions of FUNCTIONS by their names."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function))
    return spark
