"""Stages of the caller's own: functions over records, and summaries over all of them.

`resolving` makes a stage of a function that gives none, one or many records for
each record; it runs as a table function whose result type is worked out from the
rows it is given and the fields it declares. `summarising`
makes a stage of a summary with start, add, merge and finish: tasks fold their
own records, and states meet in groups of bounded size until one is left.
"""

from __future__ import annotations

import pickle
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from .pipeline import Context, stage

MEET = 64  # states merged in one task


def resolving(name: str, f, fields: str = "", doc: str = "") -> None:
    """Registers f(record: dict, **arguments) -> None, a dict or an iterable of dicts, as a stage.

    A dict's fields replace the record's own; what it leaves out stays. fields: the
    types of those that are new or change their type, as "name type, ..".
    """
    declared = T.StructType.fromDDL(fields) if fields else T.StructType()

    def apply(df: DataFrame, arguments: dict = None, ctx: Context = None) -> DataFrame:
        return resolve(df, f, declared, arguments or {})

    apply.__doc__ = doc or f.__doc__
    stage(name)(apply)


def resolve(df: DataFrame, f, fields: str | T.StructType = "", arguments: dict | None = None) -> DataFrame:
    """As resolving, at once."""
    ship(df.sparkSession)
    declared = T.StructType.fromDDL(fields) if isinstance(fields, str) and fields else fields or T.StructType()
    given, extra = arguments or {}, [x for x in declared if x.name not in df.columns]
    changed = {x.name: x for x in declared}
    schema = T.StructType([*[changed.get(x.name, x) for x in df.schema], *extra])
    names, packed = schema.names, schema.json()

    @F.udtf
    class Records:
        @staticmethod
        def analyze(table):
            from pyspark.sql.udtf import AnalyzeResult

            return AnalyzeResult(schema=T.StructType.fromJson(__import__("json").loads(packed)))

        def eval(self, row):
            record = row.asDict(recursive=True)
            out = f(dict(record), **given)
            if out is None:
                return
            for new in [out] if isinstance(out, dict) else out:
                if new is not None:
                    whole = record | new
                    yield tuple(whole.get(c) for c in names)

    view = f"records_{uuid.uuid4().hex}"
    df.sparkSession.udtf.register(view, Records)
    return df.sparkSession.sql(f"SELECT * FROM {view}(TABLE({{rows}}))", rows=df)


class Summary:
    """What a summary has; merge must not depend on the order of states."""

    def start(self):
        raise NotImplementedError

    def add(self, state, record: dict):
        raise NotImplementedError

    def merge(self, a, b):
        raise NotImplementedError

    def finish(self, state) -> dict:
        return state


def summarising(name: str, summary: Summary, fields: str, doc: str = "") -> None:
    """Registers a summary as a stage that gives one row of these fields."""

    def apply(df: DataFrame, ctx: Context = None) -> DataFrame:
        return summarise(df, summary, fields)

    apply.__doc__ = doc or type(summary).__doc__
    stage(name)(apply)


def summarise(df: DataFrame, summary: Summary, fields: str) -> DataFrame:
    """One row of the fields: the summary of all records, of none for an empty table."""
    spark = df.sparkSession
    ship(spark)
    out = T.StructType.fromDDL(fields)
    states = pa.schema([("part", pa.int64()), ("state", pa.binary())])
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema

    def fold(batches):
        state = summary.start()
        for batch in batches:
            for record in batch.to_pylist():
                state = summary.add(state, record)
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "state": pickle.dumps(state)}], states)

    def meet(batches):
        now, state = None, None
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != now and state is not None:
                    yield pa.RecordBatch.from_pylist([{"part": now, "state": pickle.dumps(state)}], states)
                    state = None
                now, one = part, pickle.loads(packed)
                state = one if state is None else summary.merge(state, one)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"part": now, "state": pickle.dumps(state)}], states)

    def finish(batches):
        state = summary.start()
        for batch in batches:
            for packed in batch.column(1).to_pylist():
                state = summary.merge(state, pickle.loads(packed))
        yield pa.RecordBatch.from_pylist([summary.finish(state)], to_arrow_schema(out))

    folded = df.mapInArrow(fold, "part long, state binary")
    many = df.rdd.getNumPartitions()
    while many > MEET:
        many = -(-many // MEET)
        folded = folded.withColumn("part", F.floor(F.col("part") / MEET)).repartition(many, "part").sortWithinPartitions("part").mapInArrow(meet, "part long, state binary")
    return folded.repartition(1).mapInArrow(finish, out)  # of at most MEET states
