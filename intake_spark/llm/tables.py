"""Small shared helpers: named input tables, and columns that an operator adds beside whatever a table already has."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound what Spark hands to a Python worker at once by bytes: ten thousand long texts, the usual batch, can be a gigabyte."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def in_arrow(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], Iterator[dict]]) -> DataFrame:
    """``mapInArrow`` for a function that yields dicts of columns; ``schema`` is a DDL string."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for columns in work(batch):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in
                     ((columns[f.name], f) for f in target)], schema=target)

    return df.mapInArrow(run, schema)


def keeps_names(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators whose own columns begin with two underscores: a table's columns of such names are put aside meanwhile."""
    @functools.wraps(work)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        aside = {c: f"column {k} {c}" for k, c in enumerate(docs.columns) if c.startswith("__")}
        if not aside:
            return work(docs, *args, **named)
        now = lambda v: aside.get(v, v) if isinstance(v, str) else v
        out = work(docs.withColumnsRenamed(aside), *map(now, args), **{k: now(v) for k, v in named.items()})
        return out.withColumnsRenamed({v: k for k, v in aside.items()})

    return run
