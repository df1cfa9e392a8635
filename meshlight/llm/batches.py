"""Columns computed per row from a text column, Arrow batch by Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_TEXT = "__llm_text"


def text_of(column: str) -> F.Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns of ``df`` that do not carry one of the names (compared as Spark does, without case)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def appended(
    df: DataFrame,
    text: str,
    fields: str,
    compute: Callable[[pa.Array], dict[str, object]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` with the columns of the DDL string ``fields``, computed from the text of each batch.

    ``keep`` names the columns to carry along (all by default). An input column that has the name of
    a computed one is replaced.
    """
    added = StructType.fromDDL(fields)
    carried = without(df.select(*[f"`{c}`" for c in keep]) if keep is not None else df, added.fieldNames())
    rows = df.select(*[F.col(f"`{c}`") for c in carried], text_of(text).alias(_TEXT))
    schema = StructType([*df.select(*[f"`{c}`" for c in carried]).schema.fields, *added.fields])
    names = added.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(batch.column(batch.num_columns - 1))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [x if isinstance(x := made[n], pa.Array) else pa.array(x) for n in names]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *names])
        pa.default_memory_pool().release_unused()  # workers live on after the task

    return rows.mapInArrow(run, schema)
