"""Helpers shared by the operators: texts in Arrow batches, new columns, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# fixed values: the characters that separate words, and bytes inside a code point
WHITE_SPACE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))

Texts = list[bytes]


def byte_texts(column: pa.Array) -> Texts:
    """UTF-8 texts of a string column; null is the empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def fresh_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def with_struct(
    df: DataFrame, text: str, fields: str, make: Callable[[], Callable[[Texts], list]], keep: list[str]
) -> tuple[DataFrame, str]:
    """Columns ``keep`` of ``df`` and one struct computed from each text.

    ``make`` is called once per task and returns the function that turns a list
    of texts into one list or Arrow array for each field.  Returns the table and the name of
    the new column, which clashes with none that ``df`` has.
    """
    name = fresh_name(df, "found")
    kind = T.StructType.fromDDL(fields)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, kind)])
    arrow = to_arrow_schema(schema, prefers_large_types=False)
    struct = arrow.field(name).type

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in incoming:
            made = work(byte_texts(batch.column(batch.num_columns - 1)))
            arrays = [a.cast(f.type) if isinstance(a, pa.Array) else pa.array(a, type=f.type) for a, f in zip(made, struct, strict=True)]
            found = pa.StructArray.from_arrays(arrays, fields=list(struct))
            kept = batch.columns[: len(keep)]
            yield pa.RecordBatch.from_arrays([*kept, found], names=arrow.names)

    # Spark looks its input up by name, and a name may hold dots
    chosen = [F.col(quoted(c)).alias(f"kept_{i}") for i, c in enumerate(keep)]
    rows = df.select(*chosen, F.col(quoted(text)).cast("string").alias("kept_text"))
    return rows.mapInArrow(run, schema), name


def quoted(name: str) -> str:
    """A column name that may hold dots."""
    return "`" + name.replace("`", "``") + "`"


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of an id written as text, modulo ``divisor``."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(divisor)


def bounded_sample(labelled: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled rows, those whose hashed keys are smallest."""
    return labelled.orderBy(F.xxhash64(key), key).limit(rows)
