"""Row-local operators: Arrow batches in, the kept columns and new ones out."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


PIECE_BYTES = 2_000_000


def tidy(run: Callable) -> Callable:
    """The same batches; when the task is over, the worker gives free memory back before it waits for the next."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)
    return tidied


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in consecutive pieces of about PIECE_BYTES, at least a row each."""
    if batch.num_rows:
        step = max(1, int(batch.num_rows * PIECE_BYTES / max(batch.nbytes, 1)))
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


def neutral(df: DataFrame, text: str) -> tuple[DataFrame, str]:
    """df with its columns named by their place, so that no new field replaces one, and the name `text` has then."""
    same = [i for i, c in enumerate(df.columns) if c == text] or [i for i, c in enumerate(df.columns) if c.lower() == text.lower()]
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]), f"_c{same[0]}"


def append(df: DataFrame, reads: list[str], keep: list[str] | None, fields: str,
           work: Callable[..., list]) -> DataFrame:
    """Kept columns of df plus the fields that `work` makes of the columns read.

    `work` gets one Arrow array per column in `reads` and returns one array or
    list per field. `keep` None keeps all; a kept column that has the name of
    a new field is replaced. Only the columns named leave the JVM, each of them
    once, also one that is kept and read. No shuffle.
    """
    new = StructType.fromDDL(fields)
    kept = [c for c in (df.columns if keep is None else keep) if c not in new.names]
    schema = StructType([df.schema[c] for c in kept] + new.fields)
    types = to_arrow_schema(new).types
    more = [c for c in dict.fromkeys(reads) if c not in kept]
    sent = df.select(*[f"`{c}`" for c in kept], *[df[f"`{c}`"].alias(f"_in{i}") for i, c in enumerate(more)])
    at = [[*kept, *more].index(c) for c in reads]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole)):
            made = work(*[batch.columns[i] for i in at])
            arrays = [a if isinstance(a, pa.Array) and a.type == t else
                      a.cast(t) if isinstance(a, pa.Array) else pa.array(a, type=t, from_pandas=False)
                      for a, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], *arrays], names=names)

    return sent.mapInArrow(tidy(run), schema)
