"""A user's own function over chunks of rows, with a full account of what failed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from sparkloom.sources.shared import stored


@dataclass
class Chunked:
    """``rows``: what the function gave; ``chunks``: ``partition, chunk, n_rows, n_out, error`` of each chunk, error null if it went well."""

    rows: DataFrame
    chunks: DataFrame

    def failed(self) -> DataFrame:
        return self.chunks.where("error IS NOT NULL")


def over_chunks(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType, size: int = 10_000, most: int | None = None) -> Chunked:
    """Apply ``fn`` to frames of at most ``size`` rows of each partition.

    A chunk whose function raises, or gives a frame that the schema doesn't fit, is left out whole and named
    with its error; the others go on.  The function runs once for each chunk: both outputs
    read the same written table.  With ``most``, more failed chunks than that raise an error, after all have been tried.
    """
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    told = "partition int, chunk int, n_rows long, n_out long, error string"
    out = StructType().add("row", kind).add("told", _parse_datatype_string(told))
    arrow = to_arrow_schema(out)
    row_type, told_type = arrow.field("row").type, arrow.field("told").type
    fields = to_arrow_schema(kind)

    def frames(batches) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - n)
                held.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n == size:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    def run(batches):
        for chunk, table in enumerate(frames(batches)):
            made, error = None, None
            try:
                got = fn(table.to_pandas())
                made = pa.Table.from_pandas(got[list(fields.names)], schema=fields, preserve_index=False, safe=True).combine_chunks()
            except Exception as e:  # noqa: BLE001  told in the second output
                error = f"{type(e).__name__}: {e}"[:2000]
            n = made.num_rows if made is not None else 0
            if n:
                rows = pa.StructArray.from_arrays([made.column(i).combine_chunks() if made.column(i).num_chunks != 1 else made.column(i).chunk(0) for i in range(len(fields))], fields=list(row_type))
                yield pa.RecordBatch.from_arrays([rows, pa.nulls(n, told_type)], schema=arrow)
            said = {"partition": TaskContext.get().partitionId(), "chunk": chunk, "n_rows": table.num_rows, "n_out": n, "error": error}
            yield pa.RecordBatch.from_arrays([pa.nulls(1, row_type), pa.array([said], told_type)], schema=arrow)

    both = stored(df.mapInArrow(run, out), "chunks")
    done = Chunked(both.where("told IS NULL").select("row.*"), both.where("told IS NOT NULL").select("told.*"))
    if most is not None and (n := done.failed().count()) > most:
        raise RuntimeError(f"{n} chunks failed: {done.failed().first()['error']}")
    return done
