"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: What separates words: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (local tests) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_swept: ContextVar[list | None] = ContextVar("swept", default=None)


class Scratch:
    """Tables written to the shared folder, so that a later step has no lineage to replay.

    Lost executors then cost a re-read rather than a recomputation.  ``drop`` deletes a
    superseded table at once; the rest stay, as lazy results read them, unless made inside
    :meth:`sweep`.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        if (made := _swept.get()) is not None:
            made.append(self)

    @classmethod
    @contextmanager
    def sweep(cls):
        """What is made inside goes at the end: for steps whose result is written by then."""
        token = _swept.set([])
        try:
            yield
        finally:
            for s in _swept.get():
                s._delete(s.root)
            _swept.reset(token)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            self._delete(path)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def slices(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about ``most_bytes`` (a single larger row stays whole)."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * most_bytes / max(batch.nbytes, 1)))
    for i in range(0, n, step):
        yield batch.slice(i, step)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], list], schema: str | StructType, most_bytes: int = 8 << 20) -> DataFrame:
    """Apply ``fn`` to bounded slices of each partition.

    ``fn`` gets a record batch and returns one sequence for each output column.
    """
    out = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for part in slices(batch, most_bytes):
                cols = fn(part)
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow
                )

    return df.mapInArrow(run, out)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names: other columns can't clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def spread_sample(rows: DataFrame, by: str, per: int, hashed: Column, room: int = 3) -> DataFrame:
    """At most ``per`` rows of each value of ``by``, those with the smallest ``hashed`` (a long); none for null.

    Counts come first and are joined back (a written table, whose size Spark knows); of each
    value only about ``room * per`` rows, by a cut in the range of the hash, then meet in a
    window.  So the window is small however large a value is, as long as rows differ in the
    hash: repeated rows are to be made distinct before.
    """
    span = 1 << 30
    sizes = Scratch(rows.sparkSession, "sample").write(rows.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__size")))
    cut = F.least(F.lit(span), F.floor(F.lit(room * per * span) / F.col("__size")) + 1)
    placed = rows.withColumn("__place", F.pmod(hashed, F.lit(span)))
    few = placed.join(sizes, placed[by] == sizes["__by"]).where(F.col("__place") < cut)
    order = Window.partitionBy(by).orderBy("__place", *[c for c in rows.columns if c != by])
    return few.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per).select(*rows.columns)


def file_bytes(path: str | os.PathLike) -> bytes:
    with open(path, "rb") as f:
        return f.read()
