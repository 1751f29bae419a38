"""Shared plumbing: scratch tables in the cluster's shared folder, Arrow maps over text columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of text that a function of texts gets at once, unless one text alone is longer.
SLICE_ROWS, SLICE_BYTES = 500, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only where it is unset and there are
    no other executors, as in tests, a temporary folder takes its place."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kvspark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_ROOTS: list[str] = []


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB, where the session has no bound of its own. Results are computed after
    they are returned, so the setting stays; one that the user made is left alone."""
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(SLICE_BYTES))


def _delete(path: str) -> None:
    jvm = SparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    conf = SparkContext._active_spark_context._jsc.hadoopConfiguration() if SparkContext._active_spark_context else jvm.org.apache.hadoop.conf.Configuration()
    at.getFileSystem(conf).delete(at, True)


@atexit.register
def clear() -> None:
    """Remove all scratch tables of this process. Results that were not read or written yet need
    them, so that they stay until the process ends, unless this is called before."""
    while _ROOTS:
        root, process = _ROOTS.pop(), getattr(SparkContext._gateway, "proc", None)
        if process is not None and process.poll() is None:
            _delete(root)


class Scratch:
    """Tables and files of one operator run, below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bounded_batches(spark)
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _ROOTS.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write as Parquet and read again: cuts the lineage, survives lost executors."""
        df.write.mode("overwrite").parquet(self.path(name), compression=compression)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        _delete(self.path(name))


#: A key with more than this share of the rows is hot.
_HOT_SHARE = 1 / 1024


def split_hot(unique: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """A row a key, with n of the rows in each -> (hot, cold). Hot are keys of more than one row and
    of over 1/1024 of all: fewer than 1,024, which may be broadcast."""
    is_hot = F.col("n") > max(1.0, rows * _HOT_SHARE)
    return unique.where(is_hot), unique.where(~is_hot)


def meet(rows: DataFrame, unique: DataFrame, key: str) -> DataFrame:
    """rows joined with the one row of ``unique`` for their key. ``unique`` holds every key of rows,
    once, and in n how many rows have it; both are written tables. Rows of hot keys stay where they
    are, so no task gets much more than others."""
    total = unique.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    hot, cold = (part.drop("n") for part in split_hot(unique, total))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rest.unionByName(rows.join(F.broadcast(hot), key))


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of bounded rows and bytes of this column, whatever the session's settings
    made it. They share its memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and (held + n > SLICE_BYTES or i - begin >= SLICE_ROWS):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def map_texts(
    df: DataFrame,
    text_col: str,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[list[bytes | None]], list[pa.Array]]],
    keep: Iterable[str] | None = None,
) -> DataFrame:
    """Append columns computed from the text, slice by slice. ``make`` runs once in each task
    and returns the function from texts (None: null) to the new columns.

    keep: columns passed through (all by default). A kept column whose name, in any case, is
    that of a new one gives way to it.
    """
    bounded_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))
    text_name = "__text"
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias(text_name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in (part for whole in batches for part in slices(whole, len(kept))):
            got = function(as_bytes(batch.column(len(kept))))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), *got],
                names=[*kept, *(f.name for f in fields)],
            )

    return source.mapInArrow(run, schema)
