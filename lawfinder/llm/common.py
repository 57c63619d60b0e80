"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset and runs on one machine is a temporary folder made.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lawfinder-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The shared folder's own file system; Spark's checkpoint folder may be a URI or a plain path."""
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


#: Rows and bytes that a Python worker holds of its input at a time; a text longer than that is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to BATCH_ROWS and BATCH_BYTES where they are higher.

    Spark's default of 10,000 rows may be gigabytes where texts are long.
    """
    for name, most in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.max{name}PerBatch"
        now = re.sub(r"[^-\d]", "", spark.conf.get(key))
        if not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder, which outlives lost executors."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lf_path = path
    return out


def removed(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, when all that was to be read from them has been."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._lf_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def leaving(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, which still reads ``tables``; whoever stores its rows may then remove these by ``left_tables``."""
    df._lf_tables = tables
    return df


def left_tables(df: DataFrame) -> tuple[DataFrame, ...]:
    return getattr(df, "_lf_tables", ())


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; Spark removes it when nobody refers to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    bounded_batches(spark)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without columns whose names an operator is about to add (compared as Spark does, by any case)."""
    new = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in new])


def add_columns(df: DataFrame, inputs: Sequence[str], added: T.StructType, fn: Callable[..., list]) -> DataFrame:
    """Append what ``fn`` makes of the input columns, batch by batch, with all other columns passed through.

    ``fn`` is made anew in each task by calling it with no arguments; what it returns takes Arrow arrays
    and returns Arrow arrays or lists, one for each added field. A column of the input that has the name
    of an added one is replaced.
    """
    bounded_batches(df.sparkSession)
    kept = without(df, added.names)
    schema = T.StructType(kept.schema.fields + added.fields)
    names = kept.columns
    at = {n: [c.lower() for c in names].index(n.lower()) for n in inputs}
    kinds = [arrow_type(f.dataType) for f in added.fields]

    def run(batches):
        make = fn()
        for batch in batches:
            made = make(*[batch.column(at[n]) for n in inputs])
            made = [m if isinstance(m, (pa.Array, pa.ChunkedArray)) else pa.array(m, k) for m, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(list(batch.columns) + made, names=names + added.names)

    return kept.mapInArrow(run, schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as no bytes."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ids(df: DataFrame, column: str = "doc_id") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("long"))
