"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: dict[str, bool] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if _shipped.get(sc.applicationId):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tideline"), "tideline_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped[sc.applicationId] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own in a local session (tests); on a cluster that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tideline-checkpoint")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tideline-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    # Spark removes the shuffle files behind the table when the JVM collects what refers to them; ask for that now.
    gc.collect()
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._tideline_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Remove what materialize() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_tideline_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 64-bit key of a row that tells rows with the same doc_id but other texts apart."""
    return F.xxhash64(F.col(doc_id), F.col(text))


# Generators below are the outer ones, with a test for null after them: for the
# others Spark infers a filter on the array's size, and pushed to the scan it
# makes every array twice, within lambdas even once for each element.


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(column) -> list[str]:
    """The strings of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def text_slices(column, size: int = 500_000):
    """The strings of an Arrow column in lists of about size bytes at most (one string at least), so a batch isn't held twice as Python's strings."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64) + 64)
    start = 0
    while start < len(column):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield texts_of(column.slice(start, end - start))
        start = end


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it so that df has no column of it (in either case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def packed(df: DataFrame, *apart: str) -> tuple[DataFrame, list[Column]]:
    """df as a struct row of all columns but those of apart, and these; and the columns that give df back. No name that is added can clash with one of df's."""
    others = [c for c in df.columns if c not in apart]
    inner = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))
    back = [F.col(c) if c in apart else F.col("row")[c].alias(c) for c in df.columns]
    return df.select(inner.alias("row"), *[F.col(c) for c in apart]), back


def trimmed(run):
    """run (a function of an iterator of batches) for mapInArrow; what a task has freed goes back to the system at its end, since idle workers live on."""

    def wrapped(batches):
        yield from run(batches)
        import ctypes

        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # not the C library that has it

    return wrapped


def add_columns(df: DataFrame, fn, schema: str) -> DataFrame:
    """df with the columns that fn(RecordBatch) -> list of Arrow arrays makes; columns of the same names, in either case, are replaced."""
    import pyarrow as pa
    from pyspark.sql.types import StructType, _parse_datatype_string

    ship(df.sparkSession)
    new = _parse_datatype_string(schema)
    names = [f.name for f in new.fields]
    taken = {n.lower() for n in names}
    places = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in taken]
    kept = [df.schema.fields[i] for i in places]
    out = StructType(kept + list(new.fields))

    def run(batches):
        for batch in batches:
            made = fn(batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in places], *made], names=[f.name for f in kept] + names)

    return df.mapInArrow(trimmed(run), out)
