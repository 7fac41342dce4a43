"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tracewell.functions.lineage import shared_folder


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path below the folder that driver and executors share."""
    return f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once in an application, so that they need no install."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="tracewell-code-")) / "tracewell-code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, f"{package.name}/{source.relative_to(package)}")
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables in the shared folder that end a plan's lineage, and go when they are no longer read."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = scratch_dir(spark)
        self.paths: list[tuple[DataFrame, str]] = []

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back."""
        path = f"{self.root}/{len(self.paths)}"
        df.write.parquet(path)
        held = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((held, path))
        return held

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables from which nothing that is still to run reads."""
        for held, path in self.paths:
            if any(held is t for t in tables):
                remove(self.spark, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    Its cleaner follows the driver's garbage collection, which else may come
    only when the disks are full. Call it where a large exchange has served.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    return Scratch(df.sparkSession).table(df)


def annotate(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[..., Sequence]],
    keep: Sequence[str] | None = None,
    slice_rows: int = 2048,
) -> DataFrame:
    """Add columns computed by Python from ``inputs``, batch by batch.

    ``make`` runs once in each task and returns a function of as many lists as
    there are inputs; that function returns one list (or Arrow array) per field.
    ``keep`` names the columns that pass through, all by default; one that has
    the name of a new field is replaced by it.
    """
    ship(df.sparkSession)
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    arrow = [pa.field(f.name, to_arrow_type(f.dataType)) for f in fields]
    # An input that passes through anyway is sent once.
    apart = [c for c in dict.fromkeys(inputs) if c not in kept]
    source = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(apart)])
    schema = T.StructType([source.schema[c] for c in kept] + list(fields))
    place = [kept.index(c) if c in kept else len(kept) + apart.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(at, slice_rows)
                columns = [batch.column(i) for i in range(len(kept))]
                taken = [batch.column(i).to_pylist() for i in place]
                made = [
                    x if isinstance(x, pa.Array) else pa.array(x, a.type)
                    for x, a in zip(f(*taken), arrow, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(columns + made, names=[*kept, *(a.name for a in arrow)])
                del taken, made, columns, batch
            del whole
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)


_remembered: dict = {}


def remembered(build: Callable, *args):
    """``build(*args)``, kept for the worker's next tasks until any other such value is asked for: a worker holds one."""
    if _remembered.get("of") != (build, args):
        _remembered.clear()
        value = build(*args)
        _remembered.update(of=(build, args), value=value)
    return _remembered["value"]


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def by_hash(share: float, *columns: str) -> Column:
    """True for about ``share`` of all different values of ``columns``, the same ones every time.

    For drawing a bounded training sample without sorting a whole table.
    """
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(*columns) < F.lit(int(-(2**63) + share * 2**64))


def hash_sample(rows: DataFrame, size: int, *columns: str) -> DataFrame:
    """About ``size`` rows at most: the first in a hash order of ``columns``, of equal hashes one.

    Only hashes of about twice the wanted share are sorted, to find the last one
    that is taken; the rows themselves are filtered where they are read. Equal
    values of ``columns`` are one row, so repeated rows cannot crowd the sample.
    """
    share = 2 * size / max(rows.count(), 1)
    hashed = rows.withColumn("__hash", F.xxhash64(*columns))
    near = hashed.where(by_hash(share, *columns)).select("__hash").distinct().orderBy("__hash").limit(size)
    last = near.agg(F.max("__hash")).first()[0]
    if last is None:
        return rows.limit(0)
    return hashed.where(F.col("__hash") <= last).dropDuplicates(["__hash"]).drop("__hash")
