"""Where a plan's lineage ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Of applications on one machine whose session names no folder.
_stand_ins: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which ``spark.checkpoint.dir`` names.

    Where that is unset, a temporary folder stands in for it on one machine; on
    a cluster that would be each machine's own, and raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _stand_ins.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tracewell-")
        _stand_ins[spark.sparkContext.applicationId] = root
    return root.rstrip("/")


def _cuts(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/cuts/{spark.sparkContext.applicationId}"


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` computed once, written to the shared folder, and read back: what is planned on top does not repeat them."""
    spark = rows.sparkSession
    path = f"{_cuts(spark)}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete what this application has cut; for when no plan made of it is still to run."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_cuts(spark))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
