"""Tables written once in the folder that driver and executors share, so that what stands before them is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if driver and executors are one process (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-gleaner-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own; a lost executor costs no recomputation of what stands before."""
    path = f"{shared_dir(df.sparkSession)}/gleaner-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that stored() gave and that no frame still to be computed reads, so that a long job's disk holds only what it needs."""
    for table in tables:
        jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("gleaner-"):
                path.getFileSystem(conf).delete(path, True)


def clear(spark: SparkSession) -> int:
    """Delete all scratch tables of the shared folder, once their results have been read; returns how many there were."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(root) if f.getPath().getName().startswith("gleaner-")]
    for path in found:
        files.delete(path, True)
    return len(found)
