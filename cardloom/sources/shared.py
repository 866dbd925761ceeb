"""The folder that the driver and all executors share, tables stored there to cut lineage, and Arrow batches bounded by bytes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch; a row that is larger travels alone.
BATCH_BYTES = "2m"
#: Local folders by application, where the session names no shared one. A session's spark.checkpoint.dir can't be set once it runs.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a local folder of the application, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    name = spark.sparkContext.applicationId
    if name not in _local:
        _local[name] = tempfile.mkdtemp(prefix="cardloom-")
    return _local[name]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def arrow_ready(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded by bytes (unless it has a bound of its own): texts and pictures are large."""
    conf = df.sparkSession.conf
    if not conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df
