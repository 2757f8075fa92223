"""Tables kept between the steps of an iterative operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def kept(df: DataFrame) -> DataFrame:
    """Written and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:  # tests
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        folder = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="vellum-"))
    path = f"{folder.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_arrow(spark: SparkSession, mebibytes: int = 4) -> None:
    """Batches sent to Python workers hold at most so many MiB, whatever the rows' length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mebibytes << 20))
