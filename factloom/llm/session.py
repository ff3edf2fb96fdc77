"""What every operator needs of the Spark session."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is set and driver and executors are one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
        found = jsc.getCheckpointDir().get()
    return found


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df from files in the shared folder: lost executors cost no recomputation and the lineage ends here."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
