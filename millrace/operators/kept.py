"""Tables that several steps read, written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def keep(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the folder that spark.checkpoint.dir names, and read again; cuts its lineage. Only a local master, which has no other machines, may go without such a folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="millrace-"))
        folder = sc.getCheckpointDir()
    path = f"{folder.rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join that deals both sides by key. The size of a Parquet file says little about its rows in memory: tables that grow with the input and repeat their values would be broadcast, through the driver."""
    return df.hint("merge")
