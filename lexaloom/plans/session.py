"""Session settings and shared storage."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 16 << 20  # of tables that are measured first


@dataclass(frozen=True)
class Tables:
    """The names of the serving tables, and what annotators are reached by."""

    ngrams: str = "ngrams"
    patterns: str = "typogram"
    anchors: str = "wiki_anchors"
    urls: str = "wiki_urls"
    edges: str = "wiki_edges"
    pagelinks: str = "TL"
    mention_cooccurrence: str = "CC"
    cooccurrence: str = "LL"
    debug: bool = False
    pos_host: tuple[str, int] = ("localhost", 9191)
    ner_host: tuple[str, int] = ("localhost", 9192)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.table(getattr(self, name))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; one of our own only on a local master where none is set."""
    found, master = spark.sparkContext.getCheckpointDir(), spark.sparkContext.master
    if not found:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexaloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, stored in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """As checkpointed, as a Parquet table whose size the planner knows, so that it picks the joins by it; it goes with the application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(found)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joinable(many: DataFrame, few: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides of a join, `few` broadcast up to BROADCAST_BYTES, measured, and `many` never.

    What a table makes by explosion has the planner's size of what is read, far below its own; it would be sent to the
    driver. `few` is read for it, so it should be stored.
    """
    text = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in few.dtypes if kind == "string"]
    size = few.agg(F.sum(sum(text, F.lit(16 * len(few.columns))))).first()[0] or 0
    return (many, F.broadcast(few)) if size <= BROADCAST_BYTES else (many.hint("merge"), few)
