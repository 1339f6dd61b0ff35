"""Writers of the corpora's file formats and serving tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import pack


def write_tsv(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value")).write.mode("overwrite").text(path)


def write_packed(df: DataFrame, path: str, key: str, value: str, cnt: str = "cnt") -> None:
    """key and its packed list, most frequent first."""
    item = F.struct((-F.col(cnt)).alias("n"), F.col(value).alias("v"))
    lists = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["v"].alias("key"), (-x["n"]).alias("value"))).alias("l"))
    write_tsv(lists.select(key, pack(F.col("l")).alias("l")), path)


def write_table(df: DataFrame, name: str, key: str, buckets: int = 64, max_words: int | None = None) -> None:
    """A serving table bucketed and sorted by its key, in place of one of the same name; with max_words, of keys that long."""
    if max_words is not None:
        df = df.where(F.size(F.split(key, " ")) <= max_words)
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def write_features(features: DataFrame, path: str, group: tuple[str, ...] = ("doc_id", "mention")) -> None:
    """A header and rows; the group columns tell candidates of one mention."""
    order = F.xxhash64(*group)
    features.withColumn("candidate", order).sortWithinPartitions("candidate").write.mode("overwrite").csv(path, sep="\t", header=True)


def write_annotations(rows: DataFrame, path: str) -> None:
    """tweet_id, mention, start, end, uri, text of linked mentions."""
    write_tsv(rows.where("uri IS NOT NULL").select("tweet_id", "mention", "start", "end", "uri", "text"), path)


def write_unranked(rows: DataFrame, path: str) -> None:
    write_tsv(rows.distinct(), path)


def write_pair_log(judged: DataFrame, path: str) -> None:
    """truth, predicted of each mention."""
    judged.select(F.concat_ws(", ", F.coalesce("true_uri", F.lit("None")), F.coalesce("uri", F.lit("None"))).alias("value")).write.mode("overwrite").text(path)


def write_contexts(contexts: DataFrame, path: str) -> None:
    """Five-token contexts, a line each."""
    contexts.select(F.array_join("context", " ").alias("value")).write.mode("overwrite").text(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
