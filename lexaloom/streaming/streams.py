"""Structured Streaming forms: running counts, tweet annotation and segment sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.arrays import ngrams
from ..functions.text import tokenize

TWEETS = "tweet_id string, ts string, user_id string, user_name string, user_desc string, tweet string, tweet_ner string"


def tweet_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of tab-separated tweets."""
    return spark.readStream.schema(TWEETS).option("sep", "\t").option("quote", "").csv(path)


def running_ngrams(texts: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), text: str = "text") -> DataFrame:
    """ngram, cnt so far; for update or complete mode. State grows with the vocabulary."""
    tokens = tokenize(F.col(text))
    return texts.select(F.explode(F.concat(*[ngrams(tokens, n) for n in sizes])).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("cnt"))


def windowed_ngrams(events: DataFrame, text: str, ts: str = "ts", length: str = "1 hour", late: str = "10 minutes", n: int = 1) -> DataFrame:
    """start, ngram, cnt of event-time windows; late rows are dropped after the watermark. An extension."""
    rows = events.withWatermark(ts, late).select(ts, F.explode(ngrams(tokenize(F.col(text)), n)).alias("ngram"))
    return rows.groupBy(F.window(ts, length).alias("w"), "ngram").agg(F.count(F.lit(1)).alias("cnt")).select(F.col("w.start").alias("start"), "ngram", "cnt")


def tweet_mentions(text: Column) -> Column:
    """array<struct<mention, start, end>> of runs of capitalised words, as a stand-in for a recogniser, and of handles and hashtags."""
    named = F.regexp_extract_all(text, F.lit(r"[@#]\w+|\b[A-Z]\w+(?: [A-Z]\w+)*"), F.lit(0))
    return F.transform(F.array_distinct(named), lambda m: F.struct(F.regexp_replace(m, "^[@#]", "").alias("mention"), (F.call_function("instr", text, m) - 1).alias("start"), (F.call_function("instr", text, m) - 1 + F.length(m)).alias("end")))


def annotated(tweets: DataFrame, links: DataFrame, key: str = "tweet_id", text: str = "tweet") -> DataFrame:
    """key, mention, start, end, uri, text: stateless join of a stream of tweets with static links(mention, uri), append mode."""
    m = tweets.select(key, F.col(text).alias("text"), F.explode(tweet_mentions(F.col(text))).alias("m"))
    return m.select(key, F.col("m.mention").alias("mention"), F.col("m.start").alias("start"), F.col("m.end").alias("end"), "text").join(links.select("mention", "uri"), "mention").select(key, "mention", "start", "end", "uri", "text")


def segment_sets(segmented: DataFrame, key: str = "tweet_id") -> DataFrame:
    """segment, tweets: which tweets have a segment, so far; update mode."""
    return segmented.select(key, F.explode("segments").alias("segment")).groupBy("segment").agg(F.collect_set(key).alias("tweets"))


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> StreamingQuery:
    """Everything available to a table in memory, then stop; for batches of a stream and for tests."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return q
