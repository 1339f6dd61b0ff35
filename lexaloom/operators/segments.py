"""Tweet segmentation: stickiness of segments, and a walk over segments that share tweets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import ngram_scp, stickiness, unigram_scp
from ..functions.text import segmentations, words

UNITS = 1e12  # of a score, which add up exactly


def segment_scores(phrases: DataFrame, counts: DataFrame, wiki: DataFrame) -> DataFrame:
    """phrase, n, scp, wiki, stickiness of phrases(phrase) by n-gram counts and wiki(phrase, prob)."""
    p = phrases.select("phrase").distinct().withColumn("w", F.split("phrase", " "))
    c = counts.select("ngram", "cnt")
    cuts = p.where(F.size("w") > 1).select("phrase", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"), "w").select("phrase", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("a"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("b"))
    products = cuts.join(c.select(F.col("ngram").alias("a"), F.col("cnt").alias("ca")), "a", "left").join(c.select(F.col("ngram").alias("b"), F.col("cnt").alias("cb")), "b", "left").groupBy("phrase").agg(F.collect_list(F.coalesce("ca", F.lit(0)).cast("double") * F.coalesce("cb", F.lit(0))).alias("products"))
    j = p.join(c.select(F.col("ngram").alias("phrase"), "cnt"), "phrase", "left").join(products, "phrase", "left").join(wiki.select("phrase", "prob"), "phrase", "left")
    n, cnt, prob = F.size("w"), F.coalesce("cnt", F.lit(0)), F.coalesce("prob", F.lit(0.0))
    scp = F.when(n == 1, unigram_scp(cnt)).otherwise(ngram_scp(cnt, F.col("products")))
    return j.select("phrase", n.cast("long").alias("n"), scp.alias("scp"), prob.alias("wiki"), stickiness(n, prob, scp).alias("stickiness"))


def ranked_segmentations(tweets: DataFrame, counts: DataFrame, wiki: DataFrame, *, key: str = "tweet_id", text: str = "text", most_words: int = 10) -> DataFrame:
    """key, segments, score, rank of every segmentation of each text of up to most_words words, and of the best one of longer
    texts, whose segmentations double with every word. Texts without words have none; repeated rows count once.

    Only segments are joined with their scores, at most five a word; a text's segmentations are scored and ranked within its row.
    Scores add up in units of 1e-12, so that segmentations into the same parts tie whatever their order; ties go by the parts.
    """
    tokens = tweets.select(key, words(F.lower(text)).alias("w")).where(F.size("w") > 0).distinct()
    starts = tokens.select(key, "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    spans = starts.select(key, "w", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(5), F.size("w") - F.col("i") + 1))).alias("k")).withColumn("segment", F.array_join(F.slice("w", F.col("i"), F.col("k")), " "))
    scores = segment_scores(spans.select(F.col("segment").alias("phrase")), counts, wiki).select(F.col("phrase").alias("segment"), "stickiness")
    scored = spans.join(scores, "segment", "left").withColumn("s", F.round(F.coalesce("stickiness", F.lit(0.0)) * UNITS).cast("long"))
    short, long = scored.where(F.size("w") <= most_words), scored.where(F.size("w") > most_words)
    listed = short.groupBy(key, "w").agg(F.map_from_entries(F.collect_set(F.struct("segment", "s"))).alias("of"))
    negative = lambda parts: F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a - F.element_at("of", x))
    ways = F.transform(segmentations(F.col("w"), most_words=most_words), lambda p: F.struct(negative(p).alias("loss"), F.array_join(p, "/").alias("joined"), p.alias("segments")))
    total = listed.select(key, F.posexplode(F.array_sort(ways)).alias("rank", "way")).select(key, "way.segments", (-F.col("way.loss") / UNITS).alias("score"), F.col("rank").cast("long"))
    placed = long.groupBy(key, "w").agg(F.collect_list(F.struct("i", "k", "s")).alias("parts"))
    best = placed.select(key, "w", "parts").mapInArrow(_best_segmentations, f"{key} {dict(tweets.dtypes)[key]}, segments array<string>, score double")
    return total.union(best.withColumn("rank", F.lit(0).cast("long")))


def _best_segmentations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best cut of each text's words: none but the last part of five words, ties to the least text as in the ranking."""
    for b in batches:
        segments, scores = [], []
        for w, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            score = {(p["i"] - 1, p["k"]): p["s"] for p in parts}
            best = [(0, "", ())]  # of the first words: score (negative), joined parts, parts
            for end in range(1, len(w) + 1):
                ways = []
                for k in range(1, min(end, 5 if end == len(w) else 4) + 1):
                    s, joined, before = best[end - k]
                    part = " ".join(w[end - k : end])
                    ways.append((s - score[end - k, k], f"{joined}/{part}", (*before, part)))
                best.append(min(ways))
            segments.append(list(best[-1][2]))
            scores.append(-best[-1][0] / UNITS)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(segments, pa.list_(pa.string())), pa.array(scores, pa.float64())], names=[b.schema.names[0], "segments", "score"])


def segment_tweets(segmented: DataFrame, key: str = "tweet_id") -> DataFrame:
    """segment, key: which tweets have which segment, once each."""
    return segmented.select(F.explode("segments").alias("segment"), key).distinct()


def segment_jaccard(pairs: DataFrame, key: str = "tweet_id") -> DataFrame:
    """a, b, weight: shared over all tweets of each two segments that share one, both directions; from pair counts and sizes."""
    size = pairs.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.select(key, F.col("segment").alias("a")).join(pairs.select(key, F.col("segment").alias("b")), key).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("i"))
    j = both.join(size.select(F.col("segment").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("segment").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("weight"))


def transition(jaccard: DataFrame) -> DataFrame:
    """a, b, p: rows that sum to 1; a segment without company has none."""
    return jaccard.withColumn("p", F.try_divide(F.col("weight"), F.sum("weight").over(Window.partitionBy("a")))).select("a", "b", "p")


def segment_walk(blocks: DataFrame, wiki: DataFrame, gamma: float = 0.15, *, block: str = "block", key: str = "tweet_id") -> DataFrame:
    """block, segment, p, score: the walk over each block's segments and its product with the teleport probability.

    blocks(block, tweet_id, segments). A block is a bounded batch of tweets, one group. The teleport vector stands
    in every row of the matrix; the walk starts evenly, ends after 1000 steps or a change of its norm below 1e-5.
    """
    pairs = blocks.select(block, key, F.explode("segments").alias("segment")).distinct()
    tele = pairs.select(F.col("segment").alias("phrase")).distinct().join(wiki.select("phrase", "prob"), "phrase", "left").select(F.col("phrase").alias("segment"), F.exp(F.coalesce("prob", F.lit(0.0))).alias("t"))
    per = pairs.join(tele, "segment").groupBy(block, "segment").agg(F.max("t").alias("t"), F.collect_set(key).alias("tweets")).groupBy(block).agg(F.array_sort(F.collect_list(F.struct("segment", "t", "tweets"))).alias("segments"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, segments in zip(b[block], b["segments"], strict=True):
                n = len(segments)
                ids = {t: k for k, t in enumerate(sorted({t for s in segments for t in s["tweets"]}))}
                m = np.zeros((n, len(ids)))
                for k, s in enumerate(segments):
                    m[k, [ids[t] for t in s["tweets"]]] = 1
                both, size = m @ m.T, m.sum(1)
                jac = both / (size[:, None] + size[None, :] - both)
                np.fill_diagonal(jac, 0)
                total = jac.sum(1, keepdims=True)
                p = np.divide(jac, total, out=np.zeros_like(jac), where=total > 0)
                t = np.array([s["t"] for s in segments])
                t /= t.sum()
                full = (1 - gamma) * p.T + gamma * np.tile(t, (n, 1))
                pi, before = np.full(n, 1 / n), 0.0
                for _ in range(1000):
                    pi = full @ pi
                    norm = float(np.linalg.norm(pi))
                    pi /= norm
                    if before and abs(norm - before) < 1e-5:
                        break
                    before = norm
                out += [(name, s["segment"], float(x), float(x * y)) for s, x, y in zip(segments, pi, t, strict=True)]
            yield pd.DataFrame(out, columns=[block, "segment", "p", "score"])

    return per.mapInPandas(run, f"{block} {dict(blocks.dtypes)[block]}, segment string, p double, score double")
