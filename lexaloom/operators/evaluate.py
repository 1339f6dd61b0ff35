"""Linking metrics and their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentence_key


def judged(truth: DataFrame, predicted: DataFrame, on: list[str]) -> DataFrame:
    """on, true_uri, exists, uri: every truth with its prediction, and predictions of unseen truth as they are."""
    t = truth.select(*on, F.col("uri").alias("true_uri"), "exists")
    return t.join(predicted.select(*on, "uri"), on, "full_outer").select(*on, "true_uri", F.coalesce("exists", F.lit(True)).alias("exists"), "uri")


def link_metrics(rows: DataFrame, known_only: bool = False) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of rows(true_uri, exists, uri); known_only leaves out null truths.

    A prediction for a null truth is a false positive; a missing one counts only if the truth exists in the knowledge base.
    """
    rows = rows.where("true_uri IS NOT NULL") if known_only else rows
    same = F.col("uri").eqNullSafe(F.col("true_uri"))
    none = F.col("uri").isNull()
    counts = rows.agg(
        F.count_if(same & ~none).alias("tp"),
        F.count_if(~same & ~none).alias("fp"),
        F.count_if(~same & none & F.col("exists")).alias("fn"),
        F.count_if(same & none).alias("tn"),
    )
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("*", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def generator_metrics(gold: DataFrame, links: DataFrame) -> DataFrame:
    """n, right, precision, recall of links(token, uri, sentence) against gold(token, uri, sentence, correct)."""
    g = gold.select("token", "uri", sentence_key(F.col("sentence")).alias("key"), "correct").dropDuplicates(["token", "uri", "key"])
    mine = links.select("token", "uri", sentence_key(F.col("sentence")).alias("key")).distinct()
    found = mine.join(g, ["token", "uri", "key"]).agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("right"))
    total = g.agg(F.sum("correct").alias("total"))
    return found.join(F.broadcast(total)).select("n", F.coalesce("right", F.lit(0)).cast("long").alias("right"), F.try_divide(F.col("right"), F.col("n")).alias("precision"), F.try_divide(F.col("right"), F.col("total")).alias("recall"))  # one row each


def unranked(gold: DataFrame, links: DataFrame) -> DataFrame:
    """Links that gold doesn't judge."""
    g = gold.select("token", "uri", sentence_key(F.col("sentence")).alias("_key"))
    return links.withColumn("_key", sentence_key(F.col("sentence"))).join(g, ["token", "uri", "_key"], "left_anti").drop("_key").distinct()


def pair_counts(mentions: DataFrame, doc: str = "doc_id", gold: str = "gold", system: str = "cluster") -> DataFrame:
    """doc, tp, fn, fp, tn over the pairs of a document's mentions, from class sizes; no pair is made."""

    def two(n):
        return n * (n - 1) / 2

    def pairs(by: list[str], name: str) -> DataFrame:
        return mentions.groupBy(doc, *by).count().groupBy(doc).agg(F.sum(two(F.col("count"))).cast("long").alias(name))

    both, golds, systems, every = pairs([gold, system], "both"), pairs([gold], "golds"), pairs([system], "systems"), pairs([], "every")
    j = every.join(golds, doc).join(systems, doc).join(both, doc)
    return j.select(doc, F.col("both").alias("tp"), (F.col("golds") - F.col("both")).alias("fn"), (F.col("systems") - F.col("both")).alias("fp"), (F.col("every") - F.col("golds") - F.col("systems") + F.col("both")).alias("tn"))
