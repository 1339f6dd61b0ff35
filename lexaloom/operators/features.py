"""Candidate feature tables for learning to link."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linking import MENTION


def candidate_features(found: DataFrame, graph: DataFrame, types: DataFrame, context_types: DataFrame, truth: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row for each candidate: cand_num, graph_score (its rank), type_exists, ner_type_match, true_type_match,
    type_predictable, type_prob, prior_prob, label.

    types(uri, types from specific to general), context_types(doc_id, mention_id, type, prob),
    truth(doc_id, mention_id, true_uri), mentions(doc_id, mention_id, ner_type), graph(doc_id, mention_id, uri, rank).
    """
    w = Window.partitionBy(*MENTION)
    rows = found.withColumn("cand_num", F.count(F.lit(1)).over(w)).withColumn("prior_prob", F.col("cnt") / (F.sum("cnt").over(w) + 1))
    t = types.select("uri", "types")
    true = truth.select(*MENTION, "true_uri").join(t.select(F.col("uri").alias("true_uri"), F.col("types").alias("true_types")), "true_uri", "left")
    best = found.select(*MENTION, "uri").join(t, "uri").withColumn("type", F.explode("types")).join(context_types.groupBy(*MENTION, "type").agg(F.max("prob").alias("prob")), [*MENTION, "type"]).groupBy(*MENTION, "uri").agg(F.max("prob").alias("type_prob"))
    j = rows.join(t, "uri", "left").join(true, MENTION, "left").join(mentions.select(*MENTION, "ner_type"), MENTION, "left").join(best, [*MENTION, "uri"], "left").join(graph.select(*MENTION, "uri", F.col("rank").alias("graph_score")), [*MENTION, "uri"], "left")
    general = F.try_element_at("types", F.lit(-1))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return j.select(
        *MENTION, "mention", "uri", "cand_num", "graph_score",
        flag(F.size("types") > 0).alias("type_exists"),
        flag(general == F.col("ner_type")).alias("ner_type_match"),
        flag(F.array_contains("true_types", general)).alias("true_type_match"),
        F.col("type_prob").isNotNull().cast("int").alias("type_predictable"),
        F.coalesce("type_prob", F.lit(0.0)).alias("type_prob"),
        "prior_prob", flag(F.col("uri") == F.col("true_uri")).alias("label"),
    )


def merged_features(features: DataFrame) -> DataFrame:
    """One row for each (doc_id, mention, uri) with the most of type_prob, how many were merged, and ranks by type (1.0 is
    rank 0) and prior probability within the mention."""
    others = [c for c in features.columns if c not in ("doc_id", "mention", "uri", "mention_id", "type_prob")]
    first = F.min_by(F.struct(*others), "mention_id")
    m = features.groupBy("doc_id", "mention", "uri").agg(F.max("type_prob").alias("type_prob"), F.count(F.lit(1)).alias("number_merged"), first.alias("f")).select("doc_id", "mention", "uri", "type_prob", "number_merged", "f.*")
    w = Window.partitionBy("doc_id", "mention")
    by_type = F.row_number().over(w.orderBy(F.desc("type_prob"), "uri")) - 1
    return m.withColumn("type_prob_rank", F.when(F.col("type_prob") == 1.0, 0).otherwise(by_type)).withColumn("prior_prob_rank", F.row_number().over(w.orderBy(F.desc("prior_prob"), "uri")) - 1)
