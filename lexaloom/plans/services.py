"""The request services as batch plans over JSON documents, one row a request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import context
from ..operators.labels import greedy_links
from ..operators.linking import candidates, prior_links, pruned, subsumed, typed_links
from ..operators.typed import pattern_probabilities, type_features

REQUEST = "struct<text: string, mentions: array<struct<name: string, start: int, end: int, uri: string>>>"


def requests(spark: SparkSession, path: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    """doc_id, text, mentions of JSON documents, by file or from rows(doc_id, json)."""
    rows = rows if rows is not None else spark.read.text(path, wholetext=True).select(F.xxhash64("value").alias("doc_id"), F.col("value").alias("json"))
    return rows.select("doc_id", F.from_json("json", REQUEST).alias("d")).select("doc_id", "d.text", "d.mentions")


def _mentions(docs: DataFrame) -> DataFrame:
    m = docs.select("doc_id", "text", F.posexplode("mentions").alias("mention_id", "m"))
    return m.select("doc_id", "mention_id", F.col("m.name").alias("mention"), F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.lit(None).cast("string").alias("ner_type"), context(F.col("text"), F.col("m.start"), F.col("m.end")).alias("context"))


def _answer(docs: DataFrame, mentions: DataFrame, links: DataFrame, unknown: str) -> DataFrame:
    rows = mentions.join(links, ["doc_id", "mention_id"], "left")
    item = F.struct("mention_id", F.struct(F.col("mention").alias("name"), "start", "end", F.coalesce("uri", F.lit(unknown)).alias("uri")).alias("m"))
    found = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["m"]).alias("mentions"))
    return docs.select("doc_id", "text").join(found, "doc_id", "left").select("doc_id", F.to_json(F.struct("text", F.coalesce("mentions", F.array().cast("array<struct<name: string, start: int, end: int, uri: string>>")).alias("mentions"))).alias("json"))


def link_by_prior(docs: DataFrame, labels: DataFrame, nospace: DataFrame | None = None, unknown: str = "unknown") -> DataFrame:
    """doc_id, json: the given mentions with their most frequent candidates after subsumption."""
    m = _mentions(docs)
    found = pruned(candidates(m, labels, nospace)).select("doc_id", "mention_id", "mention", "uri", "cnt")
    return _answer(docs, m, prior_links(subsumed(m, found)), unknown)


def link_by_type(docs: DataFrame, labels: DataFrame, patterns: DataFrame, generic: DataFrame, nospace: DataFrame | None = None, unknown: str = "unknown") -> DataFrame:
    """As link_by_prior, by the types of contexts; equal strings of a document pool their contexts."""
    m = _mentions(docs)
    found = subsumed(m, pruned(candidates(m, labels, nospace)).select("doc_id", "mention_id", "mention", "uri", "cnt"))
    asked = m.withColumn("context_id", F.struct("doc_id", "mention")).select("context_id", "context").distinct().withColumn("context_key", F.xxhash64("context_id", "context"))
    probs = pattern_probabilities(asked.select(F.struct("context_id", "context_key").alias("k"), "context"), patterns, "k")
    pooled = probs.groupBy(F.col("k.context_id").alias("context_id"), "type").agg(F.max("prob").alias("prob"))
    kinds = m.select("doc_id", "mention_id", F.struct("doc_id", "mention").alias("context_id")).join(pooled, "context_id").select("doc_id", "mention_id", "type", "prob")
    return _answer(docs, m, typed_links(found, generic, kinds), unknown)


def context_types(contexts: DataFrame, patterns: DataFrame) -> DataFrame:
    """context_id, json of the type features of contexts(context_id, context)."""
    f = type_features(contexts, patterns)
    return f.groupBy("context_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("order", "slot", "pattern", "features")))).alias("json"))


def annotate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, mention, start, end, uri of unambiguous labels in docs(doc_id, text), offsets found from each hit on."""
    from ..functions.text import tokenize

    s = docs.select("doc_id", "text", tokenize(F.col("text")).alias("tokens"))
    hits = greedy_links(s, labels, key="doc_id", guard_titles=True).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "label", "uri"))).alias("hits"))
    joined = docs.select("doc_id", "text").join(hits, "doc_id")
    state = "struct<at: int, out: array<struct<mention: string, start: int, end: int, uri: string>>>"
    folded = F.aggregate("hits", F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<mention: string, start: int, end: int, uri: string>>").alias("out")).cast(state), _advance)
    return joined.select("doc_id", F.explode(folded["out"]).alias("m")).select("doc_id", "m.*")


def _advance(acc, h):
    rest = F.substr(F.col("text"), acc["at"])
    at = F.call_function("instr", rest, h["label"])
    start = acc["at"] + at - 2
    end = start + F.length(h["label"])
    item = F.struct(h["label"].alias("mention"), start.cast("int").alias("start"), end.cast("int").alias("end"), h["uri"].alias("uri"))
    return F.when(at > 0, F.struct((end + 1).cast("int").alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))).otherwise(acc).cast("struct<at: int, out: array<struct<mention: string, start: int, end: int, uri: string>>>")
