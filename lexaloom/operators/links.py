"""Link mentions, redirects, anchor dictionaries and adjacency.

Long tables (mention, uri, cnt) take the place of packed lists; packing is for export only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_of_uri, label_variant, person_labels, plain_characters

HREF = r'<a href="([^"]*)">([^<]*)</a>'


def html_links(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep, uri, mention of each `<a href>` with plain text."""
    tags = F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(0))
    return pages.select(*keep, F.explode(tags).alias("tag")).select(*keep, F.regexp_extract("tag", HREF, 1).alias("uri"), F.regexp_extract("tag", HREF, 2).alias("mention"))


def normalised(links: DataFrame) -> DataFrame:
    """Plain characters; underscores in uris and spaces in mentions; uris start in upper case."""
    uri = F.replace(plain_characters(F.col("uri")), F.lit(" "), F.lit("_"))
    return links.withColumn("uri", F.concat(F.upper(F.substr(uri, F.lit(1), F.lit(1))), F.substr(uri, F.lit(2)))).withColumn("mention", F.replace(plain_characters(F.col("mention")), F.lit("_"), F.lit(" ")))


def redirected(links: DataFrame, redirects: DataFrame) -> DataFrame:
    """links with uris resolved by redirects(alias, canonical); of several canonicals the least."""
    one = redirects.groupBy("alias").agg(F.min("canonical").alias("canonical"))
    return links.join(one, F.col("uri") == F.col("alias"), "left").withColumn("uri", F.coalesce("canonical", "uri")).drop("alias", "canonical")


def anchors(links: DataFrame) -> DataFrame:
    """mention, uri, cnt: serves both directions."""
    return links.groupBy("mention", "uri").agg(F.count(F.lit(1)).alias("cnt"))


def packed(counts: DataFrame, key: str, value: str, cnt: str = "cnt") -> DataFrame:
    """key, values array<struct<value, cnt>>, most frequent first."""
    s = F.struct((-F.col(cnt)).alias("n"), F.col(value).alias("v"))
    return counts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(s)), lambda x: F.struct(x["v"].alias(value), (-x["n"]).alias(cnt))).alias("values"))


def totals(counts: DataFrame, key: str, cnt: str = "cnt") -> DataFrame:
    return counts.groupBy(key).agg(F.sum(cnt).alias(cnt))


def good_uris(uri: Column) -> Column:
    return ~F.contains(uri, F.lit("__")) & ~uri.startswith("Template:") & ~uri.startswith("List_of:")


def without_disambiguation(entities: DataFrame, disambiguation: DataFrame) -> DataFrame:
    return entities.join(disambiguation.select("uri").distinct(), "uri", "left_anti")


def entity_labels(kb: DataFrame) -> DataFrame:
    """uri, label of kb(uri, types, redirects): the uri's name, all sub-names of a person, and the redirects' names."""
    name = label_of_uri(F.col("uri"))
    own = F.when(F.array_contains("types", "Person"), person_labels(name)).otherwise(F.array(name))
    other = F.transform(F.coalesce("redirects", F.array().cast("array<string>")), label_of_uri)
    labels = F.array_distinct(F.filter(F.concat(own, other), lambda x: F.length(x) > 0))
    return kb.where(good_uris(F.col("uri"))).select("uri", F.explode(labels).alias("label"))


def candidate_labels(kb: DataFrame, anchor_counts: DataFrame, *, lower: bool = False, spaces: bool = True) -> DataFrame:
    """label, uri, cnt: names of entities with the count of all their links (1 without any), and anchors with their own.

    Where a pair comes from both, the name's count stands.
    """
    per_uri = totals(anchor_counts, "uri")
    named = entity_labels(kb).join(per_uri, "uri", "left").select(label_variant(F.col("label"), lower=lower, spaces=spaces).alias("label"), "uri", F.coalesce("cnt", F.lit(1)).cast("long").alias("named")).dropDuplicates(["label", "uri"])
    linked = anchor_counts.select(F.col("mention").alias("label"), "uri", F.col("cnt").alias("linked"))
    return named.join(linked, ["label", "uri"], "full_outer").select("label", "uri", F.coalesce("named", "linked").alias("cnt"))


def cooccurrence(links: DataFrame, by: str, node: str = "uri") -> DataFrame:
    """src, dst, weight: how often two nodes stand in the same `by`, both directions, a node not with itself.

    Nodes are counted per group first. The join yields the co-occurring pairs, which are the result.
    """
    per = links.groupBy(by, node).agg(F.count(F.lit(1)).alias("n"))
    a, b = per.select(by, F.col(node).alias("src"), F.col("n").alias("na")), per.select(by, F.col(node).alias("dst"), F.col("n").alias("nb"))
    return a.join(b, by).where("src <> dst").groupBy("src", "dst").agg(F.sum(F.col("na") * F.col("nb")).alias("weight"))


def adjacency(edges: DataFrame) -> DataFrame:
    """src, dst, weight of edge occurrences, disambiguation pages left out before the shuffle."""
    marked = F.contains(F.concat("src", "dst"), F.lit("(disambiguation)"))
    return edges.where(~marked).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def mention_nodes(links: DataFrame) -> DataFrame:
    """links with node `mention|uri`."""
    return links.withColumn("node", F.concat_ws("|", F.replace("mention", F.lit(" "), F.lit("_")), "uri"))


def looked_up(keys: DataFrame, counts: DataFrame, key: str, value: str, cnt: str = "cnt") -> DataFrame:
    """key, value, cnt for each asked key; keys that are missing have no row."""
    return counts.join(keys.select(key).distinct(), key, "left_semi").select(key, value, cnt)


def wiki_probabilities(phrases: DataFrame, anchor_counts: DataFrame) -> DataFrame:
    """phrase, anchors, mentions, prob of phrases(phrase): anchors of a phrase over all mentions of its targets plus 10."""
    per_uri = totals(anchor_counts, "uri").withColumnRenamed("cnt", "of_uri")
    found = anchor_counts.join(per_uri, "uri").groupBy(F.col("mention").alias("phrase")).agg(F.sum("cnt").alias("anchors"), F.sum("of_uri").alias("mentions"))
    return phrases.select("phrase").distinct().join(found, "phrase", "left").select("phrase", F.coalesce("anchors", F.lit(0)).cast("long").alias("anchors"), F.coalesce("mentions", F.lit(0)).cast("long").alias("mentions")).withColumn("prob", F.col("anchors") / (F.col("mentions") + 10))
