"""Readers of the corpora's file formats. Paths are anything Spark reads, compressed files included."""

from __future__ import annotations

import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import unpack
from ..functions.text import astrology_uri, history_text, html_unescape, unquote, without_tags

RESOURCE, ONTOLOGY = "<http://dbpedia.org/resource/", "<http://dbpedia.org/ontology/"
# Types that are left out.
EXCLUDED_TYPES = ["Agent", "TimePeriod", "PersonFunction", "Year"]


def tsv(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Tab-separated text without quoting; several paths as a list or joined by `:`."""
    paths = [p for p in paths.split(":") if p] if isinstance(paths, str) and "://" not in paths else paths
    return spark.read.csv(paths, sep="\t", quote="", schema=schema)


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths)


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """before, after of an edit-pair file."""
    return tsv(spark, path, "before string, after string")


def triples(text: DataFrame) -> DataFrame:
    """s, p, o of N-Triples lines(value); lines of another form are dropped."""
    parts = F.split("value", " ", 3)
    return text.where(F.size(parts) == 3).select(parts[0].alias("s"), parts[1].alias("p"), parts[2].alias("o"), "value")


def _name(c: Column) -> Column:
    return unquote(F.regexp_replace(F.replace(c, F.lit(RESOURCE), F.lit("")), ">$", ""))


def entity_types(text: DataFrame) -> DataFrame:
    """uri, type of a types file's lines; schema.org persons count as Person, general and foreign types are left out."""
    t = triples(text.where(~F.contains("value", F.lit("<BAD URI: Illegal character"))))
    o = F.when(F.contains("o", F.lit("<http://schema.org/Person>")), F.lit(f"{ONTOLOGY}Person> .")).otherwise(F.col("o"))
    kind = F.regexp_extract(o, r"<http://dbpedia\.org/ontology/([^>]*)>", 1)
    rows = t.select(_name(F.col("s")).alias("uri"), kind.alias("type"))
    ok = (F.col("type") != "") & ~F.col("type").startswith("Wikidata") & ~F.col("type").startswith("Location") & ~F.col("type").isin(EXCLUDED_TYPES) & ~F.contains("uri", F.lit("(disambiguation)"))
    return rows.where(ok).distinct()


def redirects(text: DataFrame) -> DataFrame:
    """alias, canonical of a redirects file: lines of four fields, names without a slash."""
    f = F.split(F.trim("value"), " ")
    rows = text.where(F.size(f) == 4).select(_name(f[0]).alias("alias"), _name(f[2]).alias("canonical"))
    return rows.where(~F.contains("alias", F.lit("/")) & ~F.contains("canonical", F.lit("/"))).distinct()


def disambiguations(text: DataFrame) -> DataFrame:
    """uri of pages that disambiguate."""
    return triples(text).select(_name(F.col("s")).alias("uri")).distinct()


def knowledge_base(types: DataFrame, redirected: DataFrame, disambiguation: DataFrame) -> DataFrame:
    """uri, types, redirects; disambiguation pages are left out."""
    t = types.groupBy("uri").agg(F.array_sort(F.collect_set("type")).alias("types"))
    r = redirected.groupBy(F.col("canonical").alias("uri")).agg(F.array_sort(F.collect_list("alias")).alias("redirects"))
    none = F.array().cast("array<string>")
    kb = t.join(r, "uri", "full_outer").select("uri", F.coalesce("types", none).alias("types"), F.coalesce("redirects", none).alias("redirects"))
    return kb.join(disambiguation, "uri", "left_anti")


def kb_file(spark: SparkSession, path: str) -> DataFrame:
    """uri, types, redirects of a knowledge-base file (space-separated lists)."""
    t = tsv(spark, path, "uri string, types string, redirects string")
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda x: x != "")
    return t.select("uri", words("types").alias("types"), words("redirects").alias("redirects"))


def typed_entities(kb: DataFrame) -> DataFrame:
    """uri, type; entities without types have no row."""
    return kb.select("uri", F.explode("types").alias("type"))


def inverted_redirects(kb: DataFrame) -> DataFrame:
    return kb.select(F.explode("redirects").alias("alias"), F.col("uri").alias("canonical"))


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """child, parent of an OWL file's subClassOf statements."""
    raw = spark.read.format("xml").option("rowTag", "owl:Class").load(path)
    one = F.from_json(F.to_json(F.struct("*")), "`_rdf:about` string, `rdfs:subClassOf` string")
    parent = F.explode(F.regexp_extract_all(F.coalesce(one["rdfs:subClassOf"], F.lit("")), F.lit(r'rdf:resource"\s*:\s*"([^"]*)"'), F.lit(1)))
    return raw.select(one["_rdf:about"].alias("child"), parent.alias("parent")).select(*[F.regexp_extract(c, r"([^/#]*)$", 1).alias(c) for c in ("child", "parent")])


def stack_history(spark: SparkSession, path: str) -> DataFrame:
    """post_id, row_id, text, comment of a post history: bodies and titles (`-title`), first versions and edits."""
    rows = spark.read.format("xml").option("rowTag", "row").schema("_Id long, _PostHistoryTypeId int, _PostId string, _Text string, _Comment string").load(path)
    kind = F.col("_PostHistoryTypeId")
    post = F.concat("_PostId", F.when(kind.isin(1, 4), F.lit("-title")).otherwise(F.lit("")))
    return rows.where(kind.isin(1, 2, 4, 5)).select(post.alias("post_id"), F.col("_Id").alias("row_id"), history_text(F.col("_Text")).alias("text"), F.lower(F.regexp_replace(F.coalesce("_Comment", F.lit("")), r"\s+", " ")).alias("comment"))


def wiki_history(spark: SparkSession, path: str) -> DataFrame:
    """page, rev_id, text, comment of a history dump's revisions, to be paired by version_pairs."""
    pages = spark.read.format("xml").option("rowTag", "page").schema("title string, revision array<struct<id: long, comment: string, text: string>>").load(path)
    return pages.select(F.col("title").alias("page"), F.explode("revision").alias("r")).select("page", F.col("r.id").alias("rev_id"), F.col("r.text").alias("text"), F.col("r.comment").alias("comment"))


def fce(spark: SparkSession, path: str) -> DataFrame:
    """before, after of zipped learner scripts: paragraphs without their corrections, and without their errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for content in b.column(0).to_pylist():
                with zipfile.ZipFile(BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith(".xml"):
                            root = ET.fromstring(z.read(name))
                            out += [ET.tostring(p, "unicode") for p in root.iterfind(".//coded_answer/p") if p.find(".//unknown") is None]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["p"])

    p = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "p string")
    plain = lambda c: F.trim(F.regexp_replace(html_unescape(F.regexp_replace(c, "</?(p|NS)[^>]*>", "")), r"\s+", " "))
    return p.select(plain(without_tags(F.col("p"), "i", "c")).alias("before"), plain(without_tags(F.col("p"), "c", "i")).alias("after"))


def conll(spark: SparkSession, path: str, kind: str = "Prep") -> DataFrame:
    """before, after of each paragraph of CoNLL SGML files, corrections of one kind put in from the right; those that span
    paragraphs or lie within the one before are left out."""
    text = spark.read.text(path, wholetext=True)
    docs = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<DOC.*?</DOC>"), F.lit(0))).alias("doc")).withColumn("doc_id", F.monotonically_increasing_id())
    body = F.regexp_extract("doc", r"(?s)<TEXT>(.*?)</TEXT>", 1)
    paragraphs = docs.select("doc_id", F.posexplode(F.regexp_extract_all(body, F.lit(r"(?s)<(?:P|TITLE)>(.*?)</(?:P|TITLE)>"), F.lit(1))).alias("par", "p")).select("doc_id", "par", F.array_join(F.transform(F.split("p", "\n"), lambda x: F.trim(x)), "").alias("before"))
    m = docs.select("doc_id", F.posexplode(F.regexp_extract_all("doc", F.lit(r"(?s)<MISTAKE.*?</MISTAKE>"), F.lit(0))).alias("k", "m"))
    attr = lambda name: F.regexp_extract("m", rf'{name}="?(\d+)', 1).cast("int")
    c = m.select("doc_id", "k", attr("start_par").alias("par"), attr("end_par").alias("end_par"), attr("start_off").alias("a"), attr("end_off").alias("b"), F.regexp_extract("m", "<TYPE>(.*?)</TYPE>", 1).alias("kind"), F.regexp_extract("m", "(?s)<CORRECTION>(.*?)</CORRECTION>", 1).alias("c")).where((F.col("par") == F.col("end_par")) & (F.col("kind") == kind))
    sorted_ = c.groupBy("doc_id", "par").agg(F.array_sort(F.collect_list(F.struct("k", "a", "b", "c"))).alias("cs"))
    item = "struct<k: int, a: int, b: int, c: string>"

    def keep(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        inside = F.coalesce((x["a"] >= last["a"]) & (x["b"] <= last["b"]), F.lit(False))
        same = F.coalesce((x["a"] == last["a"]) & (x["b"] >= last["b"]), F.lit(False))
        cut = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["k"].alias("k"), last["a"].alias("a"), last["a"].alias("b"), last["c"].alias("c"))))
        return F.when(inside, acc).otherwise(F.concat(F.when(same, cut).otherwise(acc), F.array(x))).cast(f"array<{item}>")

    kept = F.aggregate("cs", F.array().cast(f"array<{item}>"), keep)
    fixed = F.aggregate(F.reverse(kept), F.col("before"), lambda t, x: F.concat_ws(" ", F.substr(t, F.lit(1), x["a"]), x["c"], F.substr(t, x["b"] + 1)))
    joined = paragraphs.join(sorted_, ["doc_id", "par"], "left")
    return joined.select("before", F.regexp_replace(F.when(F.col("cs").isNull(), F.col("before")).otherwise(fixed), r"\s+", " ").alias("after"))


def news_truth(spark: SparkSession, path: str, redirected: DataFrame | None = None) -> DataFrame:
    """doc_id, mention, uri, exists of a truth file with `~~~ name` and `### name` lines; lines marked `!!!` or `---` are left
    out, of a mention's several entries the last stays."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("k", "line"))
    doc = F.last(F.when(F.col("line").startswith("~~~ "), F.element_at(F.split(F.trim("line"), r"\s+"), -1)), ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("k"))  # a file of some hundred lines
    f = F.split(F.trim("line"), "\t")
    rows = t.withColumn("doc_id", doc).where(~F.col("line").startswith("~~~ ") & ~F.col("line").startswith("### ") & (F.size(f) > 1)).where(~F.element_at(f, -1).isin("!!!", "---"))
    m = rows.select("doc_id", "k", f[0].alias("mention"), F.replace(f[1], F.lit(" "), F.lit("_")).alias("uri"))
    if redirected is not None:
        m = m.join(redirected.groupBy("alias").agg(F.min("canonical").alias("canonical")), F.col("uri") == F.col("alias"), "left").withColumn("uri", F.coalesce("canonical", "uri"))
    return m.groupBy("doc_id", "mention").agg(F.max_by("uri", "k").alias("uri")).withColumn("exists", F.lit(True))


def news_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text of a folder of articles: white space squeezed, possessive 's removed."""
    t = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("doc_id"), "value")
    return t.select("doc_id", F.regexp_replace(F.regexp_replace("value", r"\s+", " "), r"'s\b", "").alias("text"))


def _truth_map(fields: Column) -> Column:
    """map of the mention and uri columns from the third on."""
    at = F.sequence(F.lit(3), F.greatest(F.size(fields) - 1, F.lit(3)), F.lit(2))
    ok = F.filter(at, lambda i: i + 1 <= F.size(fields))
    items = F.transform(ok, lambda i: F.struct(F.element_at(fields, i).alias("key"), F.replace(F.element_at(fields, i + 1), F.lit("http://dbpedia.org/resource/"), F.lit("")).alias("value")))
    return F.map_from_entries(F.filter(items, lambda x, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda y: y["key"] == x["key"])))


def microposts(spark: SparkSession, path: str, redirected: DataFrame | None = None) -> DataFrame:
    """doc_id, text, mention, uri of microposts with alternating mention and uri columns; posts without any have one row of nulls."""
    f = F.split("value", "\t")
    t = spark.read.text(path).select(f[0].alias("doc_id"), F.try_element_at(f, F.lit(2)).alias("text"), _truth_map(f).alias("truth")).where("doc_id <> ''")
    m = t.select("doc_id", "text", F.explode_outer("truth").alias("mention", "uri"))
    if redirected is None:
        return m
    return m.join(redirected.groupBy("alias").agg(F.min("canonical").alias("canonical")), F.col("uri") == F.col("alias"), "left").select("doc_id", "text", "mention", F.coalesce("canonical", "uri").alias("uri"))


def microposts_with_mentions(spark: SparkSession, path: str, truth: DataFrame, handles: DataFrame | None = None) -> DataFrame:
    """doc_id, start, end, mention, candidates, true_uri; signs of the zodiac have one candidate; truths without a mention follow."""
    f = F.split("value", "\t")
    t = spark.read.text(path).where(F.size(f) >= 5).select(f[0].alias("doc_id"), f[1].cast("int").alias("start"), f[2].cast("int").alias("end"), f[3].alias("raw"), unpack(f[4]).alias("c"))
    t = t.join(handles.select(F.col("handle").alias("raw"), "name"), "raw", "left") if handles is not None else t.withColumn("name", F.lit(None).cast("string"))
    rows = t.select("doc_id", "start", "end", "raw", F.coalesce("name", "raw").alias("mention"), F.transform("c", lambda x: F.struct(x["key"].alias("uri"), x["value"].cast("double").alias("cnt"))).alias("candidates"))
    seen = rows.join(truth.select("doc_id", F.col("mention").alias("raw"), F.col("uri").alias("true_uri")), ["doc_id", "raw"], "left")
    none = F.array().cast("array<struct<uri: string, cnt: double>>")
    rest = truth.where("mention IS NOT NULL").join(rows.select("doc_id", F.col("raw").alias("mention")), ["doc_id", "mention"], "left_anti").select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("end"), "mention", none.alias("candidates"), F.col("uri").alias("true_uri"))
    out = seen.select("doc_id", "start", "end", "mention", "candidates", "true_uri").unionByName(rest)
    sign = astrology_uri(F.col("mention"), F.lit(None).cast("string"))
    return out.withColumn("candidates", F.when(sign.isNotNull(), F.array(F.struct(sign.alias("uri"), F.lit(1.0).alias("cnt")))).otherwise(F.col("candidates")))


COREF = "doc_id string, par string, sent_id int, mention_id string, start int, end int, mention string, ner_text string, head string, pos string, cluster string, gold string, ner_tag string, pos_seq string, url string, types string"


def coref(spark: SparkSession, path: str) -> DataFrame:
    """The mentions of a coreference file of 16 columns with a header; `null` urls are null."""
    t = spark.read.csv(path, sep="\t", quote="", schema=COREF, header=True)
    return t.withColumn("entity", F.when(F.col("url") != "null", F.col("url"))).withColumn("entity_type", F.concat(F.lit("<dbpedia:"), F.regexp_extract(F.split("types", " ")[0], "([^/]*)$", 1), F.lit(">")))


def zipped(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """The rows of two files side by side, by their place in an order; for files of one document set."""
    left = a.withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order_a)))
    right = b.withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order_b)))
    return left.join(right, "_k").drop("_k")


def spotted(mentions: DataFrame, spots: DataFrame) -> DataFrame:
    """Mentions with the uri that an annotator gave one of their words, if the head is part of the annotated text.

    spots(doc_id, par, sent_id, word, spot, uri); the words of a mention are exploded, so that the join is on equality.
    """
    w = mentions.withColumn("word", F.explode(F.sequence("start", F.greatest(F.col("end") - 1, F.col("start")))))
    hit = w.join(spots, ["doc_id", "par", "sent_id", "word"]).where(F.contains(F.lower("spot"), F.lower("head")))
    best = hit.groupBy("doc_id", "mention_id").agg(F.min_by("uri", "word").alias("entity"))
    return mentions.drop("entity").join(best, ["doc_id", "mention_id"], "left")


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """token, uri, sentence, correct of a gold file."""
    t = tsv(spark, path, "correct int, uri_equals string, full_url string, token string, uri string, sentence string")
    return t.select("token", "uri", "sentence", "correct")


def type_counts(spark: SparkSession, path: str) -> DataFrame:
    """bigram, types map<string, bigint> of a debug file with lists of (type, n)."""
    f = F.split("value", "\t")
    found = lambda p: F.regexp_extract_all(f[3], F.lit(p), F.lit(1))
    return spark.read.text(path).where(F.size(f) >= 4).select(F.concat_ws(" ", f[1], f[2]).alias("bigram"), F.map_from_arrays(found(r"\d+\s*,\s*'?([^()',]+?)'?\s*\)"), F.transform(found(r"\(\s*(\d+)"), lambda x: x.cast("long"))).alias("types"))


def local_candidates(spark: SparkSession, path: str) -> DataFrame:
    """label, uri, cnt (double) of a packed dictionary; lines of another form are dropped."""
    f = F.split("value", "\t")
    t = spark.read.text(path).where(F.size(f) == 2).select(f[0].alias("label"), F.explode(unpack(f[1])).alias("x"))
    return t.select("label", F.col("x.key").alias("uri"), F.col("x.value").cast("double").alias("cnt"))


def sampled(articles: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n articles in a seeded random order; a sampling operator."""
    return articles.orderBy(F.xxhash64(*articles.columns, F.lit(seed))).limit(n)


def looked_up(keys: DataFrame, store: DataFrame, key: str, value: str, default=None) -> DataFrame:
    """key, value for each asked key, with the default (null, or 0 for counts) where it is missing."""
    found = keys.select(key).distinct().join(store.select(key, value), key, "left")
    return found if default is None else found.withColumn(value, F.coalesce(value, F.lit(default)))
