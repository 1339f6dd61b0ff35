"""Label ambiguity, unambiguous labels and greedy dictionary linking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import greedy_spans
from ..functions.text import is_lower, is_upper, link_tags, link_text, title_case
from ..plans.session import checkpointed, joinable


def ambiguity(anchor_counts: DataFrame) -> DataFrame:
    """mention, n_uris, total of each label."""
    return anchor_counts.groupBy("mention").agg(F.countDistinct("uri").alias("n_uris"), F.sum("cnt").alias("total"))


def single_uri_labels(anchor_counts: DataFrame) -> DataFrame:
    """mention, uri, cnt of labels with one target."""
    return anchor_counts.groupBy("mention").agg(F.count(F.lit(1)).alias("n"), F.min("uri").alias("uri"), F.sum("cnt").alias("cnt")).where("n = 1").drop("n")


def percentile_labels(anchor_counts: DataFrame, share: float = 0.9, min_count: int = 1) -> DataFrame:
    """mention, uri, cnt of targets with more than `share` of a label's links and more than min_count."""
    total = F.sum("cnt").over(Window.partitionBy("mention"))
    return anchor_counts.withColumn("_t", total).where((F.col("cnt") / F.col("_t") > share) & (F.col("cnt") > min_count)).select("mention", "uri", "cnt")


def ratio_labels(predicted: DataFrame, organic: DataFrame, ratio: float = 2.0) -> DataFrame:
    """mention, uri, predicted, organic of labels predicted (mention, uri, cnt) less than `ratio` times as often as linked, linked more than once, with a letter."""
    o = organic.select("mention", "uri", F.col("cnt").alias("organic"))
    joined = predicted.select("mention", "uri", F.col("cnt").alias("predicted")).join(o, ["mention", "uri"], "left").withColumn("organic", F.coalesce("organic", F.lit(0)).cast("long"))
    return joined.where((F.col("organic") > 1) & (F.col("predicted") / F.col("organic") < ratio) & ~F.col("mention").rlike(r"^[\W\d]+$"))


def case_counts(predicted: DataFrame, organic: DataFrame) -> DataFrame:
    """uri, label (lower case) with the counts of its upper and lower forms, 0 where there are none."""

    def sides(df: DataFrame, name: str) -> DataFrame:
        low = is_lower(F.col("mention"))
        return df.groupBy("uri", F.lower("mention").alias("label")).agg(F.sum(F.when(low, F.col("cnt")).otherwise(0)).alias(f"{name}_lower"), F.sum(F.when(low, 0).otherwise(F.col("cnt"))).alias(f"{name}_upper"))

    joined = sides(predicted, "infer").join(sides(organic, "orig"), ["uri", "label"], "left")
    return joined.na.fill(0, ["orig_lower", "orig_upper"])


def included_labels(counts: DataFrame, ratio: float = 2.0) -> DataFrame:
    """label, uri: upper-case forms always; the lower one if it is the only one seen more than once, or is linked often enough."""
    lower_only = (F.col("infer_upper") == 0) & (F.col("infer_lower") > 1)
    both = (F.col("infer_upper") > 0) & (F.col("infer_lower") > 0) & (F.try_divide(F.col("infer_lower"), F.col("orig_lower")) < ratio)
    forms = F.array_compact(F.array(F.when(F.col("infer_upper") > 0, title_case(F.col("label"))), F.when(lower_only | both, F.col("label"))))
    return counts.select(F.explode(forms).alias("label"), "uri")


def greedy_links(sentences: DataFrame, labels: DataFrame, *, key: str = "sent_id", max_tokens: int = 20, guard_titles: bool = False, skip_first_alone: bool = True) -> DataFrame:
    """key, start, stop, label, uri: from the left, the longest span of up to max_tokens tokens that is a label, then on after it.

    guard_titles rejects spans that touch a capitalised token on either side (the last token of a sentence
    apart). Spans start with a token that begins a label and are no longer than the longest of those labels;
    they are joined on their text, and the scan is a fold over each sentence's hits.
    """
    labels = labels.select("label", "uri").groupBy("label").agg(F.min("uri").alias("uri"))
    sizes = F.least(F.size(F.split("label", " ")), F.lit(max_tokens))
    firsts = checkpointed(labels.groupBy(F.substring_index("label", " ", 1).alias("first")).agg(F.max(sizes).alias("most")))
    longest = firsts.agg(F.max("most")).first()[0] or 1
    each = sentences.where(F.size("tokens") > 0).select(key, "tokens", F.posexplode("tokens").alias("start", "first"))
    each = each.select(key, F.size("tokens").alias("n"), "start", "first", F.slice("tokens", F.col("start") + 1, longest + 1).alias("w"), F.get("tokens", F.col("start") - 1).alias("prev"))
    each, firsts = joinable(each, firsts)
    starts = each.join(firsts, "first")
    stops = starts.withColumn("stop", F.explode(F.sequence(F.col("start") + 1, F.least("n", F.col("start") + F.col("most")))))
    ok = ~((F.col("start") == 0) & (F.col("stop") == 1)) if skip_first_alone else F.lit(True)
    if guard_titles:
        upper = r"^\p{Lu}"
        after = (F.col("stop") + 1 < F.col("n")) & F.get("w", F.col("stop") - F.col("start")).rlike(upper)
        ok = ok & ~F.coalesce(after, F.lit(False)) & ~F.coalesce(F.col("prev").rlike(upper), F.lit(False))
    spans = stops.where(ok).select(key, "start", "stop", F.array_join(F.slice("w", F.lit(1), F.col("stop") - F.col("start")), " ").alias("label"))
    spans, labels = joinable(spans, labels)
    hits = spans.join(labels, "label").repartition(key).groupBy(key, "start").agg(F.max(F.struct("stop", "label", "uri")).alias("h"))
    taken = hits.groupBy(key).agg(greedy_spans(F.collect_list(F.struct("start", F.col("h.stop").alias("stop"), F.col("h.label").alias("label"), F.col("h.uri").alias("uri")))).alias("taken"))
    return taken.select(key, F.explode("taken").alias("s")).select(key, "s.start", "s.stop", "s.label", "s.uri")


def predicted_counts(links: DataFrame) -> DataFrame:
    """mention, uri, cnt of greedy links."""
    return links.groupBy(F.col("label").alias("mention"), "uri").agg(F.count(F.lit(1)).alias("cnt"))


def organic_links(lines: DataFrame, redirects: DataFrame, key: str = "sent_id", text: str = "sentence") -> DataFrame:
    """key, token, uri, sentence of the `<uri|anchor>` tags, redirects resolved."""
    one = redirects.groupBy("alias").agg(F.min("canonical").alias("canonical"))
    tags = lines.select(key, link_text(F.col(text)).alias("sentence"), F.explode(link_tags(F.col(text))).alias("t"))
    return tags.join(one, F.col("t.uri") == F.col("alias"), "left").select(key, F.col("t.anchor").alias("token"), F.coalesce("canonical", "t.uri").alias("uri"), "sentence")


def precise(links: DataFrame) -> DataFrame:
    """Links whose token is part of the uri."""
    return links.where(F.contains(F.lower("uri"), F.replace(F.lower("token"), F.lit(" "), F.lit("_"))))


def plus(links: DataFrame, more: DataFrame) -> DataFrame:
    """links and those of `more` that aren't among them."""
    on = ["token", "uri", "sentence"]
    return links.select(*on).union(more.select(*on).join(links.select(*on), on, "left_anti"))


def unambiguous_generator(labels: DataFrame, try_title: bool = False) -> Callable[[DataFrame], DataFrame]:
    """spans(span) -> span, token, uri: unambiguous labels, without a final 's in the token."""

    def generate(spans: DataFrame) -> DataFrame:
        variants = F.array(F.col("span"), title_case(F.col("span"))) if try_title else F.array("span")
        tried = spans.select("span", F.posexplode(variants).alias("order", "label")).join(labels.select("label", "uri"), "label")
        best = tried.groupBy("span").agg(F.min_by("uri", "order").alias("uri"))
        return best.select("span", F.regexp_replace("span", " ?'s$", "").alias("token"), "uri")

    return generate


def label_generator(labels: DataFrame) -> Callable[[DataFrame], DataFrame]:
    return lambda spans: spans.join(labels.select(F.col("label").alias("span"), "uri"), "span").select("span", F.col("span").alias("token"), "uri")


def sweep(predicted: DataFrame, organic: DataFrame, gold: DataFrame, ratios: list[float]) -> DataFrame:
    """ratio, n, tp, precision, recall of the ratio labels at each limit against gold(mention, uri)."""
    spark = predicted.sparkSession
    limits = F.broadcast(spark.createDataFrame([(float(r),) for r in ratios], "ratio double"))  # the parameters
    o = organic.select("mention", "uri", F.col("cnt").alias("organic"))
    joined = predicted.select("mention", "uri", F.col("cnt").alias("predicted")).join(o, ["mention", "uri"]).where("organic > 1").withColumn("_r", F.col("predicted") / F.col("organic"))
    marked = joined.join(gold.select("mention", "uri").distinct().withColumn("right", F.lit(1)), ["mention", "uri"], "left")
    total = gold.select("mention", "uri").distinct().count()
    return limits.join(marked, F.col("_r") < F.col("ratio")).groupBy("ratio").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("right", F.lit(0))).alias("tp")).withColumn("precision", F.col("tp") / F.col("n")).withColumn("recall", F.try_divide(F.col("tp"), F.lit(total)))


def mostly_upper(labels: DataFrame) -> DataFrame:
    return labels.where(is_upper(F.substr(F.col("label"), F.lit(1), F.lit(1))))
