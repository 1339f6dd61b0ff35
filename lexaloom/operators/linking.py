"""Entity linking: candidates, pruning, priors, typed linking, subsumption and closeness.

A mention is a row (doc_id, mention_id, mention, ...); its candidates are rows
(doc_id, mention_id, mention, uri, cnt).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import joined_nouns, ngrams
from ..functions.text import camel_split, is_lower, title_case

PERCENTILE = 0.9
MENTION = ["doc_id", "mention_id"]


def candidates(mentions: DataFrame, labels: DataFrame, nospace: DataFrame | None = None) -> DataFrame:
    """doc_id, mention_id, mention, matched, uri, cnt by labels(label, uri, cnt): the mention as it is, in title case,
    split at capitals, or else in lower case without spaces by `nospace`; the first form with candidates counts."""
    m = F.col("mention")
    forms = F.array(m, title_case(m), camel_split(m))
    tried = mentions.select(*MENTION, "mention", F.posexplode(forms).alias("form", "matched")).join(labels.select(F.col("label").alias("matched"), "uri", "cnt"), "matched")
    if nospace is not None:
        last = mentions.select(*MENTION, "mention", F.lit(3).alias("form"), F.lower(F.replace("mention", F.lit(" "), F.lit(""))).alias("matched")).join(nospace.select(F.col("label").alias("matched"), "uri", "cnt"), "matched")
        tried = tried.unionByName(last)
    first = F.min("form").over(Window.partitionBy(*MENTION))
    return tried.withColumn("_f", first).where(F.col("form") == F.col("_f")).select(*MENTION, "mention", "matched", "uri", "cnt")


def pruned(found: DataFrame, percentile: float = PERCENTILE, drop_singletons: bool = False) -> DataFrame:
    """Candidates by count until their share is over the percentile, the one that crosses it included."""
    w = Window.partitionBy(*MENTION).orderBy(F.desc("cnt"), "uri")
    before = F.coalesce(F.sum("cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = found.withColumn("_b", before / F.sum("cnt").over(Window.partitionBy(*MENTION))).where(F.col("_b") <= percentile).drop("_b")
    if drop_singletons:
        most = F.max("cnt").over(Window.partitionBy(*MENTION))
        kept = kept.withColumn("_m", most).where((F.col("_m") < 2) | (F.col("cnt") >= 2)).drop("_m")
    return kept


def prior_links(found: DataFrame) -> DataFrame:
    """doc_id, mention_id, uri: the most frequent candidate; ties go to the least uri."""
    return found.groupBy(*MENTION).agg(F.min_by("uri", F.struct((-F.col("cnt")).alias("n"), "uri")).alias("uri"))


def typed_links(found: DataFrame, generic_types: DataFrame, context_types: DataFrame, threshold: float = 0.9) -> DataFrame:
    """doc_id, mention_id, uri: of several candidates, by count, the first whose general type has a probability over the
    threshold in context_types(doc_id, mention_id, type, prob); an untyped one met first ends the search. Else the prior."""
    best = context_types.groupBy(*MENTION, "type").agg(F.max("prob").alias("prob"))
    one = generic_types.groupBy("uri").agg(F.min("type").alias("type"))
    typed = found.select(*MENTION, "uri", "cnt").join(one, "uri", "left").join(best, [*MENTION, "type"], "left")
    w = Window.partitionBy(*MENTION).orderBy(F.desc("cnt"), "uri")
    stop = F.max(F.col("type").isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    n = F.count(F.lit(1)).over(Window.partitionBy(*MENTION))
    rows = typed.withColumn("rank", F.row_number().over(w)).withColumn("ok", (stop == 0) & (F.coalesce("prob", F.lit(0.0)) > threshold) & (n > 1))
    return rows.groupBy(*MENTION).agg(F.coalesce(F.min_by(F.when(F.col("ok"), F.col("uri")), F.when(F.col("ok"), F.col("rank"))), F.min_by("uri", "rank")).alias("uri"))


def containing(mentions: DataFrame) -> DataFrame:
    """doc_id, mention, within: distinct mention strings of a document that are part of another one, by a plain substring test."""
    s = mentions.select("doc_id", "mention").distinct()
    return s.join(s.withColumnRenamed("mention", "within"), "doc_id").where((F.col("mention") != F.col("within")) & F.contains("within", F.col("mention")))


def subsumed(mentions: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates after subsumption, from the original ones of all: a mention within a Person mention takes its candidates
    (the first such by text); within others, the common candidates or, without any, all of theirs, and its own best.

    mentions(doc_id, mention_id, mention, ner_type); supersets without candidates don't count.
    """
    by_text = found.select("doc_id", F.col("mention").alias("within"), "uri", "cnt").dropDuplicates(["doc_id", "within", "uri"])
    kinds = mentions.groupBy("doc_id", F.col("mention").alias("within")).agg(F.min("ner_type").alias("super_type"))
    supers = containing(mentions).join(by_text.select("doc_id", "within").distinct(), ["doc_id", "within"]).join(kinds, ["doc_id", "within"])
    person = supers.where(F.col("super_type") == "<dbpedia:Person>").groupBy("doc_id", "mention").agg(F.min("within").alias("within"))
    asked = mentions.select(*MENTION, "mention")
    from_person = asked.join(person, ["doc_id", "mention"]).join(by_text, ["doc_id", "within"]).select(*MENTION, "mention", "uri", "cnt")
    other = asked.join(supers, ["doc_id", "mention"]).join(person.select("doc_id", "mention"), ["doc_id", "mention"], "left_anti")
    above = other.join(by_text, ["doc_id", "within"]).select(*MENTION, "mention", "uri", "cnt")
    common = above.join(found.select(*MENTION, "uri"), [*MENTION, "uri"], "left_semi")
    rest = above.join(common.select(*MENTION), MENTION, "left_anti")
    own = found.join(prior_links(found), [*MENTION, "uri"], "left_semi").join(other.select(*MENTION).distinct(), MENTION, "left_semi").select(*MENTION, "mention", "uri", "cnt")
    changed = from_person.unionByName(common).unionByName(rest).unionByName(own).dropDuplicates([*MENTION, "uri"])
    alone = found.join(asked.join(supers.select("doc_id", "mention").distinct(), ["doc_id", "mention"]).select(*MENTION), MENTION, "left_anti").select(*MENTION, "mention", "uri", "cnt")
    return alone.unionByName(changed)


def closest(found: DataFrame, cooccur: DataFrame) -> DataFrame:
    """Candidates after closeness pruning: for each two mentions of a document in order, those pairs of candidates that occur
    together most (both directions of cooccur(src, dst, weight) summed) stay, if any do; lower-case mentions that stay
    ambiguous lose all. The order of pairs matters, so a document is one group; its weights are joined before."""
    near = cooccur.select(F.col("src").alias("uri"), "dst", "weight")
    uris = found.select("doc_id", F.col("uri").alias("dst")).distinct()
    weights = found.select("doc_id", "uri").distinct().join(near, "uri").join(uris, ["doc_id", "dst"]).groupBy("doc_id").agg(F.collect_list(F.struct("uri", "dst", "weight")).alias("weights"))
    per = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("mention_id", "mention", "uri", "cnt"))).alias("rows")).join(weights, "doc_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, rows, weights in zip(b["doc_id"], b["rows"], b["weights"], strict=True):
                w = {(x["uri"], x["dst"]): x["weight"] for x in weights} if weights is not None else {}
                held: dict = {}
                for r in rows:
                    held.setdefault(r["mention_id"], (r["mention"], []))[1].append((r["uri"], r["cnt"]))
                ids = list(held)
                for k, first in enumerate(ids):
                    for second in ids[k + 1 :]:
                        (ta, ea), (tb, eb) = held[first], held[second]
                        if ta == tb:
                            continue
                        scored = [(w.get((x[0], y[0]), 0) + w.get((y[0], x[0]), 0), x, y) for x in ea for y in eb if (x[0], y[0]) in w or (y[0], x[0]) in w]
                        most = max((s for s, _, _ in scored), default=0)
                        if most > 0:
                            held[first] = (ta, list(dict.fromkeys(x for s, x, _ in scored if s == most)))
                            held[second] = (tb, list(dict.fromkeys(y for s, _, y in scored if s == most)))
                out += [(doc, i, t, uri, n) for i, (t, es) in held.items() if not (t.islower() and len(es) > 1) for uri, n in es]
            yield pd.DataFrame(out, columns=["doc_id", "mention_id", "mention", "uri", "cnt"])

    kinds = dict(found.dtypes)
    return per.select("doc_id", "rows", "weights").mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "mention_id", "mention", "uri", "cnt")))


def without_ambiguous_lower(found: DataFrame) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(*MENTION))
    return found.withColumn("_n", n).where(~(is_lower(F.col("mention")) & (F.col("_n") > 1))).drop("_n")


def without_tweet_entities(recognised: DataFrame, tweet: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Recognised entities whose text isn't that of a handle or hashtag of the same document."""
    return recognised.join(tweet.select(key, text).distinct(), [key, text], "left_anti")


def noun_spans(tagged: DataFrame, labels: DataFrame, key: str = "doc_id", longest: int = 5) -> DataFrame:
    """key, start, stop, mention: candidate spans round the nouns of `tagged` (array<struct<token, tag>>), joined noun phrases
    being one word: all spans of up to `longest` words that hold a noun, begin in upper case and are labels; a noun phrase
    without candidates gives its longest parts that have some."""
    known = labels.select(F.col("label").alias("mention")).distinct()
    t = tagged.select(key, joined_nouns(F.col("tagged")).alias("w"))
    nouns = t.select(key, "w", F.posexplode("w").alias("noun", "x")).where(F.col("x.tag").startswith("NN")).select(key, "w", "noun", F.col("x.token").alias("phrase"))
    grown = nouns.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(longest)))).withColumn("start", F.explode(F.sequence(F.greatest(F.col("noun") + 1 - F.col("n"), F.lit(0)), F.col("noun")))).withColumn("stop", F.col("start") + F.col("n")).where(F.col("stop") <= F.size("w"))
    spans = grown.select(key, "start", "stop", F.array_join(F.transform(F.slice("w", F.col("start") + 1, F.col("n")), lambda x: x["token"]), " ").alias("mention")).where(F.col("mention").rlike(r"^\p{Lu}")).distinct()
    whole = spans.join(known, "mention", "left_semi")
    lost = nouns.select(key, F.col("noun").alias("start"), (F.col("noun") + 1).alias("stop"), F.col("phrase").alias("mention")).where(F.col("mention").rlike(r"^\p{Lu}.* ")).join(whole.select(key, "start", "stop"), [key, "start", "stop"], "left_anti")
    words = F.split("mention", " ")
    parts = lost.select(key, "start", "stop", F.explode(F.flatten(F.array(*[F.when(F.size(words) > n, ngrams(words, n)).otherwise(F.array().cast("array<string>")) for n in range(1, longest)]))).alias("mention")).join(known, "mention", "left_semi")
    n = F.size(F.split("mention", " "))
    parts = parts.withColumn("_n", n).withColumn("_most", F.max(n).over(Window.partitionBy(key, "start", "stop"))).where(F.col("_n") == F.col("_most"))
    return whole.select(key, "start", "stop", "mention").union(parts.select(key, "start", "stop", "mention").distinct())


def kept_types(found: DataFrame, truth: DataFrame, types: DataFrame, specific: bool = False) -> DataFrame:
    """Candidates whose general type (or, if specific, any type) is the true entity's; mentions whose truth isn't a candidate stay.

    truth(doc_id, mention_id, true_uri), types(uri, types from specific to general). For experiments with known truth.
    """
    t = types.select("uri", "types")
    true = truth.join(found.select(*MENTION, F.col("uri").alias("true_uri")), [*MENTION, "true_uri"], "left_semi").join(t.select(F.col("uri").alias("true_uri"), F.col("types").alias("true_types")), "true_uri")
    rows = found.join(true.select(*MENTION, "true_types"), MENTION, "left").join(t, "uri", "left")
    general = lambda c: F.try_element_at(c, F.lit(-1))
    same = F.col("types").isNull() | F.array_contains("true_types", F.try_element_at("types", F.lit(1))) if specific else F.coalesce(general(F.col("types")) == general(F.col("true_types")), F.lit(False))
    return rows.where(F.col("true_types").isNull() | same).select(found.columns)
