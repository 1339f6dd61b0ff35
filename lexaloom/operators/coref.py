"""Coreference repair: splitting clusters of incompatible entities and merging those of the same one.

Mentions are rows (doc_id, cluster, mention_id, sent_id, start, end, mention, head, pos, entity, ner_text).
Clusters are bounded by a document's paragraph; a cluster's groups are mentions with equal lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_upper

# Head tags of nouns, and pronouns that aren't compared.
NOUNS = ["NN", "NNS", "NNP"]
PRONOUNS = ["my", "mine", "i", "he", "theirs", "you", "itself"]


def routed(mentions: DataFrame) -> DataFrame:
    """Adds `grp`, the lower-cased text, and `aside`: pronouns, heads that aren't nouns or are in upper case."""
    aside = ~F.col("pos").isin(NOUNS) | F.lower("mention").isin(PRONOUNS) | is_upper(F.col("head"))
    return mentions.withColumn("grp", F.lower("mention")).withColumn("aside", F.coalesce(aside, F.lit(True)))


def leaving_groups(rows: list[dict]) -> set[str]:
    """The groups that leave a cluster: the latest entity's, and those without one that share its exclusive words."""
    rows = sorted(rows, key=lambda r: (r["sent_id"], r["start"]))
    words, kinds = {"the", "a"}, set()
    for r in rows:
        if r["entity"] is not None:
            own = set((r["ner_text"] or "").lower().split())
            if not words >= own:
                words, kinds = words | own, kinds | {r["entity"]}
            if own >= words:
                words, kinds = own, {r["entity"]}
    if len(kinds) < 2:
        return set()
    last = [r for r in rows if r["entity"] in kinds][-1]
    entity: dict[str, str | None] = {}
    for r in rows:
        entity[r["grp"]] = entity.get(r["grp"]) or r["entity"]
    mine, exclusive = entity[last["grp"]], set(last["grp"].split())
    for g, e in entity.items():
        if e and e != mine:
            exclusive -= set(g.split())
    return {g for g, e in entity.items() if e == mine or (e is None and exclusive & set(g.split()))}


def split_clusters(mentions: DataFrame) -> DataFrame:
    """Adds new_cluster: groups that don't fit leave for a cluster named by their least mention_id. Clusters with mentions
    set aside stay whole."""
    m = routed(mentions)
    kinds = dict(mentions.dtypes)
    whole = F.struct("mention_id", "sent_id", "start", "grp", "entity", "ner_text", "aside")
    per = m.groupBy("doc_id", "cluster").agg(F.collect_list(whole).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, cluster, rows in zip(b["doc_id"], b["cluster"], b["rows"], strict=True):
                rows = [dict(r.asDict() if hasattr(r, "asDict") else r) for r in rows]
                leave = set() if any(r["aside"] for r in rows) else leaving_groups(rows)
                gone = [r["mention_id"] for r in rows if r["grp"] in leave]
                out += [(doc, cluster, r["mention_id"], min(gone) if r["grp"] in leave else cluster) for r in rows]
            yield pd.DataFrame(out, columns=["doc_id", "cluster", "mention_id", "new_cluster"])

    names = per.mapInPandas(run, f"doc_id {kinds['doc_id']}, cluster {kinds['cluster']}, mention_id {kinds['mention_id']}, new_cluster {kinds['cluster']}")
    return mentions.join(names, ["doc_id", "cluster", "mention_id"])


def merge_clusters(mentions: DataFrame, column: str = "cluster") -> DataFrame:
    """Adds merged: clusters of a document that share an entity take the least of their names, clusters with ` and ` in a
    noun mention apart. By repeated least labels over shared entities; a document has few clusters, so few rounds."""
    conj = routed(mentions).where(~F.col("aside") & F.contains("mention", F.lit(" and "))).select("doc_id", column).distinct()
    links = routed(mentions).where(F.col("entity").isNotNull() & ~F.col("aside")).select("doc_id", column, "entity").distinct().join(conj, ["doc_id", column], "left_anti")
    from ..plans.session import checkpointed

    names = checkpointed(links.select("doc_id", column, "entity", F.col(column).alias("merged")))
    while True:
        by_entity = names.groupBy("doc_id", "entity").agg(F.min("merged").alias("m"))
        by_cluster = names.join(by_entity, ["doc_id", "entity"]).groupBy("doc_id", column).agg(F.min("m").alias("new"))
        moved = checkpointed(names.join(by_cluster, ["doc_id", column]))
        if moved.where("new < merged").isEmpty():
            break
        names = moved.select("doc_id", column, "entity", F.col("new").alias("merged"))
    found = names.groupBy("doc_id", column).agg(F.min("merged").alias("merged"))
    return mentions.join(found, ["doc_id", column], "left").withColumn("merged", F.coalesce("merged", column))


def bracket_column(spans: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, sent_id, word, tags: nested `(id`, `id)`, `(id)` marks joined by `|`, `-` where there are none.

    spans(doc_id, sent_id, start, end, cluster), end past the last word; outer spans open first, inner ones close first.
    """
    s = spans.select("doc_id", "sent_id", "start", "end", F.col("cluster").cast("string").alias("cluster"))
    single = (F.col("end") == F.col("start") + 1).cast("int")
    opening = s.select("doc_id", "sent_id", F.col("start").alias("word"), F.struct(F.lit(0).alias("side"), (-F.col("end")).alias("o"), F.col("cluster").alias("c"), F.when(single == 1, F.concat(F.lit("("), "cluster", F.lit(")"))).otherwise(F.concat(F.lit("("), "cluster")).alias("tag")).alias("t"))
    closing = s.where(single == 0).select("doc_id", "sent_id", (F.col("end") - 1).alias("word"), F.struct(F.lit(1).alias("side"), (-F.col("start")).alias("o"), F.col("cluster").alias("c"), F.concat("cluster", F.lit(")")).alias("tag")).alias("t"))
    marks = opening.unionByName(closing).groupBy("doc_id", "sent_id", "word").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["tag"]), "|").alias("tags"))
    return words.select("doc_id", "sent_id", "word").distinct().join(marks, ["doc_id", "sent_id", "word"], "left").withColumn("tags", F.coalesce("tags", F.lit("-")))
