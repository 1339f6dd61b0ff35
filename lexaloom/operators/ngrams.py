"""N-gram counts, collocation measures and substitution patterns.

Counts are tables (ngram, n, cnt); a lookup is a left join with 0 for what is missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import SLOT, replaced_at, slot_of
from ..functions.math import BIGRAM_MEASURES, TRIGRAM_MEASURES, normal_position

BROADCAST_BYTES = 16 << 20  # of asked n-grams, measured


def ngram_counts(sentences: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), tokens: str = "tokens", asked: DataFrame | None = None) -> DataFrame:
    """ngram, n, cnt over the token arrays, of asked(ngram) alone if given; counts combine before the shuffle.

    asked should be a stored table: it is measured, and broadcast up to BROADCAST_BYTES; beyond that the join is a shuffle.
    """
    at = sentences.select(F.col(tokens).alias("_t"), F.posexplode(tokens).alias("_i", "_w"))  # compiled with the counts, which windows by lambdas aren't
    grams = [F.when(F.col("_i") + n <= F.size("_t"), F.concat_ws(" ", "_w", *[F.get("_t", F.col("_i") + k) for k in range(1, n)])) for n in sizes]
    exploded = at.select((F.explode(F.array(*grams)) if len(grams) > 1 else grams[0]).alias("ngram")).where("ngram IS NOT NULL")
    if asked is not None:
        exploded = exploded.join(_asked(asked.select("ngram").distinct(), "ngram"), "ngram", "left_semi")
    return exploded.groupBy("ngram").agg(F.count(F.lit(1)).alias("cnt")).select("ngram", F.size(F.split("ngram", " ")).alias("n"), "cnt")


def _asked(asked: DataFrame, column: str) -> DataFrame:
    size = asked.agg(F.sum(F.octet_length(column) + 16)).first()[0] or 0
    return F.broadcast(asked) if size <= BROADCAST_BYTES else asked


def summed(counts: DataFrame) -> DataFrame:
    """One row for each n-gram of a count table that may have several."""
    return counts.groupBy("ngram").agg(F.sum("cnt").alias("cnt"))


def prefiltered(counts: DataFrame) -> DataFrame:
    """Printable ASCII n-grams without tagged words or two adjacent non-words; ` %` joined to the number before."""
    w = F.split("ngram", " ")
    tagged = F.exists(w, lambda x: F.contains(x, F.lit("_")) & (x != "_"))
    return counts.where(F.col("ngram").rlike(r"^[\x20-\x7E]*$") & ~tagged & ~F.col("ngram").rlike(r"(^| )\W+ \W+($| )")).withColumn("ngram", F.replace("ngram", F.lit(" %"), F.lit("%")))


def at_most(counts: DataFrame, n: int) -> DataFrame:
    return counts.where(F.size(F.split("ngram", " ")) <= n)


def bigram_association(bigrams: DataFrame, unigrams: DataFrame, measure: str = "pmi") -> DataFrame:
    """ngram, w1, w2, cnt, score of each bigram over the corpus counts."""
    total = unigrams.agg(F.sum("cnt").alias("total"))
    first, second = (unigrams.select(F.col("ngram").alias(f"w{k}"), F.col("cnt").alias(f"c{k}")) for k in (1, 2))
    pairs = bigrams.select("ngram", "cnt", F.element_at(F.split("ngram", " "), 1).alias("w1"), F.element_at(F.split("ngram", " "), 2).alias("w2"))
    joined = pairs.join(first, "w1").join(second, "w2").join(F.broadcast(total))  # one row
    score = BIGRAM_MEASURES[measure](*[F.col(c).cast("double") for c in ("cnt", "c1", "c2", "total")])
    return joined.select("ngram", "w1", "w2", "cnt", score.alias("score"))


def ranked(scored: DataFrame, by: list[str], score: str = "score", tie: str = "ngram") -> DataFrame:
    """Adds a 0-based rank within `by`, best first."""
    return scored.withColumn("rank", (F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)) - 1).cast("long"))


def substitution_patterns(counts: DataFrame, substitutions: DataFrame, min_count: int = 0) -> DataFrame:
    """pattern, substitution, cnt: each n-gram once for each slot that holds a substitution, the slot as SUB; under SUB the marginals."""
    subs = substitutions.select(F.col("word").alias("substitution")).distinct()
    w = F.split("ngram", " ")
    slots = counts.where(F.col("cnt") >= min_count).select(w.alias("w"), "cnt", F.posexplode(w).alias("place", "substitution")).join(subs, "substitution")
    return slots.select(F.array_join(replaced_at(F.col("w"), F.col("place")), " ").alias("pattern"), "substitution", "cnt").groupBy("pattern", "substitution").agg(F.sum("cnt").alias("cnt"))


def pattern_counts(sentences: DataFrame, substitutions: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), tokens: str = "tokens", asked: DataFrame | None = None) -> DataFrame:
    """What substitution_patterns makes of the n-gram counts, from the token arrays: only windows round a substitution
    are made and counted. substitutions(word) are a task's vocabulary, one row of an array. With asked(pattern), as the
    asked n-grams of ngram_counts, of those patterns alone."""
    subs = F.broadcast(substitutions.agg(F.collect_set("word").alias("_subs")))
    t, i, size = F.col(tokens), F.col("_i"), F.size(tokens)
    at = sentences.join(subs).select(tokens, "_subs", F.posexplode(tokens).alias("_i", "substitution")).where(F.array_contains("_subs", F.col("substitution")))

    def window(n, k):  # of n tokens, with the slot as its k-th
        words = [F.lit(SLOT) if j == k else F.get(t, i + (j - k)) for j in range(n)]
        return F.when((i >= k) & (i - k + n <= size), F.concat_ws(" ", *words))

    rows = at.select(F.explode(F.array(*[window(n, k) for n in sizes for k in range(n)])).alias("pattern"), "substitution").where("pattern IS NOT NULL")
    if asked is not None:
        rows = rows.join(_asked(asked.select("pattern").distinct(), "pattern"), "pattern", "left_semi")
    return rows.groupBy("pattern", "substitution").agg(F.count(F.lit(1)).alias("cnt"))


def frequencies(queries: DataFrame, counts: DataFrame, patterns: DataFrame, substitutions: DataFrame) -> DataFrame:
    """query, ngram, cnt for queries(query): plain n-grams of 1 to 3 words and SUB patterns of 1 to 4, zeros included.

    Other sizes raise. A SUB pattern gives a row for each substitution.
    """
    w = F.split("query", " ")
    slot = slot_of(w)
    ok = F.when(slot >= 0, F.size(w) <= 4).otherwise(F.size(w) <= 3)
    q = queries.select("query").distinct().withColumn("query", F.when(ok, F.col("query")).otherwise(F.raise_error(F.concat(F.lit("no counts of this size: "), F.col("query")))))
    plain = q.where(slot < 0).join(counts.select(F.col("ngram").alias("query"), "cnt"), "query", "left").select("query", F.col("query").alias("ngram"), F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))
    subs = substitutions.select(F.collect_set("word").alias("subs"))  # one row: the vocabulary of a task, as it is configured
    asked = q.where(slot >= 0).join(F.broadcast(subs)).select("query", F.explode("subs").alias("substitution"))
    found = asked.join(patterns.select(F.col("pattern").alias("query"), "substitution", "cnt"), ["query", "substitution"], "left")
    slots = found.select("query", F.array_join(replaced_at(w, slot, F.col("substitution")), " ").alias("ngram"), F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))
    return plain.unionByName(slots)


def local_association(patterns: DataFrame, contexts: DataFrame, measure: str = "pmi", unigrams: DataFrame | None = None, bigrams: DataFrame | None = None) -> DataFrame:
    """context, substitution, cnt, score, rank (0 the best) of the substitutions in contexts(context), n-grams with one SUB.

    As a collocation finder over one context: the total is of the context's words and all substitutions;
    substitutions without a count have no row. Three-word contexts need bigram counts for their marginals.
    """
    w = F.split("context", " ")
    c = contexts.select("context").distinct().select("context", w.alias("w"), slot_of(w).alias("place"))
    found = c.join(patterns.select(F.col("pattern").alias("context"), "substitution", "cnt"), "context").where(F.col("cnt") > 0)
    sub_total = unigrams.join(patterns.where(F.col("pattern") == SLOT).select(F.col("substitution").alias("ngram")), "ngram", "left_semi").agg(F.sum("cnt").alias("subs"))
    others = c.select("context", F.explode(F.filter("w", lambda x: x != SLOT)).alias("ngram")).join(unigrams.select("ngram", F.col("cnt").alias("c")), "ngram", "left").groupBy("context").agg(F.sum(F.coalesce("c", F.lit(0))).alias("own"), F.exp(F.sum(F.ln(F.col("c").cast("double")))).alias("product"))
    joined = found.join(others, "context").join(F.broadcast(sub_total)).join(unigrams.select(F.col("ngram").alias("substitution"), F.col("cnt").alias("c_sub")), "substitution", "left")
    total = (F.col("own") + F.col("subs")).cast("double")
    two = BIGRAM_MEASURES[measure](F.col("cnt").cast("double"), F.col("c_sub").cast("double"), F.col("product"), total)
    three = TRIGRAM_MEASURES[measure](F.col("cnt").cast("double"), F.col("c_sub").cast("double"), F.col("product"), F.lit(1.0), total) if measure in TRIGRAM_MEASURES else F.lit(None).cast("double")
    scored = joined.select("context", "substitution", "cnt", "place", F.size("w").alias("n"), F.when(F.size("w") == 2, two).otherwise(three).alias("score"))
    return ranked(scored.withColumn("norm_position", normal_position(F.col("place"), F.col("n"))), ["context"], tie="substitution")


def union_counts(tables: list[DataFrame]) -> DataFrame:
    """Sum of several count tables."""
    return summed(reduce(DataFrame.unionByName, [t.select("ngram", "cnt") for t in tables]))
