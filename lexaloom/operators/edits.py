"""Edit histories: version pairs, word differences, context n-grams and feature vectors."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.base import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import frame, one_hot
from ..functions.math import normal_position
from ..functions.text import edit_cell, edit_token, strip_adjectives, strip_determiners, tokenize

# Tags whose word pairs say little, and the tags that features name.
USELESS_TAGS = ["DT", "PR", "TO", "CD", "WD", "WP"]
TOP_TAGS = ["VB", "NN", "JJ", "RB", "DT", "OTHER"]
DEFAULT_RANK, DEFAULT_SCORE = 50, -10

OPS = "array<struct<i1: int, i2: int, j1: int, j2: int>>"


def previous_versions(revisions: DataFrame, by: list[str], order: list[str], text: str = "text") -> DataFrame:
    """Adds `before`: the version before each one of its group."""
    return revisions.withColumn("before", F.lag(text).over(Window.partitionBy(*by).orderBy(*order)))


def version_pairs(revisions: DataFrame, by: list[str], order: list[str], text: str = "text", comment: str | None = None, terms: tuple[str, ...] = ("grammar", "spelling")) -> DataFrame:
    """by, order, before, after of changed versions; with a comment column, of those whose comment has one of the terms."""
    pairs = previous_versions(revisions, by, order, text).where(F.col("before").isNotNull() & (F.col("before") != F.col(text)))
    if comment:
        said = F.lit(False)
        for t in terms:
            said = said | F.contains(F.lower(comment), F.lit(t))
        pairs = pairs.where(said)
    return pairs.select(*by, *order, "before", F.col(text).alias("after"))


def word_pairs(pairs: DataFrame, tokens=tokenize, keep: tuple[str, ...] = ("edit_id",)) -> DataFrame:
    """keep, tokens1, tokens2 of pairs(before, after), cleaned, tokenised and without determiners."""
    clean = pairs.select(*keep, edit_cell(F.col("before")).alias("a"), edit_cell(F.col("after")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return clean.select(*keep, strip_determiners(tokens(F.col("a"))).alias("tokens1"), strip_determiners(tokens(F.col("b"))).alias("tokens2"))


def differences(pairs: DataFrame, keep: tuple[str, ...] = ("edit_id",)) -> DataFrame:
    """Adds `ops`: the changed spans of each two token arrays, as a sequence matcher finds them. The one step without a native form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist(), strict=True):
                out.append([{"i1": i1, "i2": i2, "j1": j1, "j2": j2} for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, x, y).get_opcodes() if tag != "equal"])
            ops = pa.array(out, pa.list_(pa.struct([(c, pa.int32()) for c in ("i1", "i2", "j1", "j2")])))
            yield pa.RecordBatch.from_arrays([*b.columns, ops], names=[*keep, "tokens1", "tokens2", "ops"])

    kinds = dict(pairs.dtypes)
    return pairs.select(*keep, "tokens1", "tokens2").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + f", tokens1 array<string>, tokens2 array<string>, ops {OPS}")


def _edit_rows(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    span = lambda t, a, b: F.lower(F.array_join(F.slice(t, F.col(a) + 1, F.col(b) - F.col(a)), " "))
    e1, e2 = span("tokens1", "i1", "i2"), span("tokens2", "j1", "j2")
    return df.select(*keep, e1.alias("edit1"), e2.alias("edit2"), "i1", "i2", "j1", "j2", F.slice("tokens2", F.lit(1), F.col("j1")).alias("left_tokens"), F.slice("tokens2", F.col("j2") + 1, F.size("tokens2")).alias("right_tokens"), (e1 != e2).alias("is_error"))


def edits(pairs: DataFrame, substitutions: list[str] | None = None, keep: tuple[str, ...] = ("edit_id",)) -> DataFrame:
    """keep, edit1, edit2, i1, i2, j1, j2, left_tokens, right_tokens, is_error of pairs(before, after).

    With substitutions, changes are cut down to the one substitution at the same offset in both (others are
    dropped), and every substitution of the new version is a row too, as unchanged.
    """
    d = differences(word_pairs(pairs, keep=keep), keep)
    changed = d.select(*keep, "tokens1", "tokens2", F.explode("ops").alias("o")).select(*keep, "tokens1", "tokens2", "o.*")
    if substitutions is None:
        return _edit_rows(changed, keep)

    def hits(tokens: str, a: str, b: str) -> Column:
        part = F.slice(tokens, F.col(a) + 1, F.col(b) - F.col(a))
        return F.filter(F.transform(part, lambda t, k: F.when(t.isin(substitutions), k)), lambda k: k.isNotNull())

    one = changed.withColumn("h1", hits("tokens1", "i1", "i2")).withColumn("h2", hits("tokens2", "j1", "j2")).where((F.size("h1") == 1) & (F.size("h2") == 1)).where(F.col("h1")[0] == F.col("h2")[0])
    cut = one.select(*keep, "tokens1", "tokens2", (F.col("i1") + F.col("h1")[0]).alias("i1"), (F.col("i1") + F.col("h1")[0] + 1).alias("i2"), (F.col("j1") + F.col("h2")[0]).alias("j1"), (F.col("j1") + F.col("h2")[0] + 1).alias("j2"))
    return _edit_rows(cut, keep).unionByName(words_where(d, lambda t: t.isin(substitutions), keep))


def words_where(pairs: DataFrame, wanted, keep: tuple[str, ...] = ("edit_id",)) -> DataFrame:
    """An unchanged edit for each word of tokens2 that `wanted` (Column to Column) accepts."""
    rows = pairs.select(*keep, F.col("tokens2").alias("tokens1"), "tokens2", F.posexplode("tokens2").alias("i1", "t")).where(wanted(F.col("t")))
    return _edit_rows(rows.withColumn("i2", F.col("i1") + 1).withColumn("j1", F.col("i1")).withColumn("j2", F.col("i1") + 1), keep)


def edit_context(rows: DataFrame, size: int = 3, fill: str = "") -> DataFrame:
    """Adds `context`: size tokens before, the new words, size after, in lower case with number classes."""
    return rows.withColumn("context", F.transform(frame(F.col("left_tokens"), F.split("edit2", " "), F.col("right_tokens"), size, fill), edit_token))


def context_ngrams(rows: DataFrame, size: int = 3, fill: str = "", tags: bool = False) -> DataFrame:
    """Adds n, ngram, edit_pos (and tags) for every n-gram of 2 to size tokens that covers a one-word edit; padded ones have no row."""
    out = None
    for n in range(2, size + 1):
        made = _covering(rows, n, fill, tags)
        out = made if out is None else out.unionByName(made)
    return out


def _covering(rows: DataFrame, n: int, fill: str, tags: bool) -> DataFrame:
    c = edit_context(rows, n - 1, fill)
    tagged = frame(F.col("left_tags"), F.col("edit_tags"), F.col("right_tags"), n - 1, fill) if tags else None

    def gram(k: Column) -> Column:
        return F.struct(F.slice("context", k + 1, n).alias("w"), (F.lit(n - 1) - k).alias("edit_pos"), *([F.slice(tagged, k + 1, n).alias("tags")] if tags else []))

    made = c.withColumn("x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), gram))).where(~F.array_contains("x.w", fill) & (F.size("x.w") == n))
    return made.select(*rows.columns, F.lit(n).alias("n"), F.array_join("x.w", " ").alias("ngram"), F.col("x.edit_pos").alias("edit_pos"), *([F.col("x.tags").alias("tags")] if tags else []))


def without_adjectives(rows: DataFrame) -> DataFrame:
    """Edits whose left and right tokens (with left_tags, right_tags) have no adjectives before nouns."""

    def side(name: str) -> dict[str, Column]:
        tagged = strip_adjectives(F.zip_with(f"{name}_tokens", f"{name}_tags", lambda t, tag: F.struct(t.alias("token"), tag.alias("tag"))))
        return {f"{name}_tokens": F.transform(tagged, lambda t: t["token"]), f"{name}_tags": F.transform(tagged, lambda t: t["tag"])}

    return rows.withColumns(side("left") | side("right"))


def useful(tags: Column) -> Column:
    """False for two-word n-grams with a tag that says little."""
    return ~((F.size(tags) == 2) & F.arrays_overlap(F.transform(tags, lambda t: F.substring(t, 1, 2)), F.array(*map(F.lit, USELESS_TAGS))))


def confusion(rows: DataFrame) -> DataFrame:
    """edit1, edit2, cnt."""
    return rows.groupBy("edit1", "edit2").agg(F.count(F.lit(1)).alias("cnt"))


def errors_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("is_error"), *[c for c in rows.columns if c in ("edit_id", "i1", "j1")])


def balanced(rows: DataFrame, share0: float = 1.0, share1: float = 1.0, seed: int = 1, by: tuple[str, ...] = ("edit_id", "i1", "j1")) -> DataFrame:
    """The given shares of correct and wrong edits, drawn without replacement in a seeded order; a sampling operator.

    A class is drawn by the hash below which its share of rows lies, exactly, from ranks within hash buckets.
    """
    h = F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(1 << 20))
    r = rows.withColumn("_h", h)
    per = r.groupBy("is_error", "_h").agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy("is_error").orderBy("_h")
    starts = per.select("is_error", "_h", (F.sum("_k").over(w) - F.col("_k")).alias("_s"), F.sum("_k").over(Window.partitionBy("is_error")).alias("_n"))
    own = F.row_number().over(Window.partitionBy("is_error", "_h").orderBy(*by))
    share = F.when(F.col("is_error"), share1).otherwise(share0)
    return r.withColumn("_r", own).join(starts, ["is_error", "_h"]).where(F.col("_s") + F.col("_r") <= F.floor(F.col("_n") * share)).drop("_h", "_r", "_s", "_n")


def position_features(scored: DataFrame, substitutions: DataFrame, confusions: DataFrame, keep: tuple[str, ...] = ("edit_id",)) -> DataFrame:
    """keep, substitution, features (by name), label for scored(keep, edit1, edit2, n, norm_position, substitution, rank, score).

    scored has the ranked substitutions of each useful context n-gram; substitutions(word) without a row in one
    count as rank 50, score -10. Averages by n-gram size and by normal position, tops of rankings, the share of the
    substitution among the edits of the original word, and the substitution itself.
    """
    subs = substitutions.select(F.array_sort(F.collect_set("word")).alias("subs"))  # one row: the vocabulary of the task
    grams = scored.select(*keep, "edit1", "edit2", "n", "norm_position", "context").distinct().join(F.broadcast(subs)).withColumn("substitution", F.explode("subs"))
    full = grams.join(scored.select(*keep, "context", "substitution", "rank", "score"), [*keep, "context", "substitution"], "left").withColumn("rank", F.coalesce("rank", F.lit(DEFAULT_RANK))).withColumn("score", F.coalesce("score", F.lit(float(DEFAULT_SCORE))))

    def avg(value: str, when: Column, default: float) -> Column:
        return F.coalesce(F.avg(F.when(when, F.col(value))), F.lit(float(default)))

    n, at = F.col("n"), F.col("norm_position")
    centre = F.min_by(F.struct("n", "rank"), F.when(at == 0, F.struct(-n, F.col("context"))))
    made = full.groupBy(*keep, "edit1", "edit2", "substitution").agg(
        avg("rank", n == 2, DEFAULT_RANK).alias("avg_rank_2gram"),
        avg("rank", n == 3, DEFAULT_RANK).alias("avg_rank_3gram"),
        avg("score", n == 3, DEFAULT_SCORE).alias("avg_pmi_3gram"),
        F.coalesce(F.max(F.when(at == 0, n)), F.lit(0)).alias("len_zero_ngram"),
        F.coalesce(centre["rank"], F.lit(DEFAULT_RANK)).alias("zero_ngram_rank"),
        F.count_if((n == 3) & (F.col("rank") == 0)).alias("top_prep_count_3gram"),
        *[avg("rank", at == p, DEFAULT_RANK).alias(f"avg_rank_position_{p}") for p in (-1, 0, 1)],
    )
    share = confusions.withColumn("conf_matrix_score", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("edit1"))).select("edit1", F.col("edit2").alias("substitution"), "conf_matrix_score")
    out = made.join(share, ["edit1", "substitution"], "left").withColumn("conf_matrix_score", F.coalesce("conf_matrix_score", F.lit(0.0)))
    return out.withColumn("has_avg_2gram", (F.col("avg_rank_2gram") != DEFAULT_RANK).cast("int")).withColumn("has_avg_3gram", (F.col("avg_rank_3gram") != DEFAULT_RANK).cast("int")).withColumn("label", (F.col("edit2") == F.col("substitution")).cast("int"))


def substitution_flags(substitutions: list[str], column: str = "substitution") -> Column:
    return one_hot(substitutions, F.col(column))


def neighbour_tag_flags(left: Column, right: Column) -> Column:
    """Flags of the tags next to the edit, the last for any other tag; zeros without a neighbour."""

    def flags(tag: Column) -> Column:
        named = F.array(*[(tag == t).cast("int") for t in TOP_TAGS[:-1]])
        return F.when(tag.isNull(), F.array_repeat(F.lit(0), len(TOP_TAGS))).otherwise(F.concat(named, F.array(F.when(F.array_contains(named, 1), 0).otherwise(1))))

    return F.concat(flags(F.try_element_at(left, F.lit(-1))), flags(F.try_element_at(right, F.lit(1))))


def ngram_importance(ngrams: DataFrame) -> DataFrame:
    """Adds norm_position, size, n_scored and flags of tags in the n-gram, the inputs of an importance model."""
    tags = F.col("tags")
    flags = F.array(*[F.array_contains(tags, t).cast("int") for t in ("NN", "VB", "JJ", "DT", "RB")])
    return ngrams.withColumn("norm_position", normal_position(F.col("edit_pos"), F.col("n"))).withColumn("tag_flags", flags)


def validation(features: DataFrame, model: Model, keep: tuple[str, ...] = ("edit_id",), threshold: float = 0.5) -> DataFrame:
    """One row of accept and skip metrics of a classifier over features(keep, edit1, edit2, substitution, features).

    Suggestions are substitutions with at least the threshold, best first. An edit is skipped without any, or if the
    original is one. Precision is right on errors over that and all wrong, recall right on errors over all errors.
    """
    p = model.transform(features).withColumn("p", vector_to_array("probability")[1])
    w = Window.partitionBy(*keep).orderBy(F.desc("p"), "substitution")
    rows = p.withColumn("r", F.row_number().over(w) - 1).withColumn("ok", F.col("p") >= threshold)
    per = rows.groupBy(*keep, "edit1", "edit2").agg(F.min_by("substitution", F.when(F.col("ok"), F.col("r"))).alias("first"), F.count_if(F.col("ok")).alias("n"), F.max(F.col("ok") & (F.col("substitution") == F.col("edit1"))).alias("own"), F.min(F.when(F.col("substitution") == F.col("edit2"), F.col("r"))).alias("position"))
    return accept_metrics(per.withColumn("skipped", (F.col("n") == 0) | F.col("own")).withColumn("right", F.col("first") == F.col("edit2")))


def accept_metrics(rows: DataFrame) -> DataFrame:
    """true, false, true_err, false_err, skips, skips_err, precision, accuracy, recall, f1 of rows(edit1, edit2, skipped, right)."""
    err, used, right = F.col("edit1") != F.col("edit2"), ~F.col("skipped"), F.coalesce(F.col("right"), F.lit(False))
    c = rows.agg(F.count_if(used & right).alias("true"), F.count_if(used & ~right).alias("false"), F.count_if(used & right & err).alias("true_err"), F.count_if(used & ~right & err).alias("false_err"), F.count_if(~used).alias("skips"), F.count_if(~used & err).alias("skips_err"), F.count_if(err).alias("errors"))
    p, r = F.coalesce(F.try_divide(F.col("true_err"), F.col("true_err") + F.col("false")), F.lit(0.0)), F.try_divide(F.col("true_err"), F.col("errors"))
    return c.select("*", p.alias("precision"), F.try_divide(F.col("true"), F.col("true") + F.col("false")).alias("accuracy"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))
