"""Lemmas and synonyms by a lexicon table.

lexicon(word, pos, lemma, synset): a row for each sense of a word form; forms and lemmas are lower-case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lemmas(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, pos, lemma of words(word, pos): the least lemma of a form with that tag, the word itself where it has none."""
    forms = lexicon.groupBy(F.col("word").alias("_w"), F.col("pos").alias("_p")).agg(F.min("lemma").alias("lemma"))
    asked = words.select("word", "pos").distinct()
    found = asked.join(forms, (F.lower("word") == F.col("_w")) & (F.col("pos") == F.col("_p")), "left")
    return found.select("word", "pos", F.coalesce("lemma", F.lower("word")).alias("lemma"))


def synonyms(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, pos, synonyms: the lemmas that share a synset with the word's lemma under that tag, in order, without the word; empty if none."""
    own = lemmas(words, lexicon)
    senses = lexicon.select("lemma", "pos", "synset").distinct()
    others = senses.select(F.col("lemma").alias("synonym"), F.col("pos").alias("_p"), "synset")
    pairs = own.join(senses, ["lemma", "pos"]).join(others, "synset").where((F.col("pos") == F.col("_p")) & (F.col("synonym") != F.col("lemma")) & (F.col("synonym") != F.lower("word")))
    found = pairs.groupBy("word", "pos").agg(F.array_sort(F.collect_set("synonym")).alias("synonyms"))
    return own.select("word", "pos").join(found, ["word", "pos"], "left").withColumn("synonyms", F.coalesce("synonyms", F.array().cast("array<string>")))
