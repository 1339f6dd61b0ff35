import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from lexaloom.operators import edits, evaluate, features, graphs, labels, linking, links, ngrams, typed, vectors
from lexaloom.plans.session import Tables, checkpointed
from lexaloom.sources import readers, sinks
from lexaloom.streaming import streams


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_case_rules(spark):
    schema = "mention string, uri string, cnt long"
    predicted = spark.createDataFrame([("Apple", "A", 4), ("apple", "A", 3), ("pear", "P", 5), ("plum", "L", 1)], schema)
    organic = spark.createDataFrame([("apple", "A", 2), ("Apple", "A", 9), ("pear", "P", 2)], schema)
    c = {r.uri: r for r in labels.case_counts(predicted, organic).collect()}
    assert (c["A"].infer_upper, c["A"].infer_lower, c["A"].orig_upper, c["A"].orig_lower) == (4, 3, 9, 2)
    assert c["L"].orig_lower == 0
    assert rows(labels.included_labels(labels.case_counts(predicted, organic))) == [("Apple", "A"), ("apple", "A"), ("pear", "P")]


def test_organic_links(spark):
    lines = spark.createDataFrame([(1, "He saw <paris|the_City> and <Big_Ben|Ben> .")], "sent_id int, sentence string")
    red = spark.createDataFrame([("Paris", "Paris_(France)"), ("Paris", "Paris,_France")], "alias string, canonical string")
    found = labels.organic_links(lines, red)
    s = "He saw the City and Ben ."
    assert rows(found, "token", "uri", "sentence") == [("Ben", "Big_Ben", s), ("the City", "Paris,_France", s)]
    assert rows(labels.precise(found), "token") == [("Ben",)]
    more = spark.createDataFrame([("Ben", "Big_Ben", s), ("City", "C", s)], "token string, uri string, sentence string")
    assert len(rows(labels.plus(found, more))) == 3


def test_generators(spark):
    spans = spark.createDataFrame([("new york",), ("Ford 's",), ("x",)], "span string")
    d = spark.createDataFrame([("New York", "NY"), ("Ford 's", "F")], "label string, uri string")
    assert rows(labels.unambiguous_generator(d)(spans)) == [("Ford 's", "Ford", "F")]
    assert ("new york", "new york", "NY") in rows(labels.unambiguous_generator(d, try_title=True)(spans))
    assert rows(labels.label_generator(d)(spans)) == [("Ford 's", "Ford 's", "F")]


def test_generator_metrics(spark):
    gold = spark.createDataFrame([("a", "A", ' "S one" ', 1), ("b", "B", "S one", 0), ("c", "C", "S's two", 1)], "token string, uri string, sentence string, correct int")
    mine = spark.createDataFrame([("a", "A", "S one"), ("b", "B", "S one"), ("z", "Z", "S one")], "token string, uri string, sentence string")
    m = evaluate.generator_metrics(gold, mine).first()
    assert (m.n, m.right, m.precision, m.recall) == (2, 1, 0.5, 0.5)
    assert rows(evaluate.unranked(gold, mine)) == [("z", "Z", "S one")]


def test_known_truth_types(spark):
    f = spark.createDataFrame([(1, 1, "m", u, 1) for u in "abc"] + [(1, 2, "n", "z", 1)], "doc_id int, mention_id int, mention string, uri string, cnt long")
    t = spark.createDataFrame([(1, 1, "a"), (1, 2, "y")], "doc_id int, mention_id int, true_uri string")
    kinds = spark.createDataFrame([("a", ["City", "Place"]), ("b", ["Town", "Place"])], "uri string, types array<string>")
    assert rows(linking.kept_types(f, t, kinds), "mention_id", "uri") == [(1, "a"), (1, "b"), (2, "z")]
    assert rows(linking.kept_types(f, t, kinds, specific=True), "mention_id", "uri") == [(1, "a"), (1, "c"), (2, "z")]
    low = f.withColumn("mention", F.lower("mention"))
    assert rows(linking.without_ambiguous_lower(low), "mention_id") == [(2,)]
    assert len(rows(linking.pruned(f, drop_singletons=True))) == 4


def test_adjacency_and_lookup(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "x_(disambiguation)")], "src string, dst string")
    assert rows(links.adjacency(e)) == [("a", "b", 2)]
    c = spark.createDataFrame([("m", "u", 2)], "mention string, uri string, cnt long")
    assert rows(links.looked_up(spark.createDataFrame([("m",), ("q",)], "mention string"), c, "mention", "uri")) == [("m", "u", 2)]
    assert rows(readers.looked_up(spark.createDataFrame([("m",), ("q",)], "mention string"), c, "mention", "cnt", 0)) == [("m", 2), ("q", 0)]
    assert rows(ngrams.union_counts([c.select(F.col("mention").alias("ngram"), "cnt")] * 2)) == [("m", 4)]
    assert rows(ngrams.at_most(spark.createDataFrame([("a b", 1), ("a b c", 1)], "ngram string, cnt int"), 2)) == [("a b", 1)]


def test_graph_summaries(spark):
    f = spark.createDataFrame([(1, 1, "m", "a", 1), (1, 2, "n", "a", 1), (1, 2, "n", "b", 1), (1, 3, "o", "q", 1)], "doc_id int, mention_id int, mention string, uri string, cnt long")
    e = spark.createDataFrame([(1, "a", "b", 3)], "doc_id int, src string, dst string, weight int")
    assert rows(graphs.fragment_counts(f, e)) == [(1, "a", 2), (1, "b", 1)]
    assert rows(graphs.degrees(e)) == [(1, 1, 2, 1.0)]
    many = spark.createDataFrame([(1, 1, "Big Ben", f"u{k:02d}", 100 - k) for k in range(12)] + [(1, 1, "Big Ben", "Ben_Nevis", 1), (1, 1, "Big Ben", "zzz", 1)], f.schema)
    assert {r.uri for r in graphs.top_candidates(many).collect()} == {f"u{k:02d}" for k in range(10)} | {"Ben_Nevis"}


def test_balanced_contexts(spark):
    s = spark.range(300).select(F.col("id"), (F.col("id") < 30).cast("int").alias("label"))
    assert rows(typed.balanced_contexts(s).groupBy("label").count()) == [(0, 60), (1, 30)]
    assert rows(typed.balanced_contexts(s, per_class=10).groupBy("label").count()) == [(0, 10), (1, 10)]


def test_linked_ngrams_strict(spark):
    s = spark.createDataFrame([(1, ["The", "Big", "Ben", "Rings"])], "sent_id int, tokens array<string>")
    link = spark.createDataFrame([(1, 1, 3, "BB")], "sent_id int, start int, stop int, uri string")
    assert ("the <dbpedia:BB> rings", 3, 1) in rows(typed.linked_ngrams(s, link))
    assert rows(typed.linked_ngrams(s, link, strict=True), "ngram") == [("<dbpedia:BB>",), ("the <dbpedia:BB>",), ("the",)]


def test_edit_features_and_validation(spark):
    r = spark.createDataFrame([(k, "in", "in", ["he", "was"], ["the", "big", "house"], ["PR", "VB"], ["DT", "JJ", "NN"], ["IN"], False) for k in range(2)], "edit_id int, edit1 string, edit2 string, left_tokens array<string>, right_tokens array<string>, left_tags array<string>, right_tags array<string>, edit_tags array<string>, is_error boolean")
    assert edits.without_adjectives(r).first().right_tokens == ["the", "house"]
    g = edits.context_ngrams(r.limit(1), tags=True)
    assert {(x.ngram, tuple(x.tags)) for x in g.where("n = 2").collect()} == {("was in", ("VB", "IN")), ("in the", ("IN", "DT"))}
    assert {x.ngram for x in g.where(edits.useful(F.col("tags"))).collect()} == {"was in", "he was in", "was in the", "in the big"}
    assert edits.ngram_importance(g).where("ngram = 'was in'").first().norm_position == -1
    flags = r.select(edits.neighbour_tag_flags(F.col("left_tags"), F.col("right_tags"))).first()[0]
    assert flags == [1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0]
    assert [x.edit_id for x in edits.errors_first(r.withColumn("is_error", F.col("edit_id") == 1)).collect()] == [1, 0]
    data = spark.createDataFrame([(k, "in", "on" if k % 2 else "in", s, float((s == "on") == bool(k % 2)), int(("on" if k % 2 else "in") == s)) for k in range(40) for s in ("in", "on")], "edit_id int, edit1 string, edit2 string, substitution string, x double, label int")
    made = VectorAssembler(inputCols=["x"], outputCol="features").transform(data)
    m = edits.validation(made, LogisticRegression(labelCol="label").fit(made)).first()
    assert (m["true"], m["false"], m.skips, m.precision, m.recall) == (20, 0, 20, 1.0, 1.0)


def test_feature_merge(spark):
    f = spark.createDataFrame([(1, "m", "a", 1, 0.2, 0.5), (1, "m", "a", 2, 0.9, 0.4), (1, "m", "b", 1, 1.0, 0.3)], "doc_id int, mention string, uri string, mention_id int, type_prob double, prior_prob double")
    got = {x.uri: x for x in features.merged_features(f).collect()}
    assert (got["a"].type_prob, got["a"].number_merged, got["a"].prior_prob, got["a"].type_prob_rank, got["a"].prior_prob_rank) == (0.9, 2, 0.5, 1, 0)
    assert got["b"].type_prob_rank == 0


def test_word_sets(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "word string, vector array<double>")
    got = rows(vectors.word_set_scores(spark.createDataFrame([("a",), ("b",)], "item string"), spark.createDataFrame([("a",), ("c",)], "word string"), v))
    assert got[0] == ("a", pytest.approx(1 + 0.5**0.5)) and got[1] == ("b", pytest.approx(0.5**0.5))
    near = vectors.nearest(v.withColumn("vec_id", F.col("word")).where("word = 'a'"), v.withColumn("vec_id", F.col("word")), 1, vector="vector")
    assert rows(near, "item") == [("c",)]


def test_serving_table(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS served_counts")
    c = spark.createDataFrame([("a b", 3), ("a b c d", 1)], "ngram string, cnt long")
    sinks.write_table(c, "served_counts", "ngram", buckets=2, max_words=3)
    assert rows(Tables(ngrams="served_counts").read(spark, "ngrams")) == [("a b", 3)]
    sinks.write_features(c, str(tmp_path / "f"), group=("ngram",))
    assert spark.read.csv(str(tmp_path / "f"), sep="\t", header=True).count() == 2
    sinks.write_contexts(spark.createDataFrame([(["a", "b"],)], "context array<string>"), str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).first().value == "a b"
    spark.sql("DROP TABLE served_counts")
    assert checkpointed(c).count() == 2


def test_segment_stream(spark, tmp_path):
    spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "tweet_id int, segments array<string>").write.parquet(str(tmp_path / "s"))
    s = spark.readStream.schema("tweet_id int, segments array<string>").parquet(str(tmp_path / "s"))
    streams.run_once(streams.segment_sets(s), "segment_sets", "complete")
    assert {r.segment: sorted(r.tweets) for r in spark.table("segment_sets").collect()} == {"a": [1, 2], "b": [1]}


def test_deep_hierarchies(spark):
    from lexaloom.operators import typed

    tree = spark.createDataFrame([(f"t{k + 1}", f"t{k}") for k in range(70)], "child string, parent string")
    assert {r.type: r.depth for r in typed.depths(tree, "t0").collect()}["t70"] == 70
    patterns = spark.createDataFrame([("a SUB", "t9", 3), ("a SUB", "t1", 1)], "pattern string, type string, cnt long")
    contexts = spark.createDataFrame([("c", ["x", "a", "SUB", "b", "y"])], "context_id string, context array<string>")
    got = typed.hierarchical_types(contexts, patterns, tree.where("child IN ('t1','t2','t3','t4','t5','t6','t7','t8','t9')"), "t0").collect()
    assert max(r.level for r in got) == 8 and {r.type for r in got} == {f"t{k}" for k in range(1, 10)}


def test_linked_ngrams_rebuild_sentences(spark):
    from lexaloom.operators import typed

    sentences = spark.createDataFrame([(1, ["The", "New", "York", "City", "Hall"]), (2, ["No", "Links"]), (3, ["Rome"])], "sent_id long, tokens array<string>")
    links = spark.createDataFrame([(1, 1, 3, "NY"), (1, 2, 4, "YC"), (3, 0, 1, "R")], "sent_id long, start int, stop int, uri string")
    grams = lambda strict: {r.ngram for r in typed.linked_ngrams(sentences, links, strict=strict).where("n = 1").collect()}
    assert grams(False) == {"the", "<dbpedia:NY>", "<dbpedia:YC>", "hall", "no", "links", "<dbpedia:R>"}
    assert grams(True) == {"the", "<dbpedia:NY>", "<dbpedia:YC>", "no", "<dbpedia:R>"}


def test_pattern_counts_match_those_of_ngrams(spark):
    from lexaloom.operators import ngrams

    rows = [(["of", "the", "of"],), (["x"],), ([],), (["in", "a", "b", "of", "c"],)]
    s, v = spark.createDataFrame(rows, "tokens array<string>"), spark.createDataFrame([("of",), ("in",)], "word string")
    want = ngrams.substitution_patterns(ngrams.ngram_counts(s), v)
    assert sorted(map(tuple, ngrams.pattern_counts(s, v).collect())) == sorted(map(tuple, want.collect()))


def test_synonyms_and_tweet_entities(spark):
    from lexaloom.operators import lexicon, linking

    rows = [("cars", "n", "car", 1), ("car", "n", "car", 1), ("auto", "n", "auto", 1), ("car", "n", "car", 2), ("wagon", "n", "wagon", 2), ("car", "v", "car", 3), ("ride", "v", "ride", 3)]
    table = spark.createDataFrame(rows, "word string, pos string, lemma string, synset long")
    words = spark.createDataFrame([("Cars", "n"), ("car", "v"), ("sky", "n")], "word string, pos string")
    assert {(r.word, r.pos): r.synonyms for r in lexicon.synonyms(words, table).collect()} == {("Cars", "n"): ["auto", "wagon"], ("car", "v"): ["ride"], ("sky", "n"): []}
    assert {r.word: r.lemma for r in lexicon.lemmas(words, table).collect()} == {"Cars": "car", "car": "car", "sky": "sky"}
    ner = spark.createDataFrame([(1, "Paris"), (1, "nasa"), (2, "nasa")], "doc_id long, text string")
    assert sorted(map(tuple, linking.without_tweet_entities(ner, spark.createDataFrame([(1, "nasa")], "doc_id long, text string")).collect())) == [(1, "Paris"), (2, "nasa")]


@pytest.mark.parametrize("sizes", [(16_384, 65_536), (3, 40)])
def test_nearest_by_blocks(spark, monkeypatch, sizes):
    """Blocks of matrices find what a comparison of all pairs finds: copies tie by item, vectors without a direction are last; no join of pairs."""
    monkeypatch.setattr(vectors, "QUERIES", sizes[0])
    monkeypatch.setattr(vectors, "ITEMS", sizes[1])
    r = np.random.default_rng(2)
    x = r.normal(size=(120, 8)).astype(np.float32)
    x[60:90], x[7] = x[3], 0
    v = spark.createDataFrame([(i, [float(a) for a in y]) for i, y in enumerate(x)] + [(120, None)], "vec_id long, embedding array<float>")
    found = vectors.nearest(v.where("vec_id % 10 = 3"), v, 10, digits=6)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = [(f.query, f.rank, f.item, f.score) for f in found.orderBy("query", "rank").collect()]
    want = []
    for i in range(3, 120, 10):
        score = {j: round(float(x[i].astype(float) @ y.astype(float) / np.sqrt((x[i].astype(float) ** 2).sum() * (y.astype(float) ** 2).sum())), 6) for j, y in enumerate(x) if j not in (i, 7)}
        want += [(i, n + 1, j, s) for n, (j, s) in enumerate(sorted(score.items(), key=lambda p: (-p[1], p[0]))[:10])]
    assert got == want
    few = vectors.nearest(v.where("vec_id = 3"), v.where("vec_id IN (3, 7, 9, 120)"), 10).orderBy("rank").collect()
    assert [f.item for f in few] == [9, 7, 120] and few[1].score is None


def test_word_vectors_are_trained_in_parts(spark, monkeypatch):
    t = spark.createDataFrame([(["a", "b", "c", "d"],)] * 40, "tokens array<string>")
    assert vectors.word_vectors(t, size=4, min_count=2).getNumPartitions() == 1
    monkeypatch.setattr(vectors, "WORDS", 50)
    model = vectors.word_vectors(t, size=4, min_count=2)
    assert model.getNumPartitions() == 4 and {r.word for r in vectors.vectors_of(model).collect()} == set("abcd")


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_asked_patterns_are_those_of_all(spark, monkeypatch, limit):
    monkeypatch.setattr(ngrams, "BROADCAST_BYTES", limit)
    t = spark.createDataFrame([(["a", "of", "b", "in"],), (["of"],), ([],), (None,)], "tokens array<string>")
    words = spark.createDataFrame([("of",), ("in",)], "word string")
    every = {(r.pattern, r.substitution): r.cnt for r in ngrams.pattern_counts(t, words).collect()}
    assert every[("SUB", "of")] == 2 and every[("a SUB b", "of")] == 1 and every[("of b SUB", "in")] == 1 and len(every) == 8
    asked = spark.createDataFrame([("SUB",), ("a SUB",), ("a SUB",), ("x SUB",)], "pattern string")
    got = {(r.pattern, r.substitution): r.cnt for r in ngrams.pattern_counts(t, words, asked=asked).collect()}
    assert got == {k: v for k, v in every.items() if k[0] in ("SUB", "a SUB")}


def test_counts_are_compiled(spark):
    """Windows of n-grams are made by compiled code, without lambdas, and not sent anywhere before they are counted."""
    t = spark.createDataFrame([(["a", "b", "a"],), (["c"],), ([],), (None,)], "tokens array<string>")
    found = ngrams.ngram_counts(t, (1, 2, 3))
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.ngram, r.n, r.cnt) for r in found.collect()) == [("a", 1, 2), ("a b", 2, 1), ("a b a", 3, 1), ("b", 1, 1), ("b a", 2, 1), ("c", 1, 1)]


def test_starts_are_never_broadcast(spark):
    """Sentences' words, which the planner takes for small once exploded, stay where they are in greedy linking."""
    s = spark.range(1, 2).select(F.col("id").alias("sent_id"), F.array(*map(F.lit, "x New York of New".split())).alias("tokens"))
    labs = spark.createDataFrame([("New York", "NY"), ("New York of", "NYO"), ("New", "N")], "label string, uri string")
    found = labels.greedy_links(s, labs)
    assert "BuildLeft" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, 1, 4, "New York of", "NYO"), (1, 4, 5, "New", "N")]
