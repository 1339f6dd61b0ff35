import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaloom import queries
from lexaloom.operators import coref, edits, evaluate, graphs, labels, linking, links, ngrams, segments, typed, vectors
from lexaloom.plans import services, session
from lexaloom.sources import readers, sinks
from lexaloom.streaming import streams


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_frequencies_raise_on_size(spark):
    counts = spark.createDataFrame([("a", 1, 5)], "ngram string, n int, cnt long")
    none = spark.createDataFrame([], "pattern string, substitution string, cnt long")
    asked = spark.createDataFrame([("a b c d",)], "query string")
    with pytest.raises(Exception, match="no counts of this size"):
        ngrams.frequencies(asked, counts, none, spark.createDataFrame([("x",)], "word string")).collect()


def test_candidate_labels_prefer_names(spark):
    kb = spark.createDataFrame([("Gerald_Ford", ["Person"], ["President_Ford"]), ("Ford", ["Company"], []), ("List_of:x", [], [])], "uri string, types array<string>, redirects array<string>")
    anchors = spark.createDataFrame([("Ford", "Ford", 10), ("Ford", "Gerald_Ford", 3), ("the car", "Ford", 2)], "mention string, uri string, cnt long")
    got = {(r.label, r.uri): r.cnt for r in links.candidate_labels(kb, anchors).collect()}
    assert got == {("Ford", "Ford"): 12, ("the car", "Ford"): 2, ("Gerald", "Gerald_Ford"): 3, ("Ford", "Gerald_Ford"): 3, ("Gerald Ford", "Gerald_Ford"): 3, ("President Ford", "Gerald_Ford"): 3}


def test_greedy_links_by_hand(spark):
    s = spark.createDataFrame([(1, "Paris is in New York City today".split()), (2, "he saw Big Ben Nevis now".split())], "sent_id int, tokens array<string>")
    d = spark.createDataFrame([("Paris", "P"), ("New York", "NY"), ("New York City", "NYC"), ("City today", "CT"), ("Big Ben", "BB"), ("Ben Nevis", "BN")], "label string, uri string")
    assert rows(labels.greedy_links(s, d)) == [(1, 3, 6, "New York City", "NYC"), (2, 2, 4, "Big Ben", "BB")]
    assert rows(labels.greedy_links(s, d, guard_titles=True)) == [(1, 3, 6, "New York City", "NYC")]


def test_pruning_keeps_the_row_that_crosses(spark):
    f = spark.createDataFrame([(1, 1, "m", u, n) for u, n in (("a", 80), ("b", 11), ("c", 9))], "doc_id int, mention_id int, mention string, uri string, cnt long")
    assert [r[3] for r in rows(linking.pruned(f))] == ["a", "b"]
    assert rows(linking.prior_links(f)) == [(1, 1, "a")]


def test_typed_links(spark):
    f = spark.createDataFrame([(1, 1, "m", "a", 9), (1, 1, "m", "b", 5), (1, 2, "n", "x", 9), (1, 2, "n", "b", 5)], "doc_id int, mention_id int, mention string, uri string, cnt long")
    t = spark.createDataFrame([("a", "T1"), ("b", "T2")], "uri string, type string")
    c = spark.createDataFrame([(1, 1, "T2", 0.95), (1, 2, "T2", 0.95)], "doc_id int, mention_id int, type string, prob double")
    assert rows(linking.typed_links(f, t, c)) == [(1, 1, "b"), (1, 2, "x")]  # an untyped candidate ends the search


def test_subsumption(spark):
    m = spark.createDataFrame([(1, 1, "Ford", None), (1, 2, "Gerald Ford", "<dbpedia:Person>"), (1, 3, "York", None), (1, 4, "New York", None)], "doc_id int, mention_id int, mention string, ner_type string")
    f = spark.createDataFrame([(1, 1, "Ford", "Ford", 9), (1, 2, "Gerald Ford", "G", 5), (1, 3, "York", "York", 7), (1, 3, "York", "NYC", 1), (1, 4, "New York", "NYC", 8), (1, 4, "New York", "NYS", 2)], "doc_id int, mention_id int, mention string, uri string, cnt long")
    got = {}
    for r in linking.subsumed(m, f).collect():
        got.setdefault(r.mention_id, set()).add(r.uri)
    assert got == {1: {"G"}, 2: {"G"}, 3: {"NYC", "York"}, 4: {"NYC", "NYS"}}


def test_closeness(spark):
    f = spark.createDataFrame([(1, 1, "A", "a1", 5), (1, 1, "A", "a2", 4), (1, 2, "B", "b1", 5), (1, 2, "B", "b2", 4), (1, 3, "low", "c1", 1), (1, 3, "low", "c2", 1)], "doc_id int, mention_id int, mention string, uri string, cnt long")
    near = spark.createDataFrame([("a2", "b1", 3), ("b1", "a2", 2), ("a1", "b2", 4)], "src string, dst string, weight long")
    assert rows(linking.closest(f, near), "mention_id", "uri") == [(1, "a2"), (2, "b1")]


def test_noun_spans(spark):
    t = spark.createDataFrame([(1, [("New", "NNP"), ("York", "NNP"), ("went", "VB"), ("Obama", "NNP")])], "doc_id int, tagged array<struct<token: string, tag: string>>")
    d = spark.createDataFrame([("York",), ("Obama",)], "label string")
    assert rows(linking.noun_spans(t, d)) == [(1, 0, 1, "York"), (1, 2, 3, "Obama")]


def test_metrics(spark):
    t = spark.createDataFrame([("a", True, "a"), ("b", True, "x"), ("c", True, None), ("d", False, None), (None, True, None), (None, True, "y")], "true_uri string, exists boolean, uri string")
    assert evaluate.link_metrics(t).first()[:4] == (1, 2, 1, 1)
    assert evaluate.link_metrics(t, known_only=True).first()[:4] == (1, 1, 1, 0)


def test_pair_counts_by_hand(spark):
    m = spark.createDataFrame([(1, g, c) for g, c in (("a", 1), ("a", 1), ("a", 2), ("b", 2))], "doc_id int, gold string, cluster int")
    assert rows(evaluate.pair_counts(m)) == [(1, 1, 2, 1, 2)]


def test_hierarchy(spark):
    tree = spark.createDataFrame([("Agent", "Thing"), ("Person", "Agent"), ("Place", "Thing"), ("City", "Place"), ("City", "Agent")], "child string, parent string")
    assert dict(rows(typed.depths(tree, "Thing"))) == {"Thing": 0, "Agent": 1, "Place": 1, "Person": 2, "City": 2}
    below = dict(rows(typed.parent_below(tree.select(F.col("child").alias("type")), tree, "Thing")))
    assert below == {"Agent": "Agent", "Person": "Agent", "Place": "Place", "City": "Agent"}


def test_type_prediction_backs_off(spark):
    p = spark.createDataFrame([("a b SUB", "X", 3), ("a b SUB", "Y", 1), ("SUB c", "Y", 2), ("SUB c d", "Z", 9)], "pattern string, type string, cnt long")
    c = spark.createDataFrame([(1, ["a", "b", "?", "c", "z"])], "context_id int, context array<string>")
    assert rows(typed.pattern_probabilities(c, p)) == [(1, "last", "X", 0.75), (1, "last", "Y", 0.25), (1, "middle", "Y", 1.0)]
    assert rows(typed.predicted_types(c, p), "type", "prob") == [("X", 0.375), ("Y", 0.625)]


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_contexts_are_never_broadcast(spark, monkeypatch, limit):
    """Exploded contexts, which the planner takes for small, stay where they are, whatever the patterns' size."""
    monkeypatch.setattr(session, "BROADCAST_BYTES", limit)
    p = spark.createDataFrame([(f"a b{k} SUB", t, k + 1) for k in range(300) for t in "XY"], "pattern string, type string, cnt long")
    c = spark.range(1, 2).select(F.col("id").cast("int").alias("context_id"), F.array(*map(F.lit, ["a", "b3", "?", "c", "z"])).alias("context"))
    for found in (typed.pattern_probabilities(c, p), typed.type_features(c, p)):
        assert "BuildLeft" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(typed.pattern_probabilities(c, p)) == [(1, "last", "X", 0.5), (1, "last", "Y", 0.5)]


def test_typed_patterns_compile(spark):
    """The types of a knowledge base made in the plan: its generated code compiles."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        made = spark.createDataFrame([("en/X", 1), ("de/Y", 1)], "uri string, cnt int")
        counts = spark.createDataFrame([("a <dbpedia:en/X> b", 3), ("<dbpedia:de/Y>", 1)], "ngram string, cnt long")
        got = session.checkpointed(typed.typed_patterns(counts, typed.type_at(queries.knowledge_base(made)), 1))
        assert rows(got) == [("SUB", "Lang_de", 1), ("a SUB b", "Lang_en", 3)]
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_walk_links_prefer_related():
    r = [{"mention_id": 1, "mention": "A", "uri": "a", "cnt": 5}, {"mention_id": 2, "mention": "B", "uri": "b1", "cnt": 6}, {"mention_id": 2, "mention": "B", "uri": "b2", "cnt": 4}]
    e = [{"src": "a", "dst": "b2", "weight": 9.0}, {"src": "b2", "dst": "a", "weight": 9.0}, {"src": "b1", "dst": "z", "weight": 1.0}]
    assert {(m, u) for m, u, _, _, chosen in graphs.walk_links(r, e, prior=False) if chosen} == {(1, "a"), (2, "b2")}
    g = graphs.WalkGraph(["a", "b1", "b2"], e)
    assert "z" not in g.at and g.walk(np.eye(len(g.at))[0]).sum() == pytest.approx(1)


def test_densest_prunes_large_mentions():
    r = [{"mention_id": 1, "mention": "A", "uri": f"a{k}", "cnt": k} for k in range(12)] + [{"mention_id": 2, "mention": "B", "uri": "b", "cnt": 1}]
    e = [{"src": f"a{k}", "dst": "b", "weight": float(k + 1)} for k in range(12)]
    g = graphs.DenseGraph(r, e)
    g.prune()
    assert g.link() == {1: "a11", 2: "b"}


@pytest.mark.parametrize(("fill", "most"), [(0.02, 1 << 22), (0.5, 1 << 22), (0.02, 50), (0.5, 50)])
def test_products_are_those_of_matrices(fill, most):
    r = np.random.default_rng(3)
    a, b = ((r.random((60, 60)) < fill) * r.integers(1, 9, (60, 60)) for _ in range(2))
    got = np.zeros((60, 60))
    for i, j, v in graphs.products((*np.nonzero(a), a[np.nonzero(a)].astype(float)), (*np.nonzero(b), b[np.nonzero(b)].astype(float)), most):
        assert len(set(zip(i.tolist(), j.tolist(), strict=True))) == len(i)
        got[i, j] += v
    assert (got == a @ b).all()


def test_paths_meet_before_they_move(spark, monkeypatch):
    """A full graph: no plan of common_neighbours or signatures makes its paths as rows; several tasks and one agree."""
    e = spark.range(40).select(F.col("id").alias("src")).join(spark.range(40).select(F.col("id").alias("dst"))).where("src < dst")
    found = [rows(graphs.common_neighbours(e))]
    monkeypatch.setattr(graphs, "ENTRIES", 200)
    found.append(rows(out := graphs.common_neighbours(e)))
    assert found[0] == found[1] == sorted(((i, j, 39 - j) for i in range(40) for j in range(i + 1, 39)), key=repr)
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Join") == 1


def test_common_neighbours(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("b", "d")], "src string, dst string")
    assert rows(graphs.common_neighbours(e)) == [("a", "b", 2)]


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_asked_counts_are_those_of_all(spark, monkeypatch, limit):
    """Counts of asked n-grams by broadcast and by shuffle; repeated, missing and null ones change nothing."""
    monkeypatch.setattr(ngrams, "BROADCAST_BYTES", limit)
    t = spark.createDataFrame([(["a", "b", "a", "b"],), (["b", "a"],), ([],)], "tokens array<string>")
    asked = spark.createDataFrame([("a b",), ("a b",), ("b",), ("c",), (None,)], "ngram string")
    assert {(r.ngram, r.n, r.cnt) for r in ngrams.ngram_counts(t, (1, 2), asked=asked).collect()} == {("a b", 2, 2), ("b", 1, 3)}
    assert ngrams.ngram_counts(t, (1, 2), asked=asked.limit(0)).count() == 0


def test_signatures_sum(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("b", "c", 3), ("c", "a", 1)], "src string, dst string, weight int")
    got = {r.node: r.p for r in graphs.signatures(e, spark.createDataFrame([("a",)], "uri string"), steps=3).collect()}
    m = np.array([[0, 1, 0], [0.25, 0, 0.75], [1, 0, 0]])
    v = np.array([1.0, 0, 0])
    for _ in range(3):
        v = 0.85 * v @ m + 0.15 * np.array([1.0, 0, 0])
    assert [got.get(k, 0) for k in "abc"] == pytest.approx(v.tolist())


def test_segmentation_ranking(spark):
    counts = spark.createDataFrame([("i", 900), ("live", 500), ("in", 900), ("new", 80), ("york", 60), ("new york", 60), ("live in", 2), ("in new", 1), ("i live", 1)], "ngram string, cnt long")
    wiki = spark.createDataFrame([("new york", 0.9)], "phrase string, prob double")
    t = spark.createDataFrame([(1, "I live in New York"), (2, "Alone")], "tweet_id int, text string")
    best = {r.tweet_id: r.segments for r in segments.ranked_segmentations(t, counts.withColumn("cnt", F.col("cnt") * 100_000_000), wiki).where("rank = 0").collect()}
    assert best[2] == ["alone"] and "new york" in best[1]


def test_segment_walk_isolated(spark):
    b = spark.createDataFrame([(0, 1, ["a", "b"]), (0, 2, ["a", "c"]), (0, 3, ["z"])], "block int, tweet_id int, segments array<string>")
    got = {r.segment: r.p for r in segments.segment_walk(b, spark.createDataFrame([], "phrase string, prob double")).collect()}
    assert got["b"] == pytest.approx(got["c"]) and got["a"] > got["b"] > got["z"] > 0


def test_edits(spark):
    p = spark.createDataFrame([(1, "He went at the school.", "He went to the school."), (2, "same text", "same text"), (3, "null", "x"), (4, "a of b", "a in c in b")], "edit_id int, before string, after string")
    got = rows(edits.edits(p), "edit_id", "edit1", "edit2", "i1", "j1", "is_error")
    assert (1, "at", "to", 2, 2, True) in got and not any(r[0] in (2, 3) for r in got)
    subs = rows(edits.edits(p, ["at", "to", "of", "in"]), "edit_id", "edit1", "edit2", "is_error")
    assert (1, "at", "to", True) in subs and (1, "to", "to", False) in subs and subs.count((4, "in", "in", False)) == 2
    c = edits.edit_context(edits.edits(p).where("edit_id = 1")).first().context
    assert c == ["", "he", "went", "to", "school", ",", ""]
    n = {(r.n, r.ngram, r.edit_pos) for r in edits.context_ngrams(edits.edits(p).where("edit_id = 1")).collect()}
    assert n == {(2, "went to", 1), (2, "to school", 0), (3, "he went to", 2), (3, "went to school", 1), (3, "to school ,", 0)}


def test_version_pairs(spark):
    r = spark.createDataFrame([("p", 1, "a", ""), ("p", 2, "b", "fixed grammar"), ("p", 3, "c", "typo"), ("q", 1, "x", "grammar")], "page string, rev int, text string, comment string")
    assert rows(edits.version_pairs(r, ["page"], ["rev"], comment="comment")) == [("p", 2, "a", "b")]


def test_accept_metrics_and_balance(spark):
    t = spark.createDataFrame([("a", "b", False, True), ("a", "b", False, False), ("a", "a", False, False), ("a", "b", True, None), ("c", "c", False, True)], "edit1 string, edit2 string, skipped boolean, right boolean")
    m = edits.accept_metrics(t).first()
    assert (m["true"], m["false"], m.true_err, m.false_err, m.skips, m.skips_err) == (2, 2, 1, 1, 1, 1)
    assert m.precision == pytest.approx(1 / 3) and m.recall == pytest.approx(1 / 3) and m.accuracy == 0.5
    many = spark.range(1000).select(F.col("id").alias("edit_id"), F.lit(0).alias("i1"), F.lit(0).alias("j1"), (F.col("id") % 10 == 0).alias("is_error"))
    assert rows(edits.balanced(many, share0=0.25, share1=0.5).groupBy("is_error").count()) == [(False, 225), (True, 50)]


def coref_rows(spark, *items):
    cols = "doc_id string, cluster string, mention_id string, sent_id int, start int, end int, mention string, head string, pos string, entity string, ner_text string"
    return spark.createDataFrame([("d", c, f"m{k}", k, 0, 1, m, m.split()[-1], "NN", e, m) for k, (c, m, e) in enumerate(items)], cols)


def test_coref_split_and_merge(spark):
    m = coref_rows(spark, ("1", "Bill Clinton", "BC"), ("1", "the president", None), ("1", "Al Gore", "AG"), ("1", "vice Gore", None), ("2", "Gore", "AG"), ("3", "He and Al", "BC"))
    got = {r.mention: r.new_cluster for r in coref.split_clusters(m).collect()}
    assert got["Al Gore"] == got["vice Gore"] == "m2" and got["Bill Clinton"] == got["the president"] == "1" and got["Gore"] == "2"
    merged = {r.mention: r.merged for r in coref.merge_clusters(m).collect()}
    assert merged["Gore"] == "1" and merged["He and Al"] == "3"


def test_brackets(spark):
    s = spark.createDataFrame([("d", 0, 0, 3, "1"), ("d", 0, 0, 1, "2"), ("d", 0, 1, 3, "3")], "doc_id string, sent_id int, start int, end int, cluster string")
    w = spark.createDataFrame([("d", 0, k) for k in range(4)], "doc_id string, sent_id int, word int")
    assert [r.tags for r in coref.bracket_column(s, w).orderBy("word").collect()] == ["(1|(2)", "(3", "3)|1)", "-"]


def test_linear_map(spark):
    r = np.random.default_rng(1)
    x, m = r.normal(size=(40, 3)), r.normal(size=(3, 2))
    df = spark.createDataFrame([(a.tolist(), (a @ m).tolist()) for a in x], "source array<double>, target array<double>")
    assert np.allclose(vectors.linear_map(df), m, atol=1e-4)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_triples(spark, tmp_path):
    r, o = "<http://dbpedia.org/resource/", "<http://dbpedia.org/ontology/"
    lines = [f"{r}Tom%20X> <p> {o}Actor> .", f"{r}Tom%20X> <p> <http://schema.org/Person> .", f"{r}A> <p> {o}Agent> .", f"{r}B_(disambiguation)> <p> {o}Film> .", f"{r}C> <p> {o}Wikidata:Q1> .", "junk"]
    types = readers.entity_types(spark.read.text(write(tmp_path / "t.nt", "\n".join(lines))))
    assert rows(types) == [("Tom X", "Actor"), ("Tom X", "Person")]
    red = readers.redirects(spark.read.text(write(tmp_path / "r.nt", f"{r}T> <p> {r}Tom%20X> .\n{r}a/b> <p> {r}Q> .\nx")))
    assert rows(red) == [("T", "Tom X")]
    kb = readers.knowledge_base(types, red, spark.createDataFrame([("Z",)], "uri string"))
    assert rows(kb) == [("Tom X", ["Actor", "Person"], ["T"])]


def test_ontology_file(spark, tmp_path):
    owl = '<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s"><owl:Class rdf:about="http://x/Actor"><rdfs:subClassOf rdf:resource="http://x/Person"/></owl:Class><owl:Class rdf:about="http://x/Person"><rdfs:subClassOf rdf:resource="http://x#Thing"/></owl:Class></rdf:RDF>'
    assert rows(readers.ontology(spark, write(tmp_path / "o.owl", owl))) == [("Actor", "Person"), ("Person", "Thing")]


def test_histories(spark, tmp_path):
    xml = '<posthistory><row Id="1" PostHistoryTypeId="2" PostId="7" Text="a&#10;b" /><row Id="2" PostHistoryTypeId="5" PostId="7" Text="c" Comment="Fixed  Grammar" /><row Id="3" PostHistoryTypeId="4" PostId="7" Text="t" /><row Id="4" PostHistoryTypeId="9" PostId="7" Text="no" /></posthistory>'
    h = readers.stack_history(spark, write(tmp_path / "h.xml", xml))
    assert rows(h) == [("7", 1, "a. b", ""), ("7", 2, "c", "fixed grammar"), ("7-title", 3, "t", "")]
    wiki = "<mediawiki><page><title>P</title><revision><id>1</id><text>a</text></revision><revision><id>2</id><comment>grammar</comment><text>b</text></revision></page></mediawiki>"
    w = readers.wiki_history(spark, write(tmp_path / "w.xml", wiki))
    assert rows(edits.version_pairs(w, ["page"], ["rev_id"], comment="comment")) == [("P", 2, "a", "b")]


def test_conll(spark, tmp_path):
    doc = '<DOC nid="1">\n<TEXT>\n<TITLE>\nTop\n</TITLE>\n<P>\nI live at Rome now.\n</P>\n</TEXT>\n<ANNOTATION>\n<MISTAKE start_par="1" start_off="7" end_par="1" end_off="9">\n<TYPE>Prep</TYPE>\n<CORRECTION>in</CORRECTION>\n</MISTAKE>\n<MISTAKE start_par="1" start_off="0" end_par="1" end_off="1">\n<TYPE>Other</TYPE>\n<CORRECTION>We</CORRECTION>\n</MISTAKE>\n</ANNOTATION>\n</DOC>\n'
    assert rows(readers.conll(spark, write(tmp_path / "c.sgml", doc))) == [("I live at Rome now.", "I live in Rome now."), ("Top", "Top")]


def test_fce(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("a.xml", "<x><coded_answer><p>I go <NS type='RT'><i>at</i><c>to</c></NS> school</p><p>bad <unknown/></p></coded_answer></x>")
    assert rows(readers.fce(spark, str(tmp_path / "f.zip"))) == [("I go at school", "I go to school")]


def test_truth_files(spark, tmp_path):
    t = readers.news_truth(spark, write(tmp_path / "t.txt", "~~~ d1.txt\nFord\tFord Motor\nFord\tGerald Ford\nX\tY\t!!!\nZ\tW\t---\n### d1.txt\n~~~ d2.txt\nA\tB\n"))
    assert rows(t) == [("d1.txt", "Ford", "Gerald_Ford", True), ("d2.txt", "A", "B", True)]
    m = readers.microposts(spark, write(tmp_path / "m.tsv", "1\thello Bob\tBob\thttp://dbpedia.org/resource/Bob_B\n2\tnone\n"))
    assert rows(m) == [("1", "hello Bob", "Bob", "Bob_B"), ("2", "none", None, None)]
    w = readers.microposts_with_mentions(spark, write(tmp_path / "w.tsv", "1\t6\t9\tBob\tBob_B,3 Bob_C,1\n1\t0\t3\tLeo\tX,1\n"), m.unionByName(spark.createDataFrame([("3", "t", "Eve", "Eve_E")], m.schema)))
    assert [(r.mention, r.true_uri, [c.uri for c in r.candidates]) for r in w.orderBy("mention").collect()] == [("Bob", "Bob_B", ["Bob_B", "Bob_C"]), ("Eve", "Eve_E", []), ("Leo", None, ["Leo_(astrology)"])]


def test_small_files(spark, tmp_path):
    k = readers.kb_file(spark, write(tmp_path / "k.tsv", "A\tT U\tR\nB\t\t\n"))
    assert rows(readers.typed_entities(k)) == [("A", "T"), ("A", "U")] and rows(readers.inverted_redirects(k)) == [("R", "A")]
    assert rows(readers.type_counts(spark, write(tmp_path / "c.txt", "x\tin\tSUB\t[(3, 'Place'), (1, 'Person')]\n"))) == [("in SUB", {"Place": 3, "Person": 1})]
    assert rows(readers.local_candidates(spark, write(tmp_path / "l.txt", "Ford\tA,2 B,1.5\njunk\n"))) == [("Ford", "A", 2.0), ("Ford", "B", 1.5)]
    assert rows(readers.judgements(spark, write(tmp_path / "g.tsv", "1\tx\tu\ttok\tU\tsent\n"))) == [("tok", "U", "sent", 1)]
    assert rows(readers.pairs(spark, write(tmp_path / "p.tsv", 'a "b\tc\n'))) == [('a "b', "c")]
    assert readers.sampled(spark.range(50), 7).count() == 7
    a, b = spark.createDataFrame([(2, "x"), (1, "y")], "i int, v string"), spark.createDataFrame([(1, "p"), (2, "q")], "j int, w string")
    assert rows(readers.zipped(a, b, "i", "j"), "v", "w") == [("x", "q"), ("y", "p")]


def test_coref_file(spark, tmp_path):
    line = "d\t0\t1\t5\t2\t4\tBob Dole\tDole\tDole\tNNP\t7\t3\tO\tNNP NNP\thttp://x/Bob\thttp://x/Person http://x/Agent"
    c = readers.coref(spark, write(tmp_path / "c.tsv", "h" + "\th" * 15 + "\n" + line + "\n")).first()
    assert (c.start, c.cluster, c.entity, c.entity_type) == (2, "7", "http://x/Bob", "<dbpedia:Person>")
    m = spark.createDataFrame([("d", "0", 1, "5", 2, 4, "Dole")], "doc_id string, par string, sent_id int, mention_id string, start int, end int, head string")
    spots = spark.createDataFrame([("d", "0", 1, 3, "Bob Dole", "BD"), ("d", "0", 1, 9, "Dole", "no")], "doc_id string, par string, sent_id int, word int, spot string, uri string")
    assert readers.spotted(m.withColumn("entity", F.lit(None)), spots).first().entity == "BD"


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("m", "u", 2), ("m", "v", 5)], "mention string, uri string, cnt long")
    sinks.write_packed(a, str(tmp_path / "p"), "mention", "uri")
    assert [r.value for r in spark.read.text(str(tmp_path / "p")).collect()] == ["m\tv,5 u,2"]
    sinks.write_annotations(spark.createDataFrame([("1", "m", 0, 1, None, "t"), ("2", "m", 0, 1, "u", "t")], "tweet_id string, mention string, start int, end int, uri string, text string"), str(tmp_path / "a"))
    assert [r.value for r in spark.read.text(str(tmp_path / "a")).collect()] == ["2\tm\t0\t1\tu\tt"]
    sinks.write_pair_log(spark.createDataFrame([(None, "u")], "true_uri string, uri string"), str(tmp_path / "l"))
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["None, u"]
    assert sinks.as_json(a.limit(1)).first().value.startswith('{"mention":"m"')


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "1.tsv", "1\tt\tu\tn\td\tI saw Big Ben and #London\tx\n2\tt\tu\tn\td\tBig Ben\tx\n")
    tweets = streams.tweet_stream(spark, str(tmp_path / "in"))
    links_ = spark.createDataFrame([("Big Ben", "BB"), ("London", "L")], "mention string, uri string")
    streams.run_once(streams.annotated(tweets, links_), "annotated_tweets", "append")
    assert rows(spark.table("annotated_tweets"), "tweet_id", "mention", "start", "uri") == [("1", "Big Ben", 6, "BB"), ("1", "London", 18, "L"), ("2", "Big Ben", 0, "BB")]
    streams.run_once(streams.running_ngrams(tweets, (2,), "tweet"), "stream_counts", "complete")
    assert ("Big Ben", 2) in rows(spark.table("stream_counts"))


def test_windowed_stream(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 10:05:00' AS ts, 'a b a' AS text UNION ALL SELECT timestamp'2024-01-01 12:00:00', 'a'").write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "ev"))
    streams.run_once(streams.windowed_ngrams(s, "text"), "windowed", "complete")
    assert [(r.start.hour, r.ngram, r.cnt) for r in spark.table("windowed").orderBy("start", "ngram").collect()] == [(10, "a", 2), (10, "b", 1), (12, "a", 1)]


def test_services(spark):
    docs = services.requests(spark, rows=spark.createDataFrame([(1, '{"text": "He met Ford in New York", "mentions": [{"name": "Ford", "start": 7, "end": 11}, {"name": "Nowhere", "start": 0, "end": 1}]}')], "doc_id int, json string"))
    d = spark.createDataFrame([("Ford", "Ford", 9), ("Ford", "Gerald_Ford", 5)], "label string, uri string, cnt long")
    out = services.link_by_prior(docs, d).first().json
    assert '"uri":"Ford"' in out and '"uri":"unknown"' in out
    p = spark.createDataFrame([("He met SUB", "Person", 10), ("SUB", "Person", 10)], "pattern string, type string, cnt long")
    g = spark.createDataFrame([("Ford", "Company"), ("Gerald_Ford", "Person")], "uri string, type string")
    assert '"uri":"Gerald_Ford"' in services.link_by_type(docs, d, p, g).first().json
    c = spark.createDataFrame([(1, ["He", "met", "NONE", "in", "New"])], "context_id int, context array<string>")
    assert '"name":"Person"' in services.context_types(c, p).first().json
    a = services.annotate(spark.createDataFrame([(1, "in New York and New York")], "doc_id int, text string"), spark.createDataFrame([("New York", "NY")], "label string, uri string"))
    assert rows(a) == [(1, "New York", 16, 24, "NY"), (1, "New York", 3, 11, "NY")]


def test_long_texts_have_their_best_segmentation(spark):
    texts = ["a b c d e f g h i", "b a c a b d d c a", "x y z x y z x y", "a b c d e", "u v"]
    w = "a b c d e f g h i".split()
    grams = [(" ".join(w[i : i + k]), 1000 * (10 - k) + 37 * i) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1)] + [("d d c", 900), ("x y", 50), ("b a", 70)]
    counts = spark.createDataFrame(grams, "ngram string, cnt long")
    wiki = spark.createDataFrame([("c d e", 0.9), ("a b", 0.4), ("x y z", 0.5), ("f g h i", 0.7)], "phrase string, prob double")
    tweets = spark.createDataFrame(list(enumerate(texts)), "tweet_id long, text string")
    best = lambda most: {r.tweet_id: (r.segments, round(r.score, 9)) for r in segments.ranked_segmentations(tweets, counts, wiki, most_words=most).where("rank = 0").collect()}
    assert best(4) == best(9) and len(best(4)) == 5
