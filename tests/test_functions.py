import math

import pytest
from pyspark.sql import functions as F

from lexaloom.functions import arrays as A
from lexaloom.functions import math as M
from lexaloom.functions import text as T


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("non-violence (anarcho-pacifism), while others", "non-violence ( anarcho-pacifism ) , while others"),
        ("(roughly 500 BC to 800 AD). The site", "( roughly 500 BC to 800 AD ) . The site"),
        ("Around .4 percent", "Around .4 percent"),
        ("terms a.m. (ante meridiem) and p.m. (post meridiem)", "terms a.m. ( ante meridiem ) and p.m. ( post meridiem )"),
        ("U.S.). and .5) (e.g.)", "U.S.). and .5) ( e.g. )"),
        ("'' ... <b>", "' ' . . . < b >"),
    ],
)
def test_tokenize(spark, text, tokens):
    assert " ".join(one(spark, T.tokenize(F.col("t")), t=text)) == tokens


def test_wiki_tokens_keep_brackets(spark):
    assert one(spark, T.wiki_tokenize(F.col("t")), t="<A|b>, c") == ["<A|b>", ",", "c"]


@pytest.mark.parametrize(("text", "classes"), [("3.5", "<NUM:INT>.<NUM:INT>"), ("0.5", "<NUM:OTHER><NUM:INT>"), ("42", "<NUM:INT>"), ("1,200", "<NUM:INT>"), ("12%", "<NUM:PERCENT>"), ("007", "<NUM:OTHER>"), ("2015th", "<NUM:OTHER>th"), ("no", "no"), ("20 square miles", "<NUM:AREA>")])
def test_number_classes(spark, text, classes):
    assert one(spark, T.number_classes(F.col("t")), t=text) == classes


def test_sentences(spark):
    assert one(spark, T.sentences(F.col("t")), t="A b . C d . e f ? G") == ["A b .", "C d . e f ."]


@pytest.mark.parametrize(("n", "ways"), [(1, 1), (2, 1), (3, 3), (4, 7), (5, 15), (6, 30), (7, 58), (8, 112), (10, 416)])
def test_segmentations(spark, n, ways):
    assert one(spark, F.size(T.segmentations(F.split(F.col("t"), " "))), t=" ".join(f"w{i}" for i in range(n))) == ways


def test_words_and_labels(spark):
    assert one(spark, T.camel_split(F.col("t")), t="NewYorkCity") == "New York City"
    assert one(spark, T.title_case(F.col("t")), t="o'neil-smith 2nd") == "O'Neil-Smith 2Nd"
    assert one(spark, T.label_of_uri(F.col("t")), t="Paris,_Texas_(film)") == "Paris"
    assert set(one(spark, T.person_labels(F.col("t")), t="A B C")) == {"A", "B", "C", "A B", "A C", "B C", "A B C"}
    assert one(spark, T.unquote(F.col("t")), t="a+b%20c") == "a+b c" and one(spark, T.unquote(F.col("t")), t="100%") == "100%"
    assert one(spark, T.plain_characters(F.col("t")), t="“ﬁne” – ok�") == '"fine" - ok'
    assert one(spark, T.astrology_uri(F.col("t"), F.lit("x")), t="leos") == "Leo_(astrology)" and one(spark, T.astrology_uri(F.col("t"), F.lit("x")), t="dog") == "x"
    assert one(spark, T.history_text(F.col("t")), t="a \n b\té") == "a . b"
    assert one(spark, T.without_tags(F.col("t"), "i", "c"), t="a <i>b</i><c>d</c>") == "a b"
    assert one(spark, T.html_unescape(F.col("t")), t="&lt;a&gt; &amp;amp;") == "<a> &amp;"
    assert one(spark, T.without_wiki_markup(F.col("t")), t="'''Bold''' [[link]]") == "Bold link"
    assert one(spark, T.without_wiki_markup(F.col("t")), t="== Head ==\n** item [[File:a.png|thumb]]x\n{{cite|a}}[[Paris (city)|Paris]] <!-- no --> y") == " Head \n * item x\nParis  y"
    assert sorted(one(spark, T.person_labels(F.col("t")), t="a b c")) == ["a", "a b", "a b c", "a c", "b", "b c", "c"]
    assert len(one(spark, T.person_labels(F.col("t")), t=" ".join("abcdefghijk"))) == 2**11 - 1
    assert one(spark, T.sentence_key(F.col("t")), t=' "The dog\'s tail" ') == "The dog tail"
    assert one(spark, T.edit_cell(F.col("t")), t=" a** b!!  c ") == "a b! c" and one(spark, T.edit_cell(F.col("t")), t="null") is None
    assert one(spark, T.compressed_pos(F.col("t")), t="VBD") == "VB"


def test_entities(spark):
    assert one(spark, T.replace_types(F.col("t")), t="in <LOCATION>New York</LOCATION> .") == "in <dbpedia:Place> ."
    assert one(spark, T.replace_entities(F.col("t")), t="in <LOCATION>New York</LOCATION> .") == "in <LOCATION> ."
    links = one(spark, T.link_tags(F.col("t")), t="a <paris|the_City> b")
    assert [(x.uri, x.anchor) for x in links] == [("Paris", "the City")]
    assert one(spark, T.link_text(F.col("t")), t="a <paris|the_City> b") == "a the City b"
    assert one(spark, T.context(F.col("t"), F.lit(14), F.lit(22)), t="I went to the New York city") == ["to", "the", "NONE", "city", "NONE"]
    assert [(x.text, x.start, x.end, x.word) for x in one(spark, T.tweet_entities(F.col("t")), t="hi @bob and #New_York!")] == [("bob", 4, 7, 1), ("New_York", 13, 21, 3)]


def tagged(*items):
    return F.array(*[F.struct(F.lit(a).alias("token"), F.lit(b).alias("tag")) for a, b in items])


def test_tagged_tokens(spark):
    got = one(spark, T.strip_adjectives(tagged(("big", "JJ"), ("red", "JJ"), ("dog", "NN"), ("is", "VB"), ("nice", "JJ"), (",", ","), ("old", "JJ"))))
    assert [x.token for x in got] == ["dog", "is", "nice", ","]
    got = one(spark, A.joined_nouns(tagged(("New", "NNP"), ("York", "NNP"), ("is", "VB"), ("Big", "NN"))))
    assert [x.token for x in got] == ["New York", "is", "Big"]
    assert one(spark, T.strip_determiners(F.split(F.lit("the dog is a ."), " "))) == ["dog", "is", "a", "."]
    assert one(spark, T.possessive_tokens(F.split(F.lit("Bob's dog"), " "))) == ["Bob", "'s", "dog"]


def test_arrays(spark):
    assert one(spark, A.pack(A.unpack(F.col("t"))), t="a,1 b,c,2 x y,3") == "a,1 b,c,2 y,3"
    assert one(spark, A.ngrams(F.split(F.col("t"), " "), 2), t="a b c") == ["a b", "b c"] and one(spark, A.ngrams(F.split(F.col("t"), " "), 4), t="a b c") == []
    assert one(spark, A.replaced_at(F.split(F.col("t"), " "), F.lit(1)), t="a b c") == ["a", "SUB", "c"]
    assert one(spark, A.slot_of(F.split(F.col("t"), " ")), t="a SUB") == 1 and one(spark, A.slot_of(F.split(F.col("t"), " ")), t="a") == -1
    assert one(spark, A.frame(F.array(F.lit("a")), F.array(F.lit("x")), F.split(F.lit("b c d"), " "), 2)) == ["", "a", "x", "b", "c"]
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop")) for a, b in ((3, 5), (0, 2), (1, 4), (4, 6))])
    assert [(s.start, s.stop) for s in one(spark, A.greedy_spans(spans))] == [(0, 2), (3, 5)]
    assert len(one(spark, A.pairs(F.array(*map(F.lit, "abcd"))))) == 6
    assert one(spark, A.one_hot(["a", "b"], F.lit("b"))) == [0, 1]


def test_measures(spark):
    d = [F.lit(float(x)) for x in (10, 30, 20, 1000)]
    assert one(spark, M.BIGRAM_MEASURES["pmi"](*d)) == pytest.approx(math.log2(10 * 1000 / 600))
    assert one(spark, M.BIGRAM_MEASURES["dice"](*d)) == pytest.approx(0.4)
    a, b, c, e = 10, 10, 20, 960
    phi = (a * e - b * c) ** 2 / ((a + b) * (a + c) * (b + e) * (c + e))
    assert one(spark, M.BIGRAM_MEASURES["chi_sq"](*d)) == pytest.approx(1000 * phi)
    g = 2 * sum(x * math.log(x * 1000 / m) for x, m in ((a, 20 * 30), (b, 20 * 970), (c, 980 * 30), (e, 980 * 970)))
    assert one(spark, M.BIGRAM_MEASURES["likelihood_ratio"](*d)) == pytest.approx(g)
    assert one(spark, M.stickiness(F.lit(2), F.lit(0.0), F.lit(None).cast("double"))) == 0.0
    assert one(spark, M.stickiness(F.lit(2), F.lit(0.0), F.lit(0.0))) == pytest.approx(0.5)
    assert one(spark, M.unigram_scp(F.lit(369177688671))) == 0.0
    assert one(spark, M.kl_term(F.lit(0.5), F.lit(0.0))) == 10.0
    assert one(spark, M.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.5**0.5)
