"""The engine's queries over the star tables, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import arrays as A
from .functions import text as T
from .functions.math import BIGRAM_MEASURES
from .operators import coref, edits, evaluate, features, graphs, labels, linking, links, ngrams, segments, typed, vectors
from .plans.session import checkpointed, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Fixed values of the queries: a substitution vocabulary and n-grams that are asked for.
PREPOSITIONS = ["of", "in", "to", "for", "on", "with", "at", "by", "from"]
ASKED = ["the", "of the", "SUB the", "is SUB the", "SUB", "zzz qqq"]
RATIOS = [0.5, 1.0, 2.0, 5.0, 20.0]


_held: dict[tuple, DataFrame] = {}


def once(f):
    """What a query uses several times over, stored at its first use; the next query starts anew."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf: str, **options) -> DataFrame:
        key = (f.__name__, sf, *sorted(options.items()))
        if key not in _held:
            _held[key] = checkpointed(f(spark, sf, **options))
        return _held[key]

    return run


def query(sql: str | None = None):
    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            _held.clear()
            try:
                return f(spark, sf)
            finally:
                _held.clear()

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.words(F.lower(F.coalesce("text", F.lit("")))).alias("tokens"))


def counts(spark: SparkSession, sf: str, *sizes: int) -> DataFrame:
    return ngrams.ngram_counts(doc_tokens(spark, sf), sizes)


TOK = r"""tok AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') AS tokens FROM documents)"""


def _grams(n: int) -> str:
    return f"unnest(CASE WHEN len(tokens) >= {n} THEN list_transform(range(1, len(tokens) - {n - 2}), lambda i: array_to_string(list_slice(tokens, i, i + {n - 1}), ' ')) ELSE [] END)"


def _counted(n: int, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT ngram, {n} AS n, count(*) AS cnt FROM (SELECT {_grams(n)} AS ngram FROM tok) GROUP BY ngram)"


def _ngram_query(n: int) -> None:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        return counts(spark, sf, n)

    f.__name__ = f"ngram_counts_{n}"
    query(f"WITH {TOK}, {_counted(n, 'g')} SELECT ngram, CAST(n AS INT) AS n, cnt FROM g")(f)


for _n in (1, 2, 3):
    _ngram_query(_n)


@query(f"""WITH {TOK}, {_counted(2, 'g')} SELECT replace(ngram, ' %', '%') AS ngram, cnt FROM g
    WHERE regexp_matches(ngram, '^[\\x20-\\x7E]*$') AND NOT list_bool_or(list_transform(string_split(ngram, ' '), lambda w: contains(w, '_') AND w <> '_'))
      AND NOT regexp_matches(ngram, '(^| )[^0-9A-Za-z_]+ [^0-9A-Za-z_]+($| )')""")
def ngram_prefilter(spark, sf):
    return ngrams.prefiltered(counts(spark, sf, 2)).select("ngram", "cnt")


@query(f"""WITH {TOK}, {_counted(1, 'u')}, {_counted(2, 'g')}, t AS (SELECT sum(cnt) AS total FROM u),
    s AS (SELECT g.ngram, g.cnt, round(log2(g.cnt::DOUBLE * total) - log2(a.cnt::DOUBLE * b.cnt), 6) AS score FROM g JOIN u a ON a.ngram = split_part(g.ngram, ' ', 1) JOIN u b ON b.ngram = split_part(g.ngram, ' ', 2), t WHERE g.cnt >= 5)
    SELECT ngram, cnt, score, row_number() OVER (ORDER BY score DESC, ngram) - 1 AS rank FROM s QUALIFY rank < 100""")
def bigram_pmi_topk(spark, sf):
    scored = ngrams.bigram_association(counts(spark, sf, 2).where("cnt >= 5"), counts(spark, sf, 1)).select("ngram", "cnt", F.round("score", 6).alias("score"))
    top = scored.orderBy(F.desc("score"), "ngram").limit(100)  # the report's size
    return top.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("score"), "ngram")) - 1).cast("long"))


@query(f"""WITH {TOK}, {_counted(1, 'u')}, {_counted(2, 'g')}, t AS (SELECT sum(cnt)::DOUBLE AS n FROM u),
    s AS (SELECT g.ngram, g.cnt::DOUBLE AS ii, a.cnt::DOUBLE AS ix, b.cnt::DOUBLE AS xi, t.n FROM g JOIN u a ON a.ngram = split_part(g.ngram, ' ', 1) JOIN u b ON b.ngram = split_part(g.ngram, ' ', 2), t WHERE g.cnt >= 20)
    SELECT ngram, round(ii / n, 9) AS raw_freq, round((ii - ix * xi / n) / sqrt(ii + 1e-20), 6) AS student_t, round(2 * ii / (ix + xi), 9) AS dice, round(ii / (ix + xi - ii), 9) AS jaccard,
           round(ii * (log2(ii / (ix * xi / n)) - 1), 4) AS poisson_stirling FROM s""")
def bigram_measures(spark, sf):
    u, g = counts(spark, sf, 1), counts(spark, sf, 2).where("cnt >= 20")
    total = u.agg(F.sum("cnt").alias("total"))
    w = F.split("ngram", " ")
    side = lambda k: u.select(F.col("ngram").alias(f"w{k}"), F.col("cnt").alias(f"c{k}"))
    j = g.select("ngram", "cnt", w[0].alias("w1"), w[1].alias("w2")).join(side(1), "w1").join(side(2), "w2").join(F.broadcast(total))  # one row
    args = [F.col(c).cast("double") for c in ("cnt", "c1", "c2", "total")]
    digits = {"raw_freq": 9, "student_t": 6, "dice": 9, "jaccard": 9, "poisson_stirling": 4}
    return j.select("ngram", *[F.round(BIGRAM_MEASURES[m](*args), d).alias(m) for m, d in digits.items()])



SUBS = ", ".join(f"'{w}'" for w in PREPOSITIONS)
PATTERNS = f"""pat AS MATERIALIZED (SELECT array_to_string(list_transform(w, lambda x, j: CASE WHEN j = i THEN 'SUB' ELSE x END), ' ') AS pattern, w[i] AS substitution, CAST(sum(cnt) AS BIGINT) AS cnt
    FROM (SELECT string_split(ngram, ' ') AS w, cnt, unnest(range(1, n + 1)) AS i FROM allg) WHERE w[i] IN ({SUBS}) GROUP BY 1, 2)"""
ALLG = f"{TOK}, {_counted(1, 'u')}, {_counted(2, 'g2')}, {_counted(3, 'g3')}, allg AS (SELECT * FROM u UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3)"


def vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in PREPOSITIONS], "word string")


def patterns(spark: SparkSession, sf: str, **options) -> DataFrame:
    return ngrams.pattern_counts(doc_tokens(spark, sf), vocabulary(spark), **options)


@query(f"WITH {ALLG}, {PATTERNS} SELECT pattern, substitution, cnt FROM pat")
def sub_patterns(spark, sf):
    return patterns(spark, sf)


@query(f"""WITH {ALLG}, {PATTERNS}, q(query) AS (VALUES {", ".join(f"('{a}')" for a in ASKED)}), s(substitution) AS (VALUES {", ".join(f"('{w}')" for w in PREPOSITIONS)})
    SELECT query, query AS ngram, coalesce(cnt, 0) AS cnt FROM q LEFT JOIN allg ON ngram = query WHERE NOT list_contains(string_split(query, ' '), 'SUB')
    UNION ALL SELECT query, array_to_string(list_transform(string_split(query, ' '), lambda x: CASE WHEN x = 'SUB' THEN s.substitution ELSE x END), ' '), coalesce(cnt, 0)
    FROM q CROSS JOIN s LEFT JOIN pat ON pattern = query AND pat.substitution = s.substitution WHERE list_contains(string_split(query, ' '), 'SUB')""")
def ngram_frequencies(spark, sf):
    asked = spark.createDataFrame([(a,) for a in ASKED], "query string")
    found = ngrams.ngram_counts(doc_tokens(spark, sf), (1, 2, 3), asked=asked.select(F.col("query").alias("ngram")))
    return ngrams.frequencies(asked, found, patterns(spark, sf, asked=asked.select(F.col("query").alias("pattern"))), vocabulary(spark))


@query(f"""WITH {ALLG}, {PATTERNS}, c AS (SELECT pattern AS context, substitution, cnt, list_filter(string_split(pattern, ' '), lambda x: x <> 'SUB')[1] AS w FROM pat WHERE len(string_split(pattern, ' ')) = 2),
    t AS (SELECT sum(cnt) AS subs FROM u WHERE ngram IN ({SUBS})),
    s AS (SELECT context, substitution, c.cnt, round(log2(c.cnt::DOUBLE * (uw.cnt + subs)) - log2(us.cnt::DOUBLE * uw.cnt), 6) AS score FROM c JOIN u uw ON uw.ngram = c.w JOIN u us ON us.ngram = c.substitution, t)
    SELECT context, substitution, cnt, score, row_number() OVER (PARTITION BY context ORDER BY score DESC, substitution) - 1 AS rank FROM s""")
def context_association(spark, sf):
    p = stored(patterns(spark, sf, sizes=(1, 2)), "patterns")  # contexts of two words and the substitutions' own counts
    contexts = p.where(F.size(F.split("pattern", " ")) == 2).select(F.col("pattern").alias("context"))
    found = ngrams.local_association(p, contexts, unigrams=stored(counts(spark, sf, 1), "unigrams")).withColumn("score", F.round("score", 6))
    return ngrams.ranked(found.drop("rank"), ["context"], tie="substitution").select("context", "substitution", "cnt", "score", "rank")


@query(f"""WITH {TOK}, {_counted(1, 'u')}, {_counted(2, 'g2')}, ph AS MATERIALIZED (SELECT DISTINCT ngram AS phrase, split_part(ngram, ' ', 1) AS w1, split_part(ngram, ' ', 2) AS w2 FROM (SELECT {_grams(2)} AS ngram FROM (SELECT list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS tokens FROM benchmark))),
    j AS MATERIALIZED (SELECT phrase, g2.cnt AS c, a.cnt AS ca, b.cnt AS cb FROM ph LEFT JOIN g2 ON g2.ngram = phrase LEFT JOIN u a ON a.ngram = w1 LEFT JOIN u b ON b.ngram = w2),
    k AS (SELECT phrase, CASE WHEN c > 0 AND ca > 0 AND cb > 0 THEN ln(c::DOUBLE * c / (ca::DOUBLE * cb)) END AS scp FROM j)
    SELECT phrase, CAST(2 AS BIGINT) AS n, round(scp, 6) AS scp, round(coalesce(0.5 * 2 / (1 + exp(-scp)), 0), 6) AS stickiness FROM k""")
def scp_stickiness(spark, sf):
    phrases = read(spark, sf, "benchmark").select(F.explode(A.ngrams(T.words(F.lower("text")), 2)).alias("phrase"))
    wiki = spark.createDataFrame([], "phrase string, prob double")
    asked = stored(phrases.select(F.explode(F.concat(F.array("phrase"), F.split("phrase", " "))).alias("ngram")).distinct(), "asked_ngrams")
    s = segments.segment_scores(phrases, stored(ngrams.ngram_counts(doc_tokens(spark, sf), (1, 2), asked=asked), "counts"), wiki)
    return s.select("phrase", "n", F.round("scp", 6).alias("scp"), F.round("stickiness", 6).alias("stickiness"))


# Text functions over whole tables.
SPACED = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query(rf"""WITH s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace({SPACED}, '([.?!])', ' \1 ', 'g'), '\s+', ' ', 'g'), chr(2)) AS x FROM documents),
    p AS (SELECT doc_id, string_split(regexp_replace(x[1], '\s[.?!]\s([^a-z])', chr(1) || '\1', 'g'), chr(1)) AS parts FROM s),
    e AS (SELECT doc_id, unnest(list_filter(list_zip(parts, range(1, len(parts) + 1)), lambda z: trim(z[1]) <> '' AND (z[2] < len(parts) OR ends_with(z[1], '.')))) AS z FROM p)
    SELECT doc_id, CASE WHEN ends_with(z[1], '.') THEN z[1] ELSE z[1] || ' .' END AS sentence FROM e""")
def sentence_split(spark, sf):
    spaced = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    marked = F.regexp_replace(F.regexp_replace(spaced, "([.?!])", " $1 "), r"\s+", " ")
    return read(spark, sf, "documents").select("doc_id", F.explode(T.sentences(marked)).alias("sentence"))


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


def _classes(column: str) -> str:
    out = column
    for name, pattern in T.NUMBER_CLASSES:
        out = f"regexp_replace({out}, '{_re2(pattern)}', '{name}', 'g')"
    return out


@query(f"SELECT item, {_classes('item')} AS classes FROM (SELECT DISTINCT unnest(string_split(url, '/')) AS item FROM pages) WHERE regexp_matches(item, '[0-9]')")
def number_classes(spark, sf):
    items = read(spark, sf, "pages").select(F.explode(F.split("url", "/")).alias("item")).distinct().where(F.col("item").rlike("[0-9]"))
    return items.select("item", T.number_classes(F.col("item")).alias("classes"))


@query(r"""SELECT w, regexp_replace(regexp_replace(w, '(.)([A-Z][a-z]+)', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g') AS split
    FROM (SELECT DISTINCT replace(p_name, ' ', '') || p_brand AS w FROM part)""")
def camel_split(spark, sf):
    w = read(spark, sf, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), "p_brand").alias("w")).distinct()
    return w.select("w", T.camel_split(F.col("w")).alias("split"))


_P, _PW = ("[" + "".join("\\" + c for c in p) + "]" for p in (T.PUNCTUATION, T.PUNCTUATION_WIKI))


def _tokenized(p: str, source: str) -> str:
    """SQL for the distinct words of `source(w)` and their tokens."""
    q, abbr = _re2(p), ", ".join(f"'{a}'" for a in T.ABBREVIATIONS)
    return f"""
    a AS (SELECT w, regexp_extract(w, '^{q}*') AS lead0 FROM {source}),
    b AS (SELECT w, CASE WHEN ends_with(lead0, '.') AND regexp_matches(substr(w, length(lead0) + 1, 1), '^[0-9]') THEN left(lead0, -1) ELSE lead0 END AS lead FROM a),
    c AS (SELECT w, lead, substr(w, length(lead) + 1) AS rest FROM b),
    d AS (SELECT *, regexp_matches(rest, '^([A-Z]\\.|\\.[0-9])') AS whole, regexp_extract(rest, '({q}*)$', 1) AS trail0 FROM c),
    f AS (SELECT *, CASE WHEN whole THEN '' ELSE trail0 END AS trail, CASE WHEN whole THEN rest ELSE left(rest, length(rest) - length(trail0)) END AS core FROM d),
    h AS (SELECT *, starts_with(trail, '.') AND lower(core) || '.' IN ({abbr}) AS dotted FROM f),
    tk AS (SELECT w, list_filter(list_concat(CASE WHEN lead = '' THEN [] ELSE string_split(lead, '') END, [CASE WHEN dotted THEN core || '.' ELSE core END], CASE WHEN dotted THEN (CASE WHEN length(trail) = 1 THEN [] ELSE string_split(substr(trail, 2), '') END) WHEN trail = '' THEN [] ELSE string_split(trail, '') END), lambda x: x <> '') AS tokens FROM h)"""


_RAW = r"raw AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS w FROM documents)"


@query(f"WITH {_RAW}, {_tokenized(_P, 'raw')} SELECT w, array_to_string(tokens, ' ') AS tokens FROM tk")
def tokenizer(spark, sf):
    w = read(spark, sf, "documents").select(F.explode(T.words(F.coalesce("text", F.lit("")))).alias("w")).distinct()
    return w.select("w", F.array_join(T.tokenize(F.col("w")), " ").alias("tokens"))


@query(f"WITH {_RAW}, {_tokenized(_PW, 'raw')} SELECT w, array_to_string(tokens, ' ') AS tokens FROM tk")
def wiki_tokenizer(spark, sf):
    w = read(spark, sf, "documents").select(F.explode(T.words(F.coalesce("text", F.lit("")))).alias("w")).distinct()
    return w.select("w", F.array_join(T.wiki_tokenize(F.col("w")), " ").alias("tokens"))


@query(r"""SELECT conv_id, turn, regexp_replace(trim(regexp_replace(text || '''s', '\s+', ' ', 'g')), '([^ ]*)''s( |$)', '\1 ''s\2', 'g') AS tokens FROM conversations WHERE text IS NOT NULL""")
def possessive_tokens(spark, sf):
    c = read(spark, sf, "conversations").where("text IS NOT NULL")
    return c.select("conv_id", "turn", F.array_join(T.possessive_tokens(T.words(F.concat("text", F.lit("'s")))), " ").alias("tokens"))


DET = ", ".join(f"'{w}'" for w in T.DETERMINERS)
CLOSING = ", ".join("'" + c.replace("'", "''") + "'" for c in T.CLOSING)


@query(rf"""WITH c AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') AS t FROM conversations)
    SELECT conv_id, turn, array_to_string(list_filter(t, lambda x, i: NOT (lower(x) IN ({DET})) OR coalesce(t[i + 1] IN ({CLOSING}), false)), ' ') AS tokens FROM c""")
def strip_determiners(spark, sf):
    c = read(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.array_join(T.strip_determiners(T.words(F.coalesce("text", F.lit("")))), " ").alias("tokens"))


# Links of the pages: targets are told apart by the page's language.
HREF = links.HREF
LINKS = rf"""li AS MATERIALIZED (SELECT page_id, lang || regexp_extract(tag, '{HREF}', 1) AS uri, regexp_extract(tag, '{HREF}', 2) AS mention
    FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)', 1) AS lang, unnest(regexp_extract_all(html, '{HREF}', 0)) AS tag FROM pages)),
    lk AS MATERIALIZED (SELECT page_id, upper(left(u, 1)) || substr(u, 2) AS uri, replace(mention, '_', ' ') AS mention FROM (SELECT page_id, mention, replace(uri, ' ', '_') AS u FROM li))"""
RED = r"red AS (SELECT DISTINCT uri AS alias, regexp_replace(uri, '[,.]$', '') AS canonical FROM lk WHERE regexp_matches(uri, '[,.]$')), ll AS MATERIALIZED (SELECT page_id, coalesce(canonical, uri) AS uri, mention FROM lk LEFT JOIN red ON alias = uri), an AS MATERIALIZED (SELECT mention, uri, count(*) AS cnt FROM ll GROUP BY ALL)"


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)", 1)
    return links.normalised(links.html_links(read(spark, sf, "pages")).select("page_id", F.concat(lang, "uri").alias("uri"), "mention"))


def redirects(found: DataFrame) -> DataFrame:
    return found.where(F.col("uri").rlike("[,.]$")).select(F.col("uri").alias("alias"), F.regexp_replace("uri", "[,.]$", "").alias("canonical")).distinct()


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    found = page_links(spark, sf)
    return links.redirected(found, redirects(found))


def anchor_table(spark: SparkSession, sf: str) -> DataFrame:
    return links.anchors(resolved(spark, sf))


@once
def held_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return anchor_table(spark, sf)


@query(f"WITH {LINKS} SELECT page_id, uri, mention FROM lk")
def link_mentions(spark, sf):
    return page_links(spark, sf)


@query(f"WITH {LINKS}, {RED} SELECT page_id, uri, mention FROM ll")
def redirected_links(spark, sf):
    return resolved(spark, sf)


@query(f"WITH {LINKS}, {RED} SELECT mention, uri, cnt FROM an")
def anchor_counts(spark, sf):
    return anchor_table(spark, sf)


@query(f"WITH {LINKS}, {RED} SELECT uri, string_agg(mention || ',' || cnt, ' ' ORDER BY cnt DESC, mention) AS packed FROM an GROUP BY uri")
def url_counts_packed(spark, sf):
    p = links.packed(anchor_table(spark, sf), "uri", "mention")
    return p.select("uri", A.pack(F.transform("values", lambda x: F.struct(x["mention"].alias("key"), x["cnt"].alias("value")))).alias("packed"))


@query(f"WITH {LINKS}, {RED} SELECT mention, count(DISTINCT uri) AS n_uris, CAST(sum(cnt) AS BIGINT) AS total FROM an GROUP BY mention")
def label_ambiguity(spark, sf):
    return labels.ambiguity(anchor_table(spark, sf))


@query(f"WITH {LINKS}, {RED} SELECT mention, min(uri) AS uri, CAST(sum(cnt) AS BIGINT) AS cnt FROM an GROUP BY mention HAVING count(*) = 1")
def single_uri_labels(spark, sf):
    return labels.single_uri_labels(anchor_table(spark, sf))


@query(f"WITH {LINKS}, {RED} SELECT mention, uri, cnt FROM (SELECT *, sum(cnt) OVER (PARTITION BY mention) AS t FROM an) WHERE cnt / t > 0.4 AND cnt > 1")
def percentile_labels(spark, sf):
    return labels.percentile_labels(anchor_table(spark, sf), 0.4)


@query(f"""WITH {LINKS}, {RED}, pu AS (SELECT uri, sum(cnt) AS c FROM an GROUP BY uri), f AS (SELECT mention AS phrase, CAST(sum(cnt) AS BIGINT) AS anchors, CAST(sum(c) AS BIGINT) AS mentions FROM an JOIN pu USING (uri) GROUP BY mention)
    SELECT phrase, anchors, mentions, round(anchors / (mentions + 10), 9) AS prob FROM f""")
def wiki_probabilities(spark, sf):
    a = anchor_table(spark, sf)
    return links.wiki_probabilities(a.select(F.col("mention").alias("phrase")), a).withColumn("prob", F.round("prob", 9))


def knowledge_base(a: DataFrame) -> DataFrame:
    """uri, types from specific to general, redirects: entities by language and first letter."""
    lang, letter = F.substring_index("uri", "/", 1), F.lower(F.substring(F.substring_index("uri", "/", -1), 1, 1))
    return a.select("uri").distinct().select("uri", F.array(F.concat_ws("_", F.lit("Letter"), lang, letter), F.concat_ws("_", F.lit("Lang"), lang)).alias("types"), F.array(F.concat("uri", F.lit("_(word)"))).alias("redirects"))


KB = """kb AS (SELECT uri, 'Letter_' || split_part(uri, '/', 1) || '_' || lower(left(split_part(uri, '/', -1), 1)) AS specific, 'Lang_' || split_part(uri, '/', 1) AS general FROM (SELECT DISTINCT uri FROM an))"""


@query(f"""WITH {LINKS}, {RED}, lab AS (SELECT uri, unnest(list_distinct(list_filter([trim(replace(split_part(split_part(uri, ',', 1), '(', 1), '_', ' ')), trim(replace(split_part(split_part(uri || '_(word)', ',', 1), '(', 1), '_', ' '))], lambda x: x <> ''))) AS label FROM (SELECT DISTINCT uri FROM an WHERE NOT contains(uri, '__'))),
    n AS (SELECT DISTINCT label, uri, coalesce(c, 1) AS named FROM lab LEFT JOIN (SELECT uri, CAST(sum(cnt) AS BIGINT) AS c FROM an GROUP BY uri) USING (uri))
    SELECT coalesce(n.label, an.mention) AS label, coalesce(n.uri, an.uri) AS uri, coalesce(named, cnt) AS cnt FROM n FULL OUTER JOIN an ON n.label = an.mention AND n.uri = an.uri""")
def candidate_labels(spark, sf):
    a = anchor_table(spark, sf)
    return links.candidate_labels(knowledge_base(a), a)


@query(f"""WITH {LINKS}, {RED}, p AS (SELECT page_id, uri, count(*) AS n FROM ll GROUP BY ALL)
    SELECT a.uri AS src, b.uri AS dst, CAST(sum(a.n * b.n) AS BIGINT) AS weight FROM p a JOIN p b ON a.page_id = b.page_id AND a.uri <> b.uri GROUP BY 1, 2""")
def link_cooccurrence(spark, sf):
    return links.cooccurrence(resolved(spark, sf), "page_id")


# Greedy linking of the benchmark and conversations by labels of one or two words.
SENT = r"sent AS MATERIALIZED (SELECT 'b' || item_id AS sent_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') AS tokens FROM benchmark UNION ALL SELECT 'c' || conv_id || '-' || turn, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') FROM conversations)"
LABELS = f"""{TOK}, {_counted(2, 'g2')}, lab AS MATERIALIZED (SELECT label, min(uri) AS uri FROM (SELECT mention AS label, uri FROM an WHERE mention <> '' UNION ALL SELECT ngram, replace(ngram, ' ', '_') FROM g2 WHERE cnt >= 5) GROUP BY label)"""
HITS = """sp AS MATERIALIZED (SELECT sent_id, i AS start, i + k AS stop, len(tokens) AS n, array_to_string(list_slice(tokens, i + 1, i + k), ' ') AS label, {more}
    FROM (SELECT sent_id, tokens, unnest(range(0, len(tokens))) AS i FROM sent), range(1, 21) r(k) WHERE i + k <= len(tokens) AND k <= 3 AND NOT (i = 0 AND k = 1)),
    hit AS MATERIALIZED (SELECT sent_id, start, max(stop) AS stop FROM sp JOIN lab USING (label) WHERE {ok} GROUP BY 1, 2),
    walk AS (SELECT sent_id, min(start) AS start FROM hit GROUP BY sent_id UNION ALL SELECT w.sent_id, (SELECT min(h2.start) FROM hit h2 WHERE h2.sent_id = w.sent_id AND h2.start >= h.stop) FROM walk w JOIN hit h ON h.sent_id = w.sent_id AND h.start = w.start WHERE w.start IS NOT NULL),
    gl AS MATERIALIZED (SELECT sent_id, hit.start, hit.stop, sp.label, lab.uri FROM walk JOIN hit USING (sent_id, start) JOIN sp USING (sent_id, start, stop) JOIN lab USING (label))"""
GREEDY = f"{LINKS}, {RED}, {SENT}, {LABELS}, {HITS.format(more='1 AS one', ok='true')}"
GUARDED = f"""{LINKS}, {RED}, {SENT}, {LABELS}, {HITS.format(more="(i + k + 1 < len(tokens) AND regexp_matches(tokens[i + k + 1], '^[[:upper:]]|^[À-ÖØ-Þ]')) OR (i > 0 AND regexp_matches(tokens[i], '^[[:upper:]]|^[À-ÖØ-Þ]')) AS titled", ok='NOT titled')}"""


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    w = T.words(F.coalesce("text", F.lit(""))).alias("tokens")
    b = read(spark, sf, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("sent_id"), w)
    return b.union(read(spark, sf, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn"), w))


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    a = held_anchors(spark, sf).where("mention <> ''").select(F.col("mention").alias("label"), "uri")
    g = counts(spark, sf, 2).where("cnt >= 5").select(F.col("ngram").alias("label"), F.replace("ngram", F.lit(" "), F.lit("_")).alias("uri"))
    return a.union(g).groupBy("label").agg(F.min("uri").alias("uri"))


@once
def greedy(spark: SparkSession, sf: str, **options) -> DataFrame:
    """The mention table that the linking queries use several times over."""
    return labels.greedy_links(sentences(spark, sf), checkpointed(dictionary(spark, sf)), **options)


@query(f"WITH RECURSIVE {GREEDY} SELECT sent_id, start, stop, label, uri FROM gl")
def greedy_spans(spark, sf):
    return greedy(spark, sf).select("sent_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "label", "uri")


@query(f"WITH RECURSIVE {GUARDED} SELECT sent_id, start, stop, label, uri FROM gl")
def greedy_spans_guarded(spark, sf):
    return greedy(spark, sf, guard_titles=True).select("sent_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "label", "uri")


@query(f"WITH RECURSIVE {GREEDY} SELECT label AS mention, uri, count(*) AS cnt FROM gl GROUP BY 1, 2")
def greedy_predicted_labels(spark, sf):
    return labels.predicted_counts(greedy(spark, sf))


RATIO = "j AS (SELECT p.mention, p.uri, p.cnt AS predicted, coalesce(an.cnt, 0) AS organic FROM (SELECT label AS mention, uri, count(*) AS cnt FROM gl GROUP BY 1, 2) p LEFT JOIN an USING (mention, uri))"


@query(f"WITH RECURSIVE {GREEDY}, {RATIO} SELECT mention, uri, predicted, organic FROM j WHERE organic > 1 AND predicted / organic < 20 AND NOT regexp_matches(mention, '^[^A-Za-z_]+$')")
def unambiguous_ratio_labels(spark, sf):
    return labels.ratio_labels(labels.predicted_counts(greedy(spark, sf)), held_anchors(spark, sf), 20.0)


@query(f"""WITH RECURSIVE {GREEDY}, {RATIO}, gold AS (SELECT mention, uri FROM (SELECT *, sum(cnt) OVER (PARTITION BY mention) AS t FROM an) WHERE cnt / t > 0.4 AND cnt > 1), lim(ratio) AS (VALUES {", ".join(f"({r})" for r in RATIOS)})
    SELECT CAST(ratio AS DOUBLE) AS ratio, count(*) AS n, count(gold.uri) AS tp, round(count(gold.uri) / count(*), 6) AS precision, round(count(gold.uri) / (SELECT count(*) FROM gold), 6) AS recall
    FROM lim JOIN j ON organic > 1 AND predicted / organic < ratio LEFT JOIN gold USING (mention, uri) GROUP BY ratio""")
def ratio_sweep(spark, sf):
    a = held_anchors(spark, sf)
    out = labels.sweep(labels.predicted_counts(greedy(spark, sf)), a, labels.percentile_labels(a, 0.4), RATIOS)
    return out.select("ratio", "n", F.col("tp").cast("long").alias("tp"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


LINKED = f"""lg AS (SELECT sent_id, list_filter(list_transform(tokens, lambda w, i: CASE WHEN list_contains(st, i - 1) THEN '<dbpedia:' || us[list_position(st, i - 1)] || '>'
        WHEN list_bool_or(list_transform(sp2, lambda s: s[1] <= i - 1 AND i - 1 < s[2])) THEN NULL ELSE lower(w) END), lambda x: x IS NOT NULL) AS tokens
    FROM (SELECT s.sent_id, tokens, coalesce(st, []) AS st, coalesce(us, []) AS us, coalesce(sp2, []) AS sp2 FROM sent s LEFT JOIN (SELECT sent_id, list(start ORDER BY start) AS st, list(uri ORDER BY start) AS us, list([start, stop] ORDER BY start) AS sp2 FROM gl GROUP BY sent_id) USING (sent_id))),
    tg AS MATERIALIZED (SELECT ngram, n, count(*) AS cnt FROM ({" UNION ALL ".join(f"SELECT {_grams(n)} AS ngram, {n} AS n FROM lg" for n in (1, 2, 3))}) GROUP BY ALL)"""


@query(f"WITH RECURSIVE {GREEDY}, {LINKED} SELECT ngram, CAST(n AS INT) AS n, cnt FROM tg")
def linked_ngrams(spark, sf):
    return typed.linked_ngrams(sentences(spark, sf), greedy(spark, sf))


TYPO = f"""{KB}, ty AS (SELECT uri, general AS type FROM kb), tp AS MATERIALIZED (SELECT array_to_string(list_transform(w, lambda x, j: CASE WHEN j = i THEN 'SUB' ELSE x END), ' ') AS pattern, type, CAST(sum(cnt) AS BIGINT) AS cnt
    FROM (SELECT string_split(ngram, ' ') AS w, cnt, unnest(range(1, n + 1)) AS i FROM tg WHERE cnt >= 2) JOIN ty ON w[i] = '<dbpedia:' || uri || '>' GROUP BY 1, 2)"""


def typograms_table(spark: SparkSession, sf: str, found: DataFrame | None = None) -> DataFrame:
    found = found if found is not None else greedy(spark, sf)
    kb = knowledge_base(held_anchors(spark, sf))
    return checkpointed(typed.typed_patterns(typed.linked_ngrams(sentences(spark, sf), found), typed.type_at(kb), 2))


@query(f"WITH RECURSIVE {GREEDY}, {LINKED}, {TYPO} SELECT pattern, type, cnt FROM tp")
def typograms(spark, sf):
    return typograms_table(spark, sf)


@query(f"WITH RECURSIVE {GREEDY}, {LINKED}, {TYPO} SELECT type, cnt, round(cnt / sum(cnt) OVER (), 9) AS prior FROM tp WHERE pattern = 'SUB'")
def type_priors(spark, sf):
    return typed.type_priors(typograms_table(spark, sf)).withColumn("prior", F.round("prior", 9))


CTX = f"""cx AS MATERIALIZED (SELECT sent_id || ':' || i AS context_id, list_transform(range(i - 2, i + 3), lambda k: CASE WHEN k = i THEN 'SUB' WHEN k < 1 OR k > len(tokens) THEN 'NONE' ELSE lower(tokens[k]) END) AS c FROM (SELECT sent_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM sent)),
    pr AS (SELECT context_id, slot, o, pattern FROM cx, LATERAL (VALUES ('last', 3, array_to_string(c[1:3], ' ')), ('last', 2, array_to_string(c[2:3], ' ')), ('first', 3, array_to_string(c[3:5], ' ')), ('middle', 3, array_to_string(c[2:4], ' ')), ('middle', 2, array_to_string(c[3:4], ' '))) v(slot, o, pattern)),
    fo AS (SELECT context_id, slot, o, type, cnt FROM pr JOIN tp USING (pattern)), us AS (SELECT * FROM fo QUALIFY o = max(o) OVER (PARTITION BY context_id, slot)),
    pp AS MATERIALIZED (SELECT context_id, slot, type, cnt / sum(cnt) OVER (PARTITION BY context_id, slot) AS prob FROM us)"""


@once
def contexts(spark: SparkSession, sf: str) -> DataFrame:
    """context_id, context: each token's two neighbours on either side, filled up with NONE, and SUB in its place."""
    pad = F.array_repeat(F.lit("NONE"), 2)
    s = sentences(spark, sf).where(F.size("tokens") > 0).select("sent_id", F.concat(pad, F.transform("tokens", F.lower), pad).alias("t"))
    each = F.transform(F.sequence(F.lit(1), F.size("t") - 4), lambda i: F.struct(i.alias("i"), F.concat(F.slice("t", i, 2), F.array(F.lit("SUB")), F.slice("t", i + 3, 2)).alias("context")))
    return s.select("sent_id", F.explode(each).alias("x")).select(F.concat_ws(":", "sent_id", "x.i").alias("context_id"), "x.context")


@query(f"WITH RECURSIVE {GREEDY}, {LINKED}, {TYPO}, {CTX} SELECT context_id, type, round(sum(prob) / max(k), 6) AS prob FROM pp JOIN (SELECT context_id, count(DISTINCT slot) AS k FROM pp GROUP BY 1) USING (context_id) GROUP BY 1, 2")
def predict_types(spark, sf):
    return typed.predicted_types(contexts(spark, sf), typograms_table(spark, sf)).select("context_id", "type", F.round("prob", 6).alias("prob"))


@query(f"""WITH RECURSIVE {GREEDY}, {LINKED}, {TYPO}, {CTX}, pri AS (SELECT type, cnt / sum(cnt) OVER () AS prior FROM tp WHERE pattern = 'SUB'),
    x AS (SELECT context_id, o, slot, pattern, fo2.type AS name, cnt AS count, cnt / sum(cnt) OVER (PARTITION BY context_id, o, slot) AS prob FROM (SELECT pr.*, tp.type, tp.cnt FROM pr JOIN tp USING (pattern)) fo2)
    SELECT context_id, CAST(o AS INT) AS "order", slot, pattern, name, count, round(prob, 6) AS prob, round(prob / prior, 6) AS pmi FROM x JOIN pri ON type = name""")
def type_features(spark, sf):
    f = typed.type_features(contexts(spark, sf), typograms_table(spark, sf)).where(F.size("features") > 0)
    return f.select("context_id", "order", "slot", "pattern", F.explode("features").alias("x")).select("context_id", "order", "slot", "pattern", "x.name", "x.count", F.round("x.prob", 6).alias("prob"), F.round("x.pmi", 6).alias("pmi"))


def type_tree(spark: SparkSession, sf: str) -> DataFrame:
    t = knowledge_base(held_anchors(spark, sf)).select(F.col("types")[0].alias("child"), F.col("types")[1].alias("parent")).distinct()
    return t.union(t.select(F.col("parent"), F.lit("Thing"))).distinct()


@query(f"""WITH RECURSIVE {LINKS}, {RED}, {KB}, e AS (SELECT DISTINCT specific AS child, general AS parent FROM kb UNION SELECT DISTINCT general, 'Thing' FROM kb),
    d(type, depth) AS (SELECT 'Thing', 0 UNION ALL SELECT child, depth + 1 FROM e JOIN d ON parent = type) SELECT type, CAST(max(depth) AS INT) AS depth FROM d GROUP BY type""")
def ontology_depth(spark, sf):
    return typed.depths(type_tree(spark, sf), "Thing")


@query(f"""WITH {LINKS}, {RED}, {KB} SELECT DISTINCT specific AS type, general AS below FROM kb UNION SELECT DISTINCT general, general FROM kb UNION SELECT 'Thing', NULL""")
def ontology_parent(spark, sf):
    tree = type_tree(spark, sf)
    kinds = tree.select(F.col("child").alias("type")).union(tree.select("parent"))
    return typed.parent_below(kinds, tree, "Thing")


@query(f"WITH RECURSIVE {GREEDY}, {LINKED}, {TYPO}, {CTX} SELECT context_id, CAST(0 AS INT) AS level, type, round(sum(prob), 6) AS prob FROM pp GROUP BY context_id, type")
def predict_types_full(spark, sf):
    out = typed.hierarchical_types(contexts(spark, sf), typograms_table(spark, sf), checkpointed(type_tree(spark, sf)), "Thing")
    return out.withColumn("prob", F.round("prob", 6))


# Entity linking: the benchmark's and conversations' greedy spans as mentions.
MENT = "me AS MATERIALIZED (SELECT sent_id AS doc_id, start AS mention_id, label AS mention FROM gl), ca AS MATERIALIZED (SELECT doc_id, mention_id, me.mention, an.uri, an.cnt FROM me JOIN an USING (mention))"
PRUNE = "pc AS MATERIALIZED (SELECT doc_id, mention_id, mention, uri, cnt FROM (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY doc_id, mention_id ORDER BY cnt DESC, uri ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(cnt) OVER (PARTITION BY doc_id, mention_id) AS b FROM ca) WHERE b <= 0.9)"
PRIOR = "pl AS MATERIALIZED (SELECT doc_id, mention_id, min(uri) AS uri FROM (SELECT *, max(cnt) OVER (PARTITION BY doc_id, mention_id) AS m FROM pc) WHERE cnt = m GROUP BY 1, 2)"


def mentions(spark: SparkSession, sf: str, found: DataFrame | None = None) -> DataFrame:
    found = found if found is not None else greedy(spark, sf)
    return found.select(F.col("sent_id").alias("doc_id"), F.col("start").cast("long").alias("mention_id"), F.col("label").alias("mention"), F.when(F.col("label").rlike("^[A-Z]"), F.lit("<dbpedia:Person>")).alias("ner_type"))


def found_candidates(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    a = held_anchors(spark, sf).select(F.col("mention").alias("matched"), "uri", "cnt")
    m = of if of is not None else mentions(spark, sf)
    return m.withColumn("matched", F.col("mention")).join(a, "matched").select("doc_id", "mention_id", "mention", "uri", "cnt")


@query(f"WITH RECURSIVE {GREEDY}, {MENT}, {PRUNE} SELECT doc_id, mention_id, uri, cnt FROM pc")
def candidate_prune_90(spark, sf):
    return linking.pruned(found_candidates(spark, sf)).select("doc_id", "mention_id", "uri", "cnt")


@query(f"WITH RECURSIVE {GREEDY}, {MENT}, {PRUNE}, {PRIOR} SELECT doc_id, mention_id, uri FROM pl")
def prior_link(spark, sf):
    return linking.prior_links(linking.pruned(found_candidates(spark, sf)))


NAMES = """lb AS (SELECT uri, unnest(list_distinct(list_filter([trim(replace(split_part(split_part(uri, ',', 1), '(', 1), '_', ' ')), trim(replace(split_part(split_part(uri || '_(word)', ',', 1), '(', 1), '_', ' '))], lambda x: x <> ''))) AS label FROM (SELECT DISTINCT uri FROM an WHERE NOT contains(uri, '__') AND NOT starts_with(uri, 'Template:') AND NOT starts_with(uri, 'List_of:'))),
    nm AS MATERIALIZED (SELECT label, uri, coalesce(c, 1) AS named FROM lb LEFT JOIN (SELECT uri, CAST(sum(cnt) AS BIGINT) AS c FROM an GROUP BY uri) USING (uri)),
    l1 AS MATERIALIZED (SELECT coalesce(n.label, an.mention) AS label, coalesce(n.uri, an.uri) AS uri, coalesce(named, cnt) AS cnt FROM (SELECT DISTINCT * FROM nm) n FULL OUTER JOIN an ON n.label = an.mention AND n.uri = an.uri),
    l2 AS MATERIALIZED (SELECT coalesce(n.label, an.mention) AS label, coalesce(n.uri, an.uri) AS uri, coalesce(named, cnt) AS cnt FROM (SELECT DISTINCT replace(lower(label), ' ', '') AS label, uri, named FROM nm) n FULL OUTER JOIN an ON n.label = an.mention AND n.uri = an.uri)"""
CAPITALS = "array_to_string(list_transform(range(1, length(m) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(substr(m, i - 1, 1), '[A-Za-z]') OR NOT regexp_matches(substr(m, i, 1), '[A-Za-z]') THEN upper(substr(m, i, 1)) ELSE lower(substr(m, i, 1)) END), '')"


@query(f"""WITH RECURSIVE {GREEDY}, {NAMES}, q AS (SELECT sent_id AS doc_id, start AS mention_id, lower(label) AS m FROM gl),
    f AS (SELECT doc_id, mention_id, m, 0 AS form, m AS matched FROM q UNION ALL SELECT doc_id, mention_id, m, 1, {CAPITALS} FROM q),
    t AS (SELECT f.*, uri, cnt FROM f JOIN l1 ON label = matched UNION ALL SELECT doc_id, mention_id, m, 3, replace(m, ' ', ''), uri, cnt FROM q JOIN l2 ON label = replace(m, ' ', ''))
    SELECT doc_id, mention_id, m AS mention, matched, uri, cnt FROM t QUALIFY form = min(form) OVER (PARTITION BY doc_id, mention_id)""")
def candidate_chain(spark, sf):
    a = held_anchors(spark, sf)
    kb = knowledge_base(a)
    m = mentions(spark, sf).withColumn("mention", F.lower("mention"))
    return linking.candidates(m, links.candidate_labels(kb, a), links.candidate_labels(kb, a, lower=True, spaces=False)).select("doc_id", "mention_id", "mention", "matched", "uri", "cnt")


CXM = "mt AS (SELECT split_part(context_id, ':', 1) AS doc_id, CAST(split_part(context_id, ':', 2) AS BIGINT) - 1 AS mention_id, type, max(prob) AS prob FROM pp GROUP BY 1, 2, 3)"


@query(f"""WITH RECURSIVE {GREEDY}, {LINKED}, {TYPO}, {CTX}, {MENT}, {PRUNE}, {PRIOR}, {CXM},
    r AS (SELECT pc.*, row_number() OVER (PARTITION BY pc.doc_id, pc.mention_id ORDER BY cnt DESC, uri) AS k, count(*) OVER (PARTITION BY pc.doc_id, pc.mention_id) AS n, coalesce(prob, 0) AS p FROM pc JOIN kb USING (uri) LEFT JOIN mt ON mt.doc_id = pc.doc_id AND mt.mention_id = pc.mention_id AND mt.type = kb.general),
    f AS (SELECT doc_id, mention_id, arg_min(uri, k) AS uri FROM r WHERE n > 1 AND p > 0.9 GROUP BY 1, 2)
    SELECT pl.doc_id, pl.mention_id, coalesce(f.uri, pl.uri) AS uri FROM pl LEFT JOIN f USING (doc_id, mention_id)""")
def typed_link(spark, sf):
    g = greedy(spark, sf)
    probs = typed.pattern_probabilities(contexts(spark, sf), typograms_table(spark, sf, g))
    at = F.split("context_id", ":")
    kinds = probs.select(at[0].alias("doc_id"), (at[1].cast("long") - 1).alias("mention_id"), "type", "prob")
    found = checkpointed(linking.pruned(found_candidates(spark, sf, mentions(spark, sf, g))))
    return linking.typed_links(found, typed.type_at(knowledge_base(held_anchors(spark, sf))), kinds)


@query(f"WITH RECURSIVE {GREEDY}, {MENT}, s AS (SELECT DISTINCT doc_id, mention FROM me) SELECT a.doc_id, a.mention, b.mention AS within FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.mention <> b.mention AND contains(b.mention, a.mention)")
def subsumption_pairs(spark, sf):
    return linking.containing(mentions(spark, sf))


@query(f"""WITH RECURSIVE {GREEDY}, {MENT}, {PRUNE}, bt AS (SELECT DISTINCT doc_id, mention AS within, uri, cnt FROM pc), s AS (SELECT DISTINCT doc_id, mention FROM me),
    sup AS (SELECT a.doc_id, a.mention, b.mention AS within, regexp_matches(b.mention, '^[A-Z]') AS person FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.mention <> b.mention AND contains(b.mention, a.mention) WHERE (b.doc_id, b.mention) IN (SELECT doc_id, within FROM bt)),
    per AS (SELECT doc_id, mention, min(within) AS within FROM sup WHERE person GROUP BY 1, 2),
    fp AS (SELECT me.doc_id, mention_id, me.mention, uri, cnt FROM me JOIN per ON per.doc_id = me.doc_id AND per.mention = me.mention JOIN bt ON bt.doc_id = per.doc_id AND bt.within = per.within),
    oth AS (SELECT me.doc_id, mention_id, me.mention, within FROM me JOIN sup ON sup.doc_id = me.doc_id AND sup.mention = me.mention WHERE (me.doc_id, me.mention) NOT IN (SELECT doc_id, mention FROM per)),
    abv AS (SELECT oth.doc_id, mention_id, mention, uri, cnt FROM oth JOIN bt ON bt.doc_id = oth.doc_id AND bt.within = oth.within),
    com AS (SELECT * FROM abv WHERE (doc_id, mention_id, uri) IN (SELECT doc_id, mention_id, uri FROM pc)),
    rst AS (SELECT * FROM abv WHERE (doc_id, mention_id) NOT IN (SELECT doc_id, mention_id FROM com)), {PRIOR},
    own AS (SELECT pc.* FROM pc JOIN pl USING (doc_id, mention_id, uri) WHERE (doc_id, mention_id) IN (SELECT doc_id, mention_id FROM oth)),
    alo AS (SELECT * FROM pc WHERE (doc_id, mention) NOT IN (SELECT doc_id, mention FROM sup))
    SELECT doc_id, mention_id, uri FROM (SELECT * FROM fp UNION ALL SELECT * FROM com UNION ALL SELECT * FROM rst UNION ALL SELECT * FROM own UNION ALL SELECT * FROM alo) GROUP BY ALL""")
def subsumption(spark, sf):
    m = mentions(spark, sf)
    return linking.subsumed(m, checkpointed(linking.pruned(found_candidates(spark, sf, m)))).select("doc_id", "mention_id", "uri")


@query()
def closeness_pruning(spark, sf):
    return linking.closest(linking.pruned(found_candidates(spark, sf)), links.cooccurrence(resolved(spark, sf), "page_id"))


TRUTH = "tr AS (SELECT doc_id, mention_id, CASE WHEN mention_id % 7 = 0 THEN NULL ELSE first_uri END AS true_uri, mention_id % 5 <> 0 AS exists_ FROM (SELECT doc_id, mention_id, min(uri) AS first_uri FROM ca GROUP BY 1, 2))"


def truth(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    t = found_candidates(spark, sf, of).groupBy("doc_id", "mention_id").agg(F.min("uri").alias("uri"))
    return t.select("doc_id", "mention_id", F.when(F.col("mention_id") % 7 != 0, F.col("uri")).alias("uri"), (F.col("mention_id") % 5 != 0).alias("exists"))


@query(f"""WITH RECURSIVE {GREEDY}, {MENT}, {PRUNE}, {PRIOR}, {TRUTH},
    c AS (SELECT count(*) FILTER (uri = true_uri) AS tp, count(*) FILTER (uri IS NOT NULL AND uri IS DISTINCT FROM true_uri) AS fp, count(*) FILTER (uri IS NULL AND true_uri IS NOT NULL AND exists_) AS fn, count(*) FILTER (uri IS NULL AND true_uri IS NULL) AS tn
          FROM tr LEFT JOIN (SELECT * FROM pl WHERE (doc_id, mention_id) IN (SELECT doc_id, mention_id FROM pc WHERE cnt > 1)) pl USING (doc_id, mention_id))
    SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c""")
def link_metrics(spark, sf):
    of = mentions(spark, sf)
    predicted = linking.prior_links(linking.pruned(found_candidates(spark, sf, of)).where("cnt > 1"))  # a linker that leaves what was seen once
    m = evaluate.link_metrics(evaluate.judged(truth(spark, sf, of), predicted, linking.MENTION))
    return m.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH RECURSIVE {GREEDY}, {LINKED}, {TYPO}, {CTX}, {MENT}, {PRUNE}, {TRUTH}, {CXM},
    ro AS (SELECT pc.*, count(*) OVER m AS cand_num, cnt / (sum(cnt) OVER m + 1) AS prior_prob, row_number() OVER (PARTITION BY doc_id, mention_id ORDER BY cnt DESC, uri) - 1 AS graph_score FROM pc WINDOW m AS (PARTITION BY doc_id, mention_id)),
    jo AS (SELECT ro.*, coalesce(mt.prob, 0) AS type_prob, mt.prob IS NOT NULL AS predictable, tr.true_uri, kb.general, tk.general AS true_general, tk.specific AS true_specific FROM ro JOIN kb USING (uri) LEFT JOIN mt ON mt.doc_id = ro.doc_id AND mt.mention_id = ro.mention_id AND mt.type = kb.general
        LEFT JOIN tr ON tr.doc_id = ro.doc_id AND tr.mention_id = ro.mention_id LEFT JOIN kb tk ON tk.uri = tr.true_uri),
    mg AS (SELECT doc_id, mention, uri, max(type_prob) AS type_prob, count(*) AS number_merged, arg_min(cand_num, mention_id) AS cand_num, arg_min(graph_score, mention_id) AS graph_score,
        arg_min(coalesce(general IN (true_general, true_specific), false)::INT, mention_id) AS true_type_match, arg_min(predictable::INT, mention_id) AS type_predictable, arg_min(prior_prob, mention_id) AS prior_prob, arg_min(coalesce(uri = true_uri, false)::INT, mention_id) AS label FROM jo GROUP BY 1, 2, 3)
    SELECT doc_id, mention, uri, round(type_prob, 9) AS type_prob, number_merged, cand_num, graph_score, 1 AS type_exists, 0 AS ner_type_match, true_type_match, type_predictable, round(prior_prob, 9) AS prior_prob, label,
        CASE WHEN type_prob = 1 THEN 0 ELSE row_number() OVER (PARTITION BY doc_id, mention ORDER BY type_prob DESC, uri) - 1 END AS type_prob_rank, row_number() OVER (PARTITION BY doc_id, mention ORDER BY prior_prob DESC, uri) - 1 AS prior_prob_rank FROM mg""")
def candidate_features(spark, sf):
    g = greedy(spark, sf)
    m = mentions(spark, sf, g)
    found = checkpointed(linking.pruned(found_candidates(spark, sf, m)))
    graph = found.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "mention_id").orderBy(F.desc("cnt"), "uri")) - 1)
    at = F.split("context_id", ":")
    probs = typed.pattern_probabilities(contexts(spark, sf), typograms_table(spark, sf, g)).select(at[0].alias("doc_id"), (at[1].cast("long") - 1).alias("mention_id"), "type", "prob")
    f = features.candidate_features(found, graph, knowledge_base(held_anchors(spark, sf)), probs, truth(spark, sf, m).withColumnRenamed("uri", "true_uri"), m)
    out = features.merged_features(f)
    return out.withColumns({c: F.round(c, 9) for c in ("type_prob", "prior_prob")} | {c: F.col(c).cast("long") for c in ("graph_score", "type_prob_rank", "prior_prob_rank")})


# Graphs: parts that share an order, and the pages' co-occurrence graph.
EDGES = "e AS MATERIALIZED (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey)"


def supplier_edges(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    a, b = li.select("l_orderkey", F.col("l_suppkey").alias("src")), li.select("l_orderkey", F.col("l_suppkey").alias("dst"))
    return a.join(b, "l_orderkey").where("src < dst").select("src", "dst").distinct()


@query(f"WITH {EDGES} SELECT e.src, e.dst, count(*) AS weight FROM e JOIN e x ON x.src = e.src JOIN e y ON y.src = e.dst AND y.dst = x.dst GROUP BY 1, 2")
def common_neighbor_edges(spark, sf):
    return graphs.common_neighbours(supplier_edges(spark, sf))


def walk_input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = checkpointed(graphs.top_candidates(linking.pruned(found_candidates(spark, sf))).select("doc_id", "mention_id", "mention", "uri", "cnt"))
    near = links.cooccurrence(resolved(spark, sf), "page_id")
    return found, near, graphs.document_edges(found, near)


@query()
def semantic_walk(spark, sf):
    found, _, edges = walk_input(spark, sf)
    return graphs.semantic_links(found, edges)


@query()
def mention_walk(spark, sf):
    found, _, _ = walk_input(spark, sf)
    nodes = links.mention_nodes(resolved(spark, sf))
    return graphs.mention_links(found, links.cooccurrence(nodes, "page_id", "node"))


@query()
def densest_linking(spark, sf):
    found, near, _ = walk_input(spark, sf)
    return graphs.densest_links(found, graphs.candidate_edges(found, near))


_STEP = "{b} AS MATERIALIZED (SELECT src, node, sum(m) AS m FROM (SELECT {a}.src, p.dst AS node, {a}.m * p.p * 0.85 AS m FROM {a} JOIN p ON p.src = {a}.node UNION ALL SELECT src, node, 0.15 FROM s0) GROUP BY ALL HAVING sum(m) >= 0.001)"


@query(f"""WITH {EDGES}, p AS MATERIALIZED (SELECT src, dst, 1 / count(*) OVER (PARTITION BY src) AS p FROM e), s0 AS MATERIALIZED (SELECT DISTINCT src, src AS node, 1.0::DOUBLE AS m FROM e),
    {_STEP.format(a='s0', b='s1')}, {_STEP.format(a='s1', b='s2')}, {_STEP.format(a='s2', b='s3')} SELECT src, node, round(m, 9) AS p FROM s3""")
def semantic_signatures(spark, sf):
    e = supplier_edges(spark, sf).withColumn("weight", F.lit(1))
    return graphs.signatures(e, e.select(F.col("src").alias("uri")).distinct(), steps=3, least=1e-3).withColumn("p", F.round("p", 9))


# Tweets: the first words of events' types and users as segments, and short benchmark phrases.
@query(rf"""WITH RECURSIVE {ALLG}, {LINKS}, {RED}, pu AS (SELECT uri, sum(cnt) AS c FROM an GROUP BY uri), wk AS MATERIALIZED (SELECT mention AS phrase, sum(cnt) / (sum(c) + 10) AS prob FROM an JOIN pu USING (uri) GROUP BY mention),
    cl AS (SELECT item_id * 1000 + generate_subscripts(x, 1) - 1 AS tweet_id, unnest(x) AS text FROM (SELECT item_id, regexp_split_to_array(text, '[.,]\s*') AS x FROM benchmark)),
    tw AS MATERIALIZED (SELECT DISTINCT tweet_id, w, CAST(len(w) AS BIGINT) AS n FROM (SELECT tweet_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda v: v <> '') AS w FROM cl) WHERE len(w) > 0),
    sp AS MATERIALIZED (SELECT tweet_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS segment FROM (SELECT tweet_id, w, n, unnest(range(1, n + 1)) AS i FROM tw), range(1, 6) r(k) WHERE k <= n - i + 1),
    ph AS MATERIALIZED (SELECT phrase, string_split(phrase, ' ') AS w, CAST(len(string_split(phrase, ' ')) AS BIGINT) AS n FROM (SELECT DISTINCT segment AS phrase FROM sp)),
    ct AS (SELECT phrase, array_to_string(list_slice(w, 1, k), ' ') AS a, array_to_string(list_slice(w, k + 1, n), ' ') AS b FROM (SELECT *, unnest(range(1, n)) AS k FROM ph)),
    pr AS MATERIALIZED (SELECT phrase, avg(coalesce(x.cnt, 0)::DOUBLE * coalesce(y.cnt, 0)) AS mean FROM ct LEFT JOIN allg x ON x.ngram = a LEFT JOIN allg y ON y.ngram = b GROUP BY phrase),
    sc AS (SELECT phrase, ph.n, coalesce(prob, 0) AS prob, CASE WHEN ph.n = 1 AND g.cnt > 0 THEN 2 * ln(g.cnt / 369177688671.0::DOUBLE) WHEN ph.n > 1 AND g.cnt > 0 AND mean > 0 THEN ln(g.cnt::DOUBLE * g.cnt / mean) END AS scp FROM ph LEFT JOIN allg g ON g.ngram = phrase LEFT JOIN pr USING (phrase) LEFT JOIN wk USING (phrase)),
    st AS MATERIALIZED (SELECT phrase, CAST(round(coalesce(CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE (n - 1) / n END * exp(prob) * (2 / (1 + exp(-scp))), 0) * 1e12::DOUBLE) AS BIGINT) AS units FROM sc),
    su AS MATERIALIZED (SELECT tweet_id, i, k, segment, units FROM sp JOIN st ON phrase = segment),
    ways AS (SELECT tweet_id, n, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS parts, CAST(0 AS BIGINT) AS units FROM tw WHERE n <= 10
        UNION ALL SELECT y.tweet_id, n, pos + k, list_append(parts, segment), y.units + su.units FROM ways y JOIN su ON su.tweet_id = y.tweet_id AND i = pos + 1 WHERE (k < 5 OR pos + k = n) AND (k < n OR n = 1)),
    mp AS MATERIALIZED (SELECT tweet_id, map(list(segment), list(units)) AS m FROM (SELECT DISTINCT tweet_id, segment, units FROM su) GROUP BY tweet_id),
    best AS (SELECT tweet_id, w, n, m, CAST(1 AS BIGINT) AS e, [{{'u': CAST(0 AS BIGINT), 'j': '', 'p': CAST([] AS VARCHAR[])}}] AS b FROM tw JOIN mp USING (tweet_id) WHERE n > 10
        UNION ALL SELECT tweet_id, w, n, m, e + 1, list_append(b, list_sort(list_transform(list_transform(range(1, least(e, CASE WHEN e = n THEN 5 ELSE 4 END) + 1), lambda k: {{'k': k, 's': array_to_string(list_slice(w, e - k + 1, e), ' ')}}),
            lambda x: {{'u': b[e - x.k + 1].u - map_extract(m, x.s)[1], 'j': b[e - x.k + 1].j || '/' || x.s, 'p': list_append(b[e - x.k + 1].p, x.s)}}))[1]) FROM best WHERE e <= n)
    SELECT tweet_id, parts AS segments, round(units / 1e12::DOUBLE, 6) AS score, row_number() OVER (PARTITION BY tweet_id ORDER BY units DESC, array_to_string(parts, '/')) - 1 AS rank FROM ways WHERE pos = n
    UNION ALL SELECT tweet_id, b[n + 1].p, round(-b[n + 1].u / 1e12::DOUBLE, 6), 0 FROM best WHERE e = n + 1""")
def segment_ranking(spark, sf):
    tweets = read(spark, sf, "benchmark").select(F.col("item_id").alias("tweet_id"), F.posexplode(F.split("text", r"[.,]\s*")).alias("k", "text")).select((F.col("tweet_id") * 1000 + F.col("k")).alias("tweet_id"), "text")
    asked = tweets.select(T.words(F.lower("text")).alias("w")).select(F.explode(F.concat(*[A.ngrams(F.col("w"), n) for n in (1, 2, 3)])).alias("ngram"))
    wiki = links.wiki_probabilities(held_anchors(spark, sf).select(F.col("mention").alias("phrase")), held_anchors(spark, sf))
    asked = stored(asked.distinct(), "asked_ngrams")  # joined by its size
    found = stored(ngrams.ngram_counts(doc_tokens(spark, sf), (1, 2, 3), asked=asked), "counts")
    return segments.ranked_segmentations(tweets, found, wiki).withColumn("score", F.round("score", 6))


SEG = r"""sc AS (SELECT item_id, list_filter(string_split(x, ' '), lambda w: w <> '') AS w FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[.,\n]\s*')) AS x FROM benchmark)),
    sg AS MATERIALIZED (SELECT DISTINCT item_id AS tweet_id, unnest(list_transform(range(1, len(w) + 1, 2), lambda i: array_to_string(list_slice(w, i, i + 1), ' '))) AS segment FROM sc)"""


def segmented(spark: SparkSession, sf: str) -> DataFrame:
    """tweet_id, segments: the benchmark's clauses in segments of two words, the last of a clause perhaps of one."""
    clauses = F.transform(F.split(F.lower("text"), r"[.,\n]\s*"), lambda x: F.filter(F.split(x, " "), lambda w: w != ""))
    cut = lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(2)), lambda i: F.array_join(F.slice(w, i, 2), " "))).otherwise(F.array().cast("array<string>"))
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("tweet_id"), F.flatten(F.transform(clauses, cut)).alias("segments"))


@query(f"WITH {SEG}, z AS (SELECT segment, count(*) AS n FROM sg GROUP BY 1), b AS (SELECT a.segment AS a, b.segment AS b, count(*) AS i FROM sg a JOIN sg b USING (tweet_id) WHERE a.segment <> b.segment GROUP BY 1, 2) SELECT b.a, b.b, round(i / (x.n + y.n - i), 9) AS weight FROM b JOIN z x ON x.segment = b.a JOIN z y ON y.segment = b.b")
def segment_jaccard(spark, sf):
    return segments.segment_jaccard(segments.segment_tweets(segmented(spark, sf))).withColumn("weight", F.round("weight", 9))


@query()
def segment_walk(spark, sf):
    blocks = segmented(spark, sf).withColumn("block", F.col("tweet_id") % 4)
    return segments.segment_walk(blocks, spark.createDataFrame([], "phrase string, prob double"))


# Edits: consecutive versions of conversations' turns.
@query("SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def revision_lag(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", "turn", "text")
    return edits.previous_versions(c, ["conv_id"], ["turn"])


def word_edits(spark: SparkSession, sf: str, substitutions: list[str] | None = None) -> DataFrame:
    c = read(spark, sf, "conversations").select("conv_id", "turn", "role", F.regexp_replace("text", r"\s+", " ").alias("text"))
    p = edits.version_pairs(c, ["conv_id", "role"], ["turn"])
    return edits.edits(p.withColumn("edit_id", F.concat_ws("-", "conv_id", "turn")), substitutions)


@query()
def sequence_diff(spark, sf):
    return word_edits(spark, sf).select("edit_id", "i1", "i2", "j1", "j2", "edit1", "edit2", "is_error")


@query()
def substitution_edits(spark, sf):
    return edits.confusion(word_edits(spark, sf, PREPOSITIONS))


_CONF = r"""WITH p AS (SELECT conv_id, role, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') AS b, lag(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '')) OVER (PARTITION BY conv_id, role ORDER BY turn) AS a FROM conversations)
    SELECT a[i] AS edit1, b[i] AS edit2, count(*) AS cnt FROM (SELECT a, b, unnest(range(1, least(len(a), len(b)) + 1)) AS i FROM p WHERE a IS NOT NULL) GROUP BY 1, 2"""


@query(_CONF)
def positional_confusion(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", "role", "turn", T.words(F.lower(F.coalesce("text", F.lit("")))).alias("b"))
    p = c.withColumn("a", F.lag("b").over(Window.partitionBy("conv_id", "role").orderBy("turn"))).where("a IS NOT NULL")
    z = p.select(F.explode(F.slice(F.arrays_zip("a", "b"), F.lit(1), F.least(F.size("a"), F.size("b")))).alias("z"))
    return edits.confusion(z.select(F.col("z.a").alias("edit1"), F.col("z.b").alias("edit2")))


_EC = rf"""WITH t AS (SELECT conv_id || '-' || turn AS edit_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') AS t FROM conversations),
    r AS (SELECT edit_id, t, unnest(range(1, len(t) + 1)) AS i FROM t)
    SELECT edit_id, i - 1 AS place, array_to_string(list_transform(range(i - 3, i + 4), lambda k: CASE WHEN k < 1 OR k > len(t) THEN '' WHEN t[k] = '.' THEN ',' WHEN k = i THEN {_classes("lower(t[k])")} ELSE {_classes("lower(t[k])")} END), '|') AS context FROM r WHERE t[i] IN ({SUBS})"""


@query(_EC)
def edit_context(spark, sf):
    c = read(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("edit_id"), T.words(F.coalesce("text", F.lit(""))).alias("tokens2"))
    rows = edits.words_where(c, lambda t: t.isin(PREPOSITIONS))
    return edits.edit_context(rows).select("edit_id", F.col("i1").cast("long").alias("place"), F.array_join("context", "|").alias("context"))


@query(rf"""WITH t AS (SELECT conv_id || '-' || turn AS edit_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') AS t FROM conversations),
    r AS (SELECT edit_id, t, unnest(range(1, len(t) + 1)) AS i FROM t), c AS (SELECT edit_id, i, list_transform(t, lambda x: CASE WHEN x = '.' THEN ',' ELSE {_classes("lower(x)")} END) AS t FROM r WHERE t[i] IN ({SUBS}))
    SELECT edit_id, CAST(i - 1 AS INT) AS i1, n, array_to_string(list_slice(t, i - n + 1 + k, i + k), ' ') AS ngram, n - 1 - k AS edit_pos FROM c, (VALUES (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)) v(n, k) WHERE i - n + 1 + k >= 1 AND i + k <= len(t)""")
def edit_ngrams(spark, sf):
    c = read(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("edit_id"), T.words(F.coalesce("text", F.lit(""))).alias("tokens2"))
    return edits.context_ngrams(edits.words_where(c, lambda t: t.isin(PREPOSITIONS))).select("edit_id", "i1", "n", "ngram", "edit_pos")


@query()
def edit_features(spark, sf):
    c = read(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("edit_id"), T.words(F.coalesce("text", F.lit(""))).alias("tokens2"))
    rows = edits.words_where(c, lambda t: t.isin(PREPOSITIONS)).withColumn("edit_id", F.concat_ws(":", "edit_id", "i1"))
    grams = edits.context_ngrams(rows).withColumn("context", F.array_join(A.replaced_at(F.split("ngram", " "), F.col("edit_pos")), " "))
    asked = stored(grams.select("context").distinct(), "asked_contexts")
    found = patterns(spark, sf, asked=asked.select(F.col("context").alias("pattern")).union(spark.createDataFrame([(A.SLOT,)], "pattern string")), sizes=(1, 2, 3))
    scored = ngrams.local_association(stored(found, "patterns"), asked, unigrams=stored(counts(spark, sf, 1), "unigrams"))
    joined = grams.join(scored.select("context", "substitution", "score", "rank", "norm_position"), "context").select("edit_id", "edit1", "edit2", "n", "norm_position", "context", "substitution", "rank", "score")
    return edits.position_features(joined, vocabulary(spark), edits.confusion(rows))


@query("SELECT toxic, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good FROM labels GROUP BY toxic")
def class_balance(spark, sf):
    return read(spark, sf, "labels").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"))


@query("SELECT toxic = 1 AS is_error, CAST(CASE WHEN toxic = 1 THEN count(*) ELSE floor(count(*) * 0.25) END AS BIGINT) AS n FROM labels GROUP BY toxic")
def balanced_sample(spark, sf):
    rows = read(spark, sf, "labels").select(F.col("doc_id").alias("edit_id"), F.lit(0).alias("i1"), F.lit(0).alias("j1"), (F.col("toxic") == 1).alias("is_error"))
    return edits.balanced(rows, share0=0.25).groupBy("is_error").agg(F.count(F.lit(1)).alias("n"))


# Coreference: conversations as documents, roles as gold and lengths as system clusters.
@query("""WITH m AS (SELECT conv_id AS doc_id, role AS gold, length(text) % 3 AS cluster FROM conversations), p AS (SELECT doc_id, count(*) * (count(*) - 1) / 2 AS k FROM m GROUP BY doc_id),
    g AS (SELECT doc_id, sum(n * (n - 1) / 2) AS k FROM (SELECT doc_id, gold, count(*) AS n FROM m GROUP BY ALL) GROUP BY 1), s AS (SELECT doc_id, sum(n * (n - 1) / 2) AS k FROM (SELECT doc_id, cluster, count(*) AS n FROM m GROUP BY ALL) GROUP BY 1),
    b AS (SELECT doc_id, sum(n * (n - 1) / 2) AS k FROM (SELECT doc_id, gold, cluster, count(*) AS n FROM m GROUP BY ALL) GROUP BY 1)
    SELECT doc_id, CAST(b.k AS BIGINT) AS tp, CAST(g.k - b.k AS BIGINT) AS fn, CAST(s.k - b.k AS BIGINT) AS fp, CAST(p.k - g.k - s.k + b.k AS BIGINT) AS tn FROM p JOIN g USING (doc_id) JOIN s USING (doc_id) JOIN b USING (doc_id)""")
def pair_eval(spark, sf):
    m = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("gold"), (F.length("text") % 3).alias("cluster"))
    return evaluate.pair_counts(m)


def coref_mentions(spark: SparkSession, sf: str) -> DataFrame:
    g = greedy(spark, sf)
    n = F.length("label") % 5
    return g.select(F.col("sent_id").alias("doc_id"), n.cast("string").alias("cluster"), F.concat_ws("-", "sent_id", F.format_string("%05d", "start")).alias("mention_id"), F.lit(0).alias("sent_id"), "start", F.col("stop").alias("end"), F.col("label").alias("mention"), F.col("label").alias("head"), F.lit("NN").alias("pos"), F.when(F.length("uri") % 3 == 0, F.col("uri")).alias("entity"), F.col("label").alias("ner_text"))


COREF = """cm AS MATERIALIZED (SELECT sent_id AS doc_id, CAST(length(label) % 5 AS VARCHAR) AS cluster, sent_id || '-' || printf('%05d', start) AS mention_id, start, stop, label AS mention, CASE WHEN length(uri) % 3 = 0 THEN uri END AS entity,
    lower(label) IN (PRONOUNS) OR (upper(label) = label AND regexp_matches(label, '[A-Z]')) AS aside FROM gl)""".replace("PRONOUNS", ", ".join(f"'{w}'" for w in coref.PRONOUNS))


@query()
def coref_split(spark, sf):
    return coref.split_clusters(coref_mentions(spark, sf)).select("doc_id", "mention_id", "cluster", "new_cluster")


@query(f"""WITH RECURSIVE {GREEDY}, {COREF}, cj AS (SELECT DISTINCT doc_id, cluster FROM cm WHERE NOT aside AND contains(mention, ' and ')),
    ln AS MATERIALIZED (SELECT DISTINCT doc_id, cluster, entity FROM cm WHERE entity IS NOT NULL AND NOT aside AND (doc_id, cluster) NOT IN (SELECT doc_id, cluster FROM cj)),
    ed AS MATERIALIZED (SELECT DISTINCT a.doc_id, a.cluster AS a, b.cluster AS b FROM ln a JOIN ln b ON a.doc_id = b.doc_id AND a.entity = b.entity),
    re(doc_id, a, b) AS (SELECT doc_id, a, b FROM ed UNION SELECT re.doc_id, re.a, ed.b FROM re JOIN ed ON ed.doc_id = re.doc_id AND ed.a = re.b),
    mg AS (SELECT doc_id, a AS cluster, min(b) AS merged FROM re GROUP BY 1, 2)
    SELECT doc_id, mention_id, cluster, coalesce(merged, cluster) AS merged FROM cm LEFT JOIN mg USING (doc_id, cluster)""")
def coref_merge(spark, sf):
    return coref.merge_clusters(coref_mentions(spark, sf)).select("doc_id", "mention_id", "cluster", "merged")


@query(f"""WITH RECURSIVE {GREEDY}, {COREF}, wd AS (SELECT sent_id AS doc_id, unnest(range(0, len(tokens))) AS word FROM sent),
    tg AS (SELECT doc_id, start AS word, 0 AS side, -stop AS o, cluster, CASE WHEN stop = start + 1 THEN '(' || cluster || ')' ELSE '(' || cluster END AS tag FROM cm UNION ALL SELECT doc_id, stop - 1, 1, -start, cluster, cluster || ')' FROM cm WHERE stop > start + 1),
    mk AS (SELECT doc_id, word, string_agg(tag, '|' ORDER BY side, o, cluster, tag) AS tags FROM tg GROUP BY 1, 2)
    SELECT DISTINCT doc_id, CAST(0 AS INT) AS sent_id, CAST(word AS INT) AS word, coalesce(tags, '-') AS tags FROM wd LEFT JOIN mk USING (doc_id, word)""")
def coref_brackets(spark, sf):
    m = coref_mentions(spark, sf)
    words = sentences(spark, sf).select(F.col("sent_id").alias("doc_id"), F.lit(0).alias("sent_id"), F.posexplode("tokens").alias("word", "t"))
    return coref.bracket_column(m, words)


# Vectors.
_DOT = "list_aggregate(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]), 'sum')"


@query(f"""WITH q AS (SELECT vec_id AS query, embedding AS x FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query, vec_id AS item, round({_DOT.format(a='x', b='embedding')} / sqrt({_DOT.format(a='x', b='x')} * {_DOT.format(a='embedding', b='embedding')}), 6) AS score FROM q JOIN embeddings ON vec_id <> query)
    SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM s QUALIFY rank <= 10""")
def cosine_topk(spark, sf):
    e = read(spark, sf, "embeddings")
    return vectors.nearest(e.where("vec_id % 50 = 0"), e, 10, digits=6)


@query()
def word2vec_types(spark, sf):
    s = doc_tokens(spark, sf).repartition(4)
    v = vectors.vectors_of(vectors.word_vectors(s, size=128, min_count=40, window=10))
    kinds = v.where(F.length("word") >= 3).groupBy(F.substring("word", 1, 1).alias("type")).agg(F.array(*[F.avg(F.col("vector")[i]) for i in range(128)]).alias("vector"))
    return vectors.ranked_types(v, kinds, "word", "vector").where("rank = 0").select("word", "type")


@query()
def linear_type_map(spark, sf):
    e = read(spark, sf, "embeddings").where("label IS NOT NULL")
    centre = e.groupBy("label").agg(F.array(*[F.avg(F.col("embedding")[i]) for i in range(64)]).alias("target"))
    pairs = e.join(centre, "label").select("vec_id", F.col("embedding").alias("source"), "target")
    out = vectors.mapped(pairs, vectors.linear_map(pairs), "source")
    return vectors.ranked_types(out, centre.select(F.col("label").alias("type"), F.col("target").alias("vector")), "vec_id").where("rank = 0").select("vec_id", "type", F.round("score", 6).alias("score"))
