"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import read_back, reconstruct, turn_events
from .common import scratch_folder, stored, table
from .decontam import overlaps
from .jaccard import similar_components
from .langid import identify_languages
from .media import media_digests
from .mixing import mix
from .suffix import deduplicated
from .toxicity import score_toxicity
from .url_filter import filter_urls, rule_table
from .warc import read_archives, with_record_types, write_archives

# The rules of op10.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents")).drop("row_key")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :said), (-7L, 1L, 'assistant', :said) AS t(conv_id, turn, role, text)", args={"said": said})
    return read_back(reconstruct(turn_events(turns.union(extra))))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stored(write_archives(with_record_types(table(spark, sf_dir, "pages")), scratch_folder(spark, "warc")), "archives")
    return read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing_sources, op2_toxicity, op3_suffix_array_dedup, op4_ngram_jaccard_join, op5_language_id, op6_media_columns, op7_chat_formatting, op8_warc, op9_decontamination, op10_url_filters)
}

ORACLES: dict[str, str] = {
    "op1_mixing_sources": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('0/' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
        a AS (SELECT *, (k - 1) % 3 + 1 AS weight, source_size * 3 AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
        b AS (SELECT *, cap / weight AS ratio,
                     (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor FROM a),
        c AS (SELECT *, max(factor) FILTER (ratio > factor) OVER () AS level FROM b),
        t AS (SELECT *, CASE WHEN ratio <= factor THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target FROM c),
        u AS (SELECT *, greatest(1, (total + 131071) // 131072) AS block FROM t),
        v AS (SELECT *, greatest(1, least(source_size, greatest((source_size + block - 1) // block, 256))) AS n_blocks FROM u),
        z AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(3 * n_blocks, floor(target * n_blocks / source_size + 0.5)) AS BIGINT) ELSE 0 END AS takes FROM v),
        e AS (SELECT d.*, z.source_size, z.target, z.n_blocks, z.takes, CAST(sum(size) OVER (PARTITION BY z.k ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source),
        x AS (SELECT *, unnest(CASE WHEN size > 0 THEN range(((start + 1) * n_blocks - 1) // source_size, ((start + size) * n_blocks - 1) // source_size + 1) ELSE [-1] END) AS b FROM e)
        SELECT doc_id, size, source_size, target, CAST(coalesce(sum(CASE WHEN b >= 0 THEN
            (least(start + size, (b + 1) * source_size // n_blocks) - greatest(start, b * source_size // n_blocks)) * (takes // n_blocks + CASE WHEN b < takes % n_blocks THEN 1 ELSE 0 END) END), 0) AS BIGINT) AS taken
        FROM x GROUP BY doc_id, size, source_size, target, start, h""",
    "op3_suffix_array_dedup": """
        WITH t AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS t, hex(t) AS h FROM documents),
        w AS MATERIALIZED (SELECT r, i, hash(t[i + 1:i + 200]) AS x FROM t, LATERAL unnest(range(0, CAST(octet_length(t) - 199 AS BIGINT))) u(i)),
        m AS (SELECT r, i FROM w WHERE x IN (SELECT x FROM w GROUP BY x HAVING count(*) > 1)),
        g AS (SELECT r, i, sum(CASE WHEN i > before + 200 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM m)),
        s AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, run),
        c AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS gone, count(*) AS spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM s GROUP BY r),
        k AS (SELECT doc_id, h, coalesce(gone, 0) AS gone, coalesce(spans, 0) AS spans, CASE WHEN c.r IS NULL THEN h ELSE
              array_to_string(list_transform(list_zip(list_prepend(0, ends), list_append(starts, length(h) // 2)), lambda z: substr(h, 2 * z[1] + 1, 2 * (z[2] - z[1]))), '') END AS kept FROM t LEFT JOIN c USING (r))
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k""",
    "op4_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) END AS sh FROM w),
        n AS MATERIALIZED (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
        u AS MATERIALIZED (SELECT doc_id, hash(unnest(sh)) AS x FROM s),
        c AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS MATERIALIZED (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
        r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2""",
    "op6_media_columns": """
        WITH tab AS (SELECT list(list_reduce(list_prepend(k, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t FROM (SELECT CAST(range AS BIGINT) AS k FROM range(256))),
        d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        p AS (SELECT doc_id, length(h) // 2 AS n, greatest(576, (length(h) // 2 + 575) // 576 * 576) AS m, h FROM d),
        q AS (SELECT doc_id, n, m, h || repeat('FF', CAST(m - n AS BIGINT)) AS h FROM p),
        v AS (SELECT *, list_transform([36 + m, m], lambda x: array_to_string(list_transform([0, 8, 16, 24], lambda k: printf('%02X', CAST((CAST(x AS BIGINT) >> k) & 255 AS INT))), '')) AS le FROM q),
        w AS (SELECT *, hex('RIFF') || le[1] || hex('WAVEfmt ') || '1000000001000100803E0000803E000001000800' || hex('data') || le[2] || h AS media FROM v)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, sha256(unhex(h)) AS payload_sha256,
               xor(list_reduce(list_prepend(4294967295, list_transform(range(32), lambda k: CAST('0x' || substr(h, CAST(2 * (m - 32 + k) + 1 AS BIGINT), 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS tail_crc32,
               CAST(m + 44 AS BIGINT) AS media_bytes, sha256(unhex(media)) AS media_sha256, 'audio/wav;samples=' || m || ';embedded=0' AS feature FROM w, tab""",
    "op7_chat_formatting": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(14 + length(role) + length(regexp_replace(role, '[\\#<:]', '..', 'g')) - length(role)
                        + length(regexp_replace(text, '[\\#<]', '..', 'g'))) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p),
        v AS (SELECT *, list_transform(range(8), lambda g: CAST('0x' || substr(hex, CAST(5 * g + 1 AS INT), 5) AS BIGINT)) AS groups FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               list_aggregate(list_transform(groups, lambda x: list_aggregate(list_transform([15, 10, 5, 0],
                   lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x >> s) & 31) + 1 AS INT), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to
        FROM v""",
    "op9_decontamination": r"""
        WITH dw AS (SELECT doc_id, w, i - 1 AS p FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM documents))),
        bi AS MATERIALIZED (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
        bw AS (SELECT item_id, n, w, i - 1 AS p FROM (SELECT item_id, len(ws) AS n, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM bi WHERE len(ws) >= 5)),
        e AS MATERIALIZED (SELECT doc_id, item_id, least(n, 13) AS need, n, dw.p - bw.p AS shift, dw.p AS p FROM dw JOIN bw USING (w)),
        l AS MATERIALIZED (SELECT doc_id, item_id, shift, need, n, list(p ORDER BY p) AS ps FROM e GROUP BY doc_id, item_id, shift, need, n HAVING count(*) * 13 >= need * 10),
        size AS (SELECT doc_id, max(p) + 1 AS words FROM dw GROUP BY doc_id),
        x AS (SELECT l.*, unnest(range(greatest(0, shift), least(words, shift + n) - need + 1)) AS a FROM l JOIN size USING (doc_id)),
        good AS (SELECT doc_id, item_id, shift, need, any_value(ps) AS ps, min(a) AS lo, max(a) + need AS hi FROM x WHERE len(list_filter(ps, lambda q: q >= a AND q < a + need)) * 13 >= need * 10 GROUP BY doc_id, item_id, shift, need),
        o AS (SELECT doc_id, item_id, lo, hi, len(list_filter(ps, lambda q: q >= lo AND q < hi)) AS k FROM good)
        SELECT doc_id, item_id, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS end_word, CAST(k AS BIGINT) AS equal_words FROM o
        QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY k DESC, lo, hi DESC) = 1""",
    "op10_url_filters": """
        WITH r(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
        c AS (SELECT page_id, translate(coalesce(raw, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM b),
        m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
              FROM c JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT c.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM c LEFT JOIN m USING (page_id)""",
}
