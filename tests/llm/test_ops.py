"""Each training-data operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import base64
import hashlib
import io
import itertools
import random
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaloom.llm import chat, decontam, jaccard, langid, media, mixing, suffix, toxicity, url_filter, warc
from lexaloom.llm.common import stored
from lexaloom.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=False, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}" if i % 5 else None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # names that operators use inside
        df = df.withColumns({c: F.lit(1) for c in ("size", "score", "host", "node", "list", "row_key", "first", "n", "block", "bucket", "hash", "region")})
    return df


def vocabulary(n=300, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n)]


def corpus(seed=3, n=60):
    r, words = random.Random(seed), vocabulary()
    base = [[r.choice(words) for _ in range(r.choice([1, 3, 4, 5, 6, 30, 120]))] for _ in range(n)]
    out = [" ".join(b) for b in base]
    for b in base[::3]:
        w = list(b)
        for _ in range(max(1, len(w) // 25)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w).upper() if r.random() < 0.3 else " \t\n".join(w))
    return out + [None, "", "  \x0b ", "one", "ONE", out[0], out[0], "long " * 4000, "é" * 500 + " x" * 300]


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(sets))}


@pytest.mark.parametrize("options", [{}, {"long": 2}, {"long": 3, "limit": 40}])
def test_jaccard_matches_brute_force(spark, options):
    texts = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(docs_of(spark, texts, extra=True), **options).collect()}
    assert got == brute_components(texts)


def test_jaccard_null_and_repeated_ids(spark):
    same = "a b c d e f g h i j"
    got = sorted(map(tuple, jaccard.similar_components(docs_of(spark, [same, same, same, None, "z"], ids=[7, None, 7, None, 9])).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == sorted([(7, 6, 7), (7, 6, 7), (None, 6, 7), (None, 0, None), (9, 1, 9)], key=repr)
    assert jaccard.similar_components(docs_of(spark, [])).count() == 0


def test_parity_maps_never_reject_a_link():
    r = np.random.default_rng(5)
    for _ in range(300):
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        keep = a[r.random(len(a)) < r.uniform(0.7, 1)]
        b = np.unique(np.concatenate([keep, r.integers(0, 1 << 62, int(r.integers(0, 1 + n // 4))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 75 * (len(a) + len(b) - both):
            assert jaccard.may_link(jaccard.parity(a), jaccard.parity(b), len(a), len(b))


def test_divide_skip_finds_all_links():
    r = random.Random(2)
    base = [r.sample(range(3000), r.randint(1, 80)) for _ in range(40)]
    sets = [np.unique(np.array([x if r.random() > 0.08 else r.randrange(3000) for x in b], np.uint64)) for b in base for _ in range(4)]
    index = jaccard.Inverted(sets)
    for s in sets:
        want = [k for k, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 75 * len(np.union1d(s, t))]
        assert index.linked(s).tolist() == want


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = []
    for b in data:
        m = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                m[k : k + length] = True
        left = np.frombuffer(b, np.uint8)[~m].tobytes()
        out.append((len(b), int(m.sum()), int((np.diff(np.r_[0, m.astype(int)]) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 0}])
def test_suffix_matches_brute_force(spark, options):
    r, words = random.Random(8), vocabulary()
    passage = [" ".join(r.choice(words) for _ in range(60)) for _ in range(4)]
    texts = corpus(5, 30)
    for k in range(25):
        own = [" ".join(r.choice(words) for _ in range(40)) for _ in range(2)]
        texts.append(own[0] + passage[k % 4][r.randrange(80) :] + own[1])
    texts += ["x" * 500, "x" * 199, "ab" * 300, "ü" * 250, passage[0] + passage[0], passage[1][:200], passage[1][:199]]
    got = suffix.deduplicated(docs_of(spark, texts, extra=True), **options).orderBy("doc_id").collect()
    assert [(g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got] == brute_removed(texts, 200)


def test_suffix_long_texts_are_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 300)
    text = "".join(random.Random(4).choices("abcd", k=3000))
    whole = [x for a, s, f, l in suffix.text_stretches(text.encode()) for x in range(int(f[0]), int(l[-1]) + 1)]
    assert whole == list(range(len(text) - 199))


def test_suffix_kept_text_and_empty(spark):
    twice = "é" * 150
    got = {r.doc_id: r for r in suffix.deduplicated(docs_of(spark, ["a" + twice + "b", "x" + twice, None, ""]), with_text=True).collect()}
    assert got[0].kept == "ab" and got[1].kept == "x" and got[2].kept is None and got[3].kept == ""
    assert suffix.deduplicated(docs_of(spark, [])).count() == 0


def test_decontamination_matches_brute_force(spark):
    r, words = random.Random(11), vocabulary(2000)
    say = lambda n: [r.choice(words) for _ in range(n)]
    items = [say(r.randint(14, 50)) for _ in range(12)] + [say(7), []]
    texts, want = [], set()
    for k in range(60):
        own = say(r.randint(20, 80))
        if k % 3 == 0:
            item = r.randrange(12)
            put = list(items[item])
            if k % 2:  # one word in ten is changed
                for at in range(5, len(put), 10):
                    put[at] = r.choice(words)
            own = own[:10] + [w.upper() + "!!" for w in put] + own[10:]
            want.add((k, item))
        texts.append(" ".join(own))
    texts += [None, "", "x", " ".join(items[12])]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(98, None)], "item_id long, text string")
    got = decontam.overlaps(docs_of(spark, texts, extra=True), bench)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want | {(len(texts) - 1, 12)}
    assert decontam.overlaps(docs_of(spark, texts), bench.limit(0)).count() == 0
    assert decontam.overlaps(docs_of(spark, []), bench).count() == 0
    left = decontam.decontaminated(docs_of(spark, texts), bench)
    assert left.count() == len(texts) - len(want) - 1 and left.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_overlap_needs_enough_equal_words():
    item = np.arange(20)
    words = np.r_[np.full(5, -1), item, np.full(5, -1)]
    assert decontam.overlap(words, item, 5) == (5, 25, 20)
    words[[8, 12, 16, 20]] = -2
    assert decontam.overlap(words, item, 5)[2] == 16
    words[5:25:2] = -3
    assert decontam.overlap(words, item, 5) == (0, 0, 0)


def test_mixing_targets_and_limits(spark):
    r = random.Random(3)
    texts = [" ".join("w" * r.randint(1, 5) for _ in range(r.choice([0, 1, 5, 50, 400]))) or None for _ in range(300)]
    docs = docs_of(spark, texts, extra=True)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {i: (f"s{i % 3}" if i % 5 else None) for i in range(300)}
    sizes, taken, target = {}, {}, {}
    for g in got:
        s = source[g.doc_id]
        assert g.size == len((texts[g.doc_id] or "").split()) and 0 <= g.taken <= 3 * g.size
        sizes[s] = sizes.get(s, 0) + g.size
        taken[s] = taken.get(s, 0) + g.taken
        target[s] = g.target
    order = sorted((s for s in sizes if s), key=str) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    left, open_, want = sum(sizes.values()), set(sizes), {}
    while True:  # water filling, plainly
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
        open_ -= over
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 0.01 * sum(sizes.values()) + 5
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))


def test_mixing_empty_and_wordless(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert [tuple(r) for r in mixing.mix(docs_of(spark, [None, ""])).select("size", "target", "taken").collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mix(docs_of(spark, ["a b", "a b", "a b"], ids=[1, 1, None])).count() == 3


def toxic_corpus(spark, n=600):
    r, words = random.Random(6), vocabulary()
    bad = ["zzidiot", "zzmoron", "zzscum"]
    texts, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            w[5] = r.choice(bad)
        if i % 4 in (0, 1):
            w[8] = "muslim" if r.random() < (0.9 if toxic else 0.3) else "christian"
        texts.append(" ".join(w))
        labels.append((i, 0, int(toxic)))
    return texts, spark.createDataFrame(labels + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    texts, labels = toxic_corpus(spark)
    got = toxicity.score_toxicity(docs_of(spark, [*texts, None, ""], extra=True), labels).collect()
    out = [g for g in got if g.held_out and g.doc_id < 600]
    assert len(out) > 80 and all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 4 == 2) for g in got)
    assert sum(g.predicted == (g.doc_id % 4 == 0) for g in out) >= 0.97 * len(out)
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3) for g in got)
    none = [g.score for g in got if g.doc_id >= 600]
    assert len(none) == 2 and none[0] == none[1] < 0.3


def test_counterfactual_penalty_moves_identity_weights(spark):
    r = random.Random(1)
    rows = []
    for i in range(400):
        y = i % 2
        words = {b"bad" if y and r.random() < 0.8 else b"fine", b"muslim" if r.random() < (0.8 if y else 0.2) else b"christian"}
        rows.append((toxicity.text_features(words), toxicity.text_features(toxicity.swapped(words, toxicity.swaps())), y))

    def gap(strength):
        score = toxicity.fit(rows, counterfactual=strength).scorer()
        return abs(score(b"muslim fine") - score(b"christian fine"))

    assert gap(20.0) < 0.5 * gap(0.0)


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [g.predicted for g in toxicity.score_toxicity(docs_of(spark, ["a", None]), labels).collect()] == [0, 0]
    assert toxicity.score_toxicity(docs_of(spark, []), labels).count() == 0


def language_rows(seed=1, n=240):
    r = random.Random(seed)
    parts = {"aa": ["ta", "ko", "mi", "ru"], "bb": ["schl", "euf", "orn", "ich"], "cc": ["été", "ou", "eaux", "que"]}
    return [(lang, " ".join("".join(r.choice(p) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 60)))) for _ in range(n // 3) for lang, p in parts.items()]


def test_language_models(spark):
    rows = language_rows()
    df = spark.createDataFrame([(i, t, g if i % 7 else None, "s", None) for i, (g, t) in enumerate(rows)] + [(9000, None, "aa", "s", None), (9001, "123 !", "aa", "s", None), (9002, "", None, None, None)], DOCS)
    got = {g.doc_id: g for g in langid.identify_languages(df).collect()}
    assert all(got[i].lang_pred == g for i, (g, _) in enumerate(rows)) and all(0 <= g.score <= 1 for g in got.values())
    assert {got[i].lang_pred for i in (9000, 9001, 9002)} == {"und"} and {got[i].score for i in (9000, 9001, 9002)} == {0.0}
    assert langid.identify_languages(df.limit(0)).count() == 0


def test_kneser_ney_probabilities_sum_to_one():
    model = langid.fit(language_rows())
    n, bits = int(model.symbols.max()) + 1, langid.BITS
    for context in (0, 5 << 2 * bits | 6 << bits | 7):
        p = model._prob(4, np.uint64(context << bits) | np.arange(n, dtype=np.uint64))
        assert p.sum(0) == pytest.approx(np.ones(3), abs=1e-6)


def test_language_rejection_is_calibrated():
    model = langid.fit(language_rows())
    _, scores, rejected = model.predict(["qzxw vbgh jjkk zzxq wwqq " * 5, language_rows(9)[0][1] * 3])
    assert rejected == [True, False] and scores[0] <= 0.5


def png():
    def chunk(kind, data):
        return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IEND", b"")


def test_media_round_trip(spark):
    texts = ["hello", None, "", "x" * 576, "y" * 577, "ü" * 1000, "RIFF1234WAVE BM PK\x03\x04 GIF89a %PDF-1 ID3", "hello"]
    got = media.media_digests(docs_of(spark, texts, extra=True)).orderBy("doc_id").collect()
    for t, g in zip(texts, got, strict=True):
        p = media.padded((t or "").encode())
        assert len(p) % 576 == 0 and len(p) > 0
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert g.media_sha256 == hashlib.sha256(media.wav(p)).hexdigest() and g.media_bytes == len(p) + 44
        assert g.feature == f"audio/wav;samples={len(p)};embedded=0"
    assert media.media_digests(docs_of(spark, [])).count() == 0


def test_sniffing_corrects_types_and_carves(spark):
    gz = zlib.compressobj(9, zlib.DEFLATED, 31)
    gz = gz.compress(b"data" * 50) + gz.flush()
    blob = png() + b"BM junk" + gz + b"tail" + media.wav(b"abc")
    rows = [(1, png(), "image/gif"), (2, blob, "image/png"), (3, b"BMnot a bitmap", "image/bmp"), (4, None, None), (5, png()[:-1], "image/png"), (6, gz, "application/gzip")]
    got = {r.doc_id: r for r in media.sniff_media(spark.createDataFrame(rows, "doc_id long, media binary, declared_type string"), keep=("doc_id",)).collect()}
    assert (got[1].media_type, got[1].corrected) == ("image/png", True)
    assert not got[2].corrected and [(e.type, bytes(e.data)) for e in got[2].embedded] == [("application/gzip", gz), ("audio/wav", media.wav(b"abc"))]
    assert got[3].media_type == "application/octet-stream" == got[5].media_type and got[4].media_type is None
    assert got[6].media_type == "application/gzip" and not got[6].corrected


def test_chat_round_trip():
    r = random.Random(9)
    for _ in range(300):
        turns = [("".join(r.choices("ab:#<\\ \n", k=r.randint(0, 5))), "".join(r.choices("ab:#<\\/turn> \n### ", k=r.randint(0, 30)))) for _ in range(r.randint(0, 5))]
        text, spans = chat.render(turns, turns[0][0] if turns else "")
        assert chat.parse(text) == turns
        assert [chat.unescaped(text[a:b]) for a, b in spans] == [t for role, t in turns if role == turns[0][0]]
    with pytest.raises(ValueError):
        chat.parse("### a: b")


def test_chat_events(spark):
    log = [(1, 1, "m1", "open", "user", "hi"), (1, 2, "m2", "open", "assistant", ""), (1, 3, "m2", "delta", None, "wro"), (1, 4, "m2", "delta", None, "ng"), (1, 5, "m2", "regenerate", None, None), (1, 6, "m2", "delta", None, "right"), (1, 7, "m1", "edit", None, "hello"), (1, 8, "m3", "open", "user", "x"), (1, 9, "m3", "delete", None, None), (None, 1, "n", "delta", None, None), (2, 1, "k", "open", None, None)]
    df = spark.createDataFrame(log, "conv_id long, seq long, message_id string, kind string, role string, text string").withColumn("formatted", F.lit("x"))
    got = {r.conv_id: r.formatted for r in chat.reconstruct(df.orderBy(F.rand(1))).collect()}
    assert chat.parse(got[1]) == [("user", "hello"), ("assistant", "right")]
    assert chat.parse(got[None]) == [("", "")] and chat.parse(got[2]) == [("", "")]
    assert chat.reconstruct(df.limit(0)).count() == 0


def test_chat_repeated_turns(spark):
    rows = [(1, 0, "user", "a\\b"), (1, 0, "user", "a\\b"), (1, 1, None, None), (None, 0, "assistant", "</turn>")]
    got = {r.conv_id: r for r in chat.read_back(chat.reconstruct(chat.turn_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"user\na\\b\n" * 2 + b"\n\n").hexdigest() and got[1].loss_chars == 0
    assert got[None].loss_chars == 7 and got[None].loss_sha256 == hashlib.sha256(b"</turn>").hexdigest()


PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ b\r\nX: y", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "v", "<p>é</p>"), (4, "w", "<p>é</p>"), (None, "n", "<p>é</p>"), (None, "m", "alone"), (9, "z", "q" * 200_000)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("refers_to", F.lit(5))
    archives = stored(warc.write_archives(warc.with_record_types(pages), str(tmp_path)), "archives")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(archives).collect()), key=repr)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        last = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        again = last is not None and page != last
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", last if again else None))
    assert got == sorted(want, key=repr)
    assert {p.name for p in tmp_path.iterdir()} == {r.path.rsplit("/", 1)[1] for r in archives.collect()} and all(p.name.endswith(".warc.gz") for p in tmp_path.iterdir())
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.warc.gz"))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(files).collect()), key=repr) == got
    assert warc.read_archives(warc.write_archives(warc.with_record_types(pages.limit(0)), str(tmp_path))).count() == 0


def test_warc_damage_is_found():
    good = warc.member(warc.record("response", 1, "u", b"payload" * 100, None)) + warc.member(warc.record("response", 2, "u", b"", None))
    assert len(list(warc.records(good))) == 2
    with pytest.raises(EOFError):
        list(warc.records(good[:-9]))
    bad = warc.record("response", 1, "u", b"payload", None).replace(b"payload\r", b"pAyload\r")
    with pytest.raises(ValueError):
        list(warc.records(warc.member(bad)))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_url_filter_matches_brute_force(spark):
    r = random.Random(4)
    urls = [f"{r.choice(['http', 'HTTPS'])}://{r.choice(['', 'a.', 'B.c.', 'x'])}{r.choice(['example.org', 'Example.ORG', 'org', 'com', 'k.com', 'example.orgs'])}{r.choice(['', '/', '/es/1', '/en/12', '/en/2', '/fr/', '/de/x', '/DE/'])}{r.choice(['', '?q=/de/', '#x', '?a://b'])}" for _ in range(300)]
    urls += [None, "", "nothing", "://", "http://", "http://org", "http://é.ORG/\n/x"]
    ids = [i if i % 7 else None for i in range(len(urls))]
    pages = spark.createDataFrame(list(zip(ids, urls, ["x"] * len(urls), strict=True)), "page_id long, url string, rule string")
    for blocks in (1, 4096):
        got = url_filter.filter_urls(pages, url_filter.rule_table(spark, RULES), n_blocks=blocks).collect()
        want = [(i, *brute_url(u)) for i, u in zip(ids, urls, strict=True)]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert url_filter.filter_urls(pages, url_filter.rule_table(spark, [])).where("rule IS NOT NULL").count() == 0
    assert url_filter.filter_urls(pages.limit(0), url_filter.rule_table(spark, RULES)).count() == 0


def test_url_filter_runs_no_python(spark):
    plan = url_filter.filter_urls(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), url_filter.rule_table(spark, RULES))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow"))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5), (None, 3)]
    root = {x: x for e in edges for x in e if x is not None}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {g.node: g.root for g in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in root if sum(find(x) == find(k) for x in root) > 1}


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in c.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "mixing_sources"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = c.toxicity(spark, docs, sf)
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scored.collect() if not r.predicted}
    one = c.ngram_jaccard(spark, docs, sf)
    comps = brute_components([texts[i] for i in sorted(texts)])
    order = sorted(texts)
    assert {r.doc_id for r in one.collect()} == {order[i] for i, (n, root) in comps.items() if n == 0 or root == i}
    cut = {r.doc_id: r for r in c.suffix_array(spark, docs, sf).collect()}
    sizes = brute_removed([texts[i] for i in order], 200)
    for i, (n, gone, _, _) in zip(order, sizes, strict=True):
        assert cut[i].text == texts[i] if not gone else n - gone - 6 * 4 <= len(cut[i].text.encode()) <= n - gone
    for f in (c.toxicity, c.ngram_jaccard, c.suffix_array, c.decontamination):
        assert f(spark, docs, sf).schema.names == docs.columns
        assert f(spark, docs.limit(0), sf).count() == 0
        clash = docs.limit(20).withColumns({x: F.lit("7") for x in ("score", "_drop", "_bad", "kept", "spans", "n_bytes", "row_key", "data", "_in3", "places")})
        out = f(spark, clash, sf)
        assert out.columns == clash.columns and all(r.score == r.kept == r._drop == r._in3 == "7" for r in out.collect())
    nulls = docs.limit(0).union(spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 3), (None, "", None, "s", None), (2, "a b", None, None, None)], docs.schema))
    for f in (c.toxicity, c.ngram_jaccard, c.suffix_array, c.decontamination):
        assert f(spark, nulls, sf).count() == 4
    assert c.mixing(spark, nulls, sf).count() == 4
    assert c.run(spark, sf).columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_long_lists_are_cut_within_a_batch():
    r = np.random.default_rng(3)
    nodes, n = np.arange(1000, 1400), r.integers(20, 60, 400)
    t = np.r_[np.full(400, 7, np.uint64), r.integers(100, 1 << 40, 400).astype(np.uint64)]
    o = np.r_[np.arange(400), np.arange(400)].astype(np.uint16)
    left, owner, hot, (a, b, c) = jaccard.without_long(t, o, nodes, n, 64)
    assert hot.sum() == (left == 7).sum() <= 2 * len(np.unique(jaccard.bands(n))) + 2
    assert {(x, y) for x, y, z in zip(a, b, c, strict=True) if x == y and z == 1} == {(x, x) for x in nodes.tolist()}
    heads = set(nodes[owner[hot == 1]].tolist())
    assert {x for x, y in zip(a, b, strict=True) if x != y} <= heads  # each edge leads to a set that goes on
    alike = {(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    for k in range(1, 400):  # sets of like size share a band's least set
        for j in range(k):
            if min(n[k], n[j]) * 100 >= 75 * max(n[k], n[j]):
                assert any((h, nodes[k]) in alike | {(nodes[k], nodes[k])} and (h, nodes[j]) in alike | {(nodes[j], nodes[j])} for h in heads)
                break


def test_jaccard_common_passage(spark):
    r, words = random.Random(21), vocabulary(3000)
    passage = " ".join(r.choice(words) for _ in range(60))
    texts = [" ".join(r.choice(words) for _ in range(r.choice([10, 40, 100]))) + " " + passage for _ in range(90)]
    texts += [texts[k] + " end" for k in range(0, 90, 3)]
    for options in ({}, {"long": 8}, {"long": 8, "limit": 500}):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.similar_components(docs_of(spark, texts), **options).collect()}
        assert got == brute_components(texts)


def test_jaccard_common_passages_across_batches(spark):
    r, words = random.Random(10), vocabulary(5000)
    say = lambda n: [r.choice(words) for _ in range(n)]
    passages = [say(50) for _ in range(20)]
    texts = [" ".join(passages[k % 20] + say(950)) for k in range(240)]  # each batch has each passage in six texts that hold no other
    for at, order in ((10, passages), (230, passages[::-1])):  # two of all passages, in different batches, least in none of their lists
        texts[at] = " ".join(w for p in order for w in p)
    want = brute_components(texts)
    assert want[10][1] == want[230][1] == 10
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.similar_components(docs_of(spark, texts).repartitionByRange(2, "doc_id"), long=3).collect()}
    assert got == want


def test_mixing_small_sources_reach_their_targets(spark):
    sizes = {"a": [5000] * 40, "b": [70] * 3, "c": [1], "d": [40] * 25, "e": [], "f": [3, 0, 4]} | {f"g{k:02}": [k + 1] for k in range(40)}
    rows = [(f"{s}-{k}", " ".join(["w"] * n), s) for s, texts in sizes.items() for k, n in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, s) for i, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    for slots in (16, 1000, mixing.SLOTS):  # fewer slots than sources, too
        taken, target, size = {}, {}, {}
        for g in mixing.mix(docs, n_slots=slots).collect():
            s = rows[g.doc_id][2]
            assert 0 <= g.taken <= 3 * g.size
            taken[s], target[s], size[s] = taken.get(s, 0) + g.taken, g.target, g.source_size
        for s in target:
            assert abs(taken[s] - target[s]) <= max(1, size[s] / 256), s


def test_every_confirmed_overlap_has_a_seed():
    words = np.arange(1, 14).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in range(6, 14):
        item = words[:n]
        listed = decontam.seeds(item)
        least = -(-decontam.MATCHES * n // decontam.WINDOW)
        for k in range(n - least + 1):
            for at in itertools.combinations(range(n), k):
                text = item.copy()
                text[list(at)] += np.uint64(1)
                assert decontam.overlap(text, item, 0)[2]
                assert any((a == b).any() for a, b in zip(decontam.seeds(text), listed, strict=True)), (n, at)


def test_warc_reads_other_producers():
    def rec(kind, block, extra="", sep=": ", eol="\r\n", http=False):
        head = eol.join(["WARC/1.0", f"WARC-Type{sep}{kind}", f"warc-record-id{sep}<urn:uuid:{kind}>", *([f"Content-type{sep}application/http;msgtype={kind}"] if http else []), *([extra] if extra else []), f"content-length{sep}{len(block)}"])
        return (head + eol * 2).encode() + block + b"\r\n\r\n"

    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>no length</p>"
    whole = [
        rec("warcinfo", b"software: a\r\nformat: WARC\r\n"),
        rec("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", http=True),
        rec("response", page, "WARC-Target-URI:<http://x/>\r\n  ", sep=":", http=True),
        rec("metadata", b"fetchTimeMs: 7", eol="\n"),
        rec("resource", b"", "X-Folded: a\r\n\tb"),
        rec("conversion", b"text " * 50_000, "WARC-Payload-Digest: sha1:" + hashlib.sha1(b"text " * 50_000).hexdigest()),
    ]
    want = [("warcinfo", 27), ("request", 0), ("response", 16), ("metadata", 14), ("resource", 0), ("conversion", 250_000)]
    for archive in (b"".join(map(warc.member, whole)), warc.member(b"".join(whole)), b"".join(whole)):
        got = [warc.read_record(h, b) for h, b in warc.records(archive)]
        assert [(r[3], r[5]) for r in got] == want and got[2][2] == "http://x/" and got[0][1] is None and got[0][0] == "<urn:uuid:warcinfo>"
        assert [h.get("x-folded") for h, _ in warc.records(archive)][4] == "a b"
    with pytest.raises(ValueError):
        list(warc.records(b"not a record\r\n\r\n"))
    with pytest.raises(ValueError):
        [warc.read_record(h, b) for h, b in warc.records(rec("resource", b"other", "WARC-Payload-Digest: sha1:" + "A" * 32))]


def test_language_letters_beyond_a_small_alphabet():
    han = [chr(0x4E00 + k) for k in range(6000)] + [chr(0xAC00 + k) for k in range(500)]
    r = random.Random(3)
    model = langid.fit([("zh", "".join(r.sample(han[:6000], 3000))) for _ in range(8)] + [("ko", "".join(r.choices(han[6000:], k=400))) for _ in range(8)] + language_rows(n=30))
    assert len(set(model.symbols[[ord(c) for c in han]].tolist())) > 6400
    assert model.predict(["".join(r.choices(han[6000:], k=50)), "".join(r.choices(han[:6000], k=50))])[0] == ["ko", "zh"]


def test_many_languages_in_groups(monkeypatch):
    rows = language_rows()
    texts = [t for _, t in rows[:30]]
    whole = langid.fit(rows)
    monkeypatch.setattr(langid, "GROUP", 2)
    parts = langid.fit(rows)
    assert len(parts.groups) == 2 and len(whole.groups) == 1
    assert parts.entropies(texts)[0] == pytest.approx(whole.entropies(texts)[0])


def brute_kneser_ney(rows, lang, text):
    """Cross-entropy of a text by interpolated Kneser-Ney counts in plain dictionaries."""
    letters = {c for _, t in rows for c in t.lower() if c.isalpha()}
    sym = lambda t: [" "] * 3 + [(c if c in letters else "?") if c.isalpha() else " " for c in t.lower()]
    grams = [{} for _ in range(5)]
    for g, t in rows:
        if g == lang:
            s = sym(t)
            for k in range(3, len(s)):
                x = tuple(s[k - 3 : k + 1])
                grams[4][x] = grams[4].get(x, 0) + 1
    for n in (3, 2, 1):
        for x in grams[n + 1]:
            grams[n][x[1:]] = grams[n].get(x[1:], 0) + 1

    def p(x):
        if not x:
            return 1 / (len(letters) + 2)
        same = {k: v for k, v in grams[len(x)].items() if k[:-1] == x[:-1]}
        total = sum(same.values())
        if not total:
            return p(x[1:])
        return max(same.get(x, 0) - 0.75, 0) / total + 0.75 * len(same) / total * p(x[1:])

    s = sym(text)
    return -sum(np.log(p(tuple(s[k - 3 : k + 1]))) for k in range(3, len(s))) / (len(s) - 3)


def test_entropies_match_plain_kneser_ney():
    rows = language_rows(n=24)
    model = langid.fit(rows)
    texts = [rows[0][1][:40], "schleuf 7 ta", "é ß ou"]
    e, _ = model.entropies(texts)
    for k, t in enumerate(texts):
        assert e[k] == pytest.approx([brute_kneser_ney(rows, g, t) for g in model.languages])


def test_language_clashing_names(spark):
    rows = language_rows(n=60)
    df = spark.createDataFrame([(i, t, g, "s", None) for i, (g, t) in enumerate(rows)], DOCS).withColumns({c: F.lit("7") for c in ("lang_pred", "rejected", "score", "held_out")})
    assert all(g.lang_pred == rows[g.doc_id][0] for g in langid.identify_languages(df).collect())


def test_counterfactual_penalty_end_to_end(spark):
    """Group names go with the label in training; mentions of the rarer group in harmless texts are what the penalty is to leave alone."""
    r, words = random.Random(16), vocabulary()
    texts, labels = [], []
    for i in range(900):
        w = [r.choice(words) for _ in range(r.randint(8, 15))]
        toxic = i % 3 == 0
        if toxic and r.random() < 0.75:
            w[2] = "zzidiot"
        w[5] = "zzgroupa" if r.random() < (0.95 if toxic else 0.08) else "zzgroupb"
        texts.append(" ".join(w))
        labels.append((i, 0, int(toxic)))
    neutral = [" ".join([r.choice(words) for _ in range(10)] + ["zzgroupa"]) for _ in range(100)]
    df, marks = docs_of(spark, texts + neutral), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    false = {}
    for strength in (0.0, 30.0):
        got = toxicity.score_toxicity(df, marks, terms=[["zzgroupa", "zzgroupb"]], counterfactual=strength).collect()
        false[strength] = sum(g.predicted for g in got if g.doc_id >= 900)
    assert false[0.0] >= 90 and false[30.0] <= 10
    assert toxicity.train(df, marks, terms=[["zzgroupa", "zzgroupb"]]).pairs > 600 and toxicity.train(df, marks).pairs == 0


def test_toxicity_fit_matches_plain_descent():
    """The fit's objective against plain gradient descent with dense numbers."""
    r = random.Random(12)
    rows, y = [], []
    for i in range(300):
        t = i % 2
        words = {w for w in (b"aa", b"bb", b"cc", b"dd") if r.random() < (0.7 if (w in (b"aa", b"bb")) == bool(t) else 0.25)}
        rows.append((toxicity.text_features(words), None, t))
        y.append(t)
    model = toxicity.fit(rows)
    names = sorted(model.weights)
    x = np.array([[f in set(row[0].tolist()) for f in names] for row in rows], float)
    y = np.array(y, float)

    def loss(w, b):
        z = x @ w + b
        return float(np.mean(np.log1p(np.exp(z)) - y * z) + 1e-4 / 20 * (w @ w))

    w, b = np.zeros(len(names)), 0.0
    for _ in range(6000):
        g = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= 0.5 * (x.T @ g / len(y) + 1e-4 / 10 * w)
        b -= 0.5 * g.mean()
    assert loss(np.array([model.weights[n] for n in names]), model.bias) == pytest.approx(loss(w, b), abs=2e-4)
    score = model.scorer()
    z = sum(model.weights.get(f, 0) for f in toxicity.text_features({b"aa", b"zz"}).tolist()) + model.bias
    assert score(b"aa ZZ aa") == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_repeated_rows(spark):
    texts, labels = toxic_corpus(spark)
    got = toxicity.score_toxicity(docs_of(spark, texts + texts[:20], ids=[*range(600), *range(20)]), labels).collect()
    assert len(got) == 620 and len({(g.doc_id, g.score) for g in got}) == 600


def flac(frames, total):
    def crc(data, bits, poly):
        c, t = 0, media.crc_table(bits, poly)
        for x in data:
            c = (c << 8 & (1 << bits) - 1) ^ t[c >> bits - 8 ^ x]
        return c.to_bytes(bits // 8, "big")

    info = b"\x10\x00\x10\x00" + bytes(6) + (16000 << 44 | 7 << 36 | total).to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + b"\x80\0\0\x22" + info
    for k, body in enumerate(frames):
        head = bytes([0xFF, 0xF8, 0x10, 0x00, k])
        frame = head + crc(head, 8, 0x07) + body
        out += frame + crc(frame, 16, 0x8005)
    return out


def test_media_ends_are_found():
    r = random.Random(4)
    sound = flac([r.randbytes(200) for _ in range(3)], 3 * 192)
    pdf = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nstartxref\n9\n%%EOF"
    updated = pdf + b"\n2 0 obj\n<<>>\nendobj\nxref\nstartxref\n50\n%%EOF"
    for first, kind in ((sound, "audio/flac"), (updated, "application/pdf"), (zip_of(zip_of(b"x")), "application/zip")):
        blob = first + png() + b"tail" + pdf
        assert media.found_media(blob)[:2] == [(0, len(first), kind), (len(first), len(png()), "image/png")], kind
    assert media.found_media(sound[:-1]) == [] and media._flac_length(flac([r.randbytes(50)], 0) + b"more", 0) == len(flac([bytes(50)], 0))


def zip_of(data):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", data)
    return out.getvalue()


def test_media_null_and_repeated_ids(spark):
    got = media.media_digests(docs_of(spark, ["a", "a", "b"], ids=[None, None, 4])).collect()
    assert sorted((g.doc_id or 0, g.n_bytes) for g in got) == [(0, 1), (0, 1), (4, 1)] and len({g.payload_sha256 for g in got}) == 2


def test_url_filter_long_urls_and_ties(spark):
    long = "http://" + "a." * 2000 + "example.org/" + "x/" * 20_000
    rules = url_filter.rule_table(spark, [("example.org", "/", "block"), ("EXAMPLE.org", "/", "allow"), ("org", "/x", "block"), ("org", "/" + "x/" * 4, "allow")])
    pages = spark.createDataFrame([(1, long), (1, long), (2, "http://b.org/x/x/x/x/1")], "page_id long, url string")
    got = sorted((g.page_id, g.rule, g.verdict) for g in url_filter.filter_urls(pages, rules).collect())
    assert got == [(1, "example.org/", "block"), (1, "example.org/", "block"), (2, "org/x/x/x/x/", "allow")]


def test_repeated_rows_in_crowded_buckets(spark, monkeypatch):
    """Equal rows in different tasks whose stretches are crowded in each."""
    monkeypatch.setattr(suffix, "HEAVY", 1)
    r, words = random.Random(31), vocabulary()
    line = " ".join(r.choice(words) for _ in range(30))
    texts = [" ".join(r.choice(words) for _ in range(12)) + line + " ".join(r.choice(words) for _ in range(12)) for _ in range(12)]
    df = docs_of(spark, texts + texts, ids=[*range(12), *range(12)]).repartition(3)
    got = suffix.deduplicated(df).collect()
    assert len(got) == 24 and all(g.n_removed == g.n_bytes for g in got)


def test_refinement_matches_plain_windows():
    r = random.Random(1)
    for t in range(40):
        base = bytes(r.choices(b"ab" if t % 2 else b"abcdefgh", k=400))
        parts = []
        for _ in range(r.randint(1, 12)):
            k = r.randint(0, 250)
            x = bytearray(base[k : k + r.randint(200, 340)] if r.random() < 0.8 else bytes(r.choices(b"ab", k=r.randint(200, 300))))
            if len(x) > 50 and r.random() < 0.4:
                x[r.randrange(len(x))] = 99
            parts.append(bytes(x))
        seen = {}
        for i, x in enumerate(parts):
            for k in range(len(x) - 199):
                seen.setdefault(x[k : k + 200], []).append((i, k))
        own, within = suffix.repeated_windows(parts)
        assert list(zip(own.tolist(), within.tolist(), strict=True)) == sorted(p for v in seen.values() if len(v) > 1 for p in v)


def test_heap_merge_matches_plain_counts():
    r = random.Random(7)
    for _ in range(200):
        lists = [sorted(r.sample(range(40), r.randint(1, 20))) for _ in range(r.randint(1, 9))]
        weights, least = [r.randint(1, 4) for _ in lists], r.randint(1, 12)
        want = {d: n for d in range(40) if (n := sum(w for x, w in zip(lists, weights, strict=True) if d in x)) >= least}
        assert dict(zip(*jaccard.heap_merged(lists, weights, least), strict=True)) == want


def test_bit_tables_hold_their_keys(spark, monkeypatch):
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    monkeypatch.setattr(decontam, "LEAST_BITS", 17)
    table = decontam.BitTable(decontam.bit_table(spark.createDataFrame([(int(k),) for k in keys], "hash long")))
    other = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 5000)
    assert table.may_hold(keys).all() and table.may_hold(other).mean() < 0.01
    assert decontam.table_bits(1) == 17 and decontam.table_bits(1 << 40) == decontam.MOST_BITS


def test_hubs_of_components(spark, monkeypatch):
    from lexaloom.llm import components

    monkeypatch.setattr(components, "LEAST", 10)
    edges = [(500, k) for k in range(100)] + [(1000, 2000 + k) for k in range(50)] + [(2049, 3000)]
    got = {g.node: g.root for g in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in (*range(100), 500)}, **{k: 1000 for k in (1000, *range(2000, 2050), 3000)}}


def test_toxicity_fit_with_rare_identity_terms():
    """Identity terms in so few texts that no feature of theirs is kept: the penalty acts on nothing, the fit is that without it."""
    swap, rows = toxicity.swaps(), []
    for i in range(200):
        words = {b"vile" if i % 2 else b"fine", b"word%d" % (i % 7)} | ({b"men"} if i == 5 else set())
        other = toxicity.swapped(words, swap)
        rows.append((toxicity.text_features(words), None if other is None else toxicity.text_features(other), i % 2))
    model, plain = toxicity.fit(rows), toxicity.fit([(f, None, y) for f, _, y in rows])
    assert model.pairs == 1 and plain.pairs == 0
    assert model.weights == plain.weights and model.bias == plain.bias and model.weights


def test_toxicity_sends_only_kept_features(spark):
    """What goes to the driver is small, and the fit over it is the one over all features."""
    texts, labels = toxic_corpus(spark)
    texts = [f"{t} {' '.join(f'{w}q{i}' for w in vocabulary(400, i))}" for i, t in enumerate(texts)]
    docs = docs_of(spark, texts)
    marked = toxicity.labelled_texts(docs, labels)
    rows = [(toxicity.tokens(r.text.encode()), r.toxic) for r in marked.collect()]
    kept = toxicity.telling_features(marked, len(rows), sum(y for _, y in rows))
    sent = toxicity.labelled_features(marked, kept).collect()
    assert len(sent) == len(rows) and max(len(r.features) for r in sent) <= 4 * len(kept) < 400
    swap = toxicity.swaps()
    every = [(toxicity.text_features(w), None if (o := toxicity.swapped(w, swap)) is None else toxicity.text_features(o), y) for w, y in rows]

    def place(row):  # train's order of rows, which tells in the last digits
        f, o = (None if x is None else np.intersect1d(x, kept).tobytes() for x in row[:2])
        return row[2], f, o is not None, o or b""

    model, whole = toxicity.train(docs, labels), toxicity.fit(sorted(every, key=place))
    assert model.pairs == whole.pairs > 0
    assert model.weights == whole.weights and model.bias == whole.bias
