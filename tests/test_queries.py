"""Every query beside its SQL at sf0.001; those without SQL against plain versions and under other partitions."""

import math
import random
import re

import duckdb
import numpy as np
import pytest

import compare
from lexaloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.canonical(got) == compare.canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"word2vec_types"}))
def test_same_rows_however_dealt(spark, name):
    """Queries without SQL: rows of a stable schema that don't depend on partitions."""
    found = []
    for parts in (4, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append(QUERIES[name](spark, SF).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(found[0]) > 0 and len(set(found[0].columns)) == len(found[0].columns)
    assert compare.canonical(found[0]) == compare.canonical(found[1])


def test_word2vec_gives_each_frequent_word_a_type(spark, db):
    got = QUERIES["word2vec_types"](spark, SF).collect()
    want = db.sql("SELECT w FROM (SELECT unnest(regexp_split_to_array(lower(coalesce(text, '')), '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY w HAVING count(*) >= 40").fetchall()
    assert {g.word for g in got} == {w for (w,) in want} and len({g.type for g in got}) > 1


def test_linear_map_is_least_squares(spark, db):
    rows = [(i, np.array(x), lab) for i, x, lab in db.sql("SELECT vec_id, embedding, label FROM embeddings WHERE label IS NOT NULL ORDER BY vec_id").fetchall()]
    x = np.array([r[1] for r in rows], float)
    centres = {c: x[[r[2] == c for r in rows]].mean(0) for c in {r[2] for r in rows}}
    m, *_ = np.linalg.lstsq(x, np.array([centres[r[2]] for r in rows]), rcond=None)
    got = {r.vec_id: r for r in QUERIES["linear_type_map"](spark, SF).collect()}
    assert set(got) == {r[0] for r in rows}
    for (i, v, _), y in zip(rows, x @ m, strict=True):
        score = {c: float(y @ t / np.linalg.norm(y) / np.linalg.norm(t)) for c, t in centres.items()}
        assert got[i].score == pytest.approx(max(score.values()), abs=1e-4)


def test_segment_walk_matches_plain_steps(spark, db):
    blocks = {}
    for i, text in db.sql("SELECT item_id, lower(text) FROM benchmark").fetchall():
        for clause in re.split(r"[.,\n]\s*", text):
            w = [x for x in clause.split(" ") if x]
            for k in range(0, len(w), 2):
                blocks.setdefault(i % 4, {}).setdefault(" ".join(w[k : k + 2]), set()).add(i)
    want = {}
    for block, tweets in blocks.items():
        names = sorted(tweets)
        weight = {a: {b: len(tweets[a] & tweets[b]) / len(tweets[a] | tweets[b]) for b in names if a != b and tweets[a] & tweets[b]} for a in names}
        pi, before = dict.fromkeys(names, 1 / len(names)), 0.0
        for _ in range(1000):
            even = 0.15 * sum(pi.values()) / len(names)
            new = dict.fromkeys(names, even)
            for a in names:
                total = sum(weight[a].values())
                for b, x in weight[a].items():
                    new[b] += 0.85 * pi[a] * x / total
            norm = math.sqrt(sum(x * x for x in new.values()))
            pi = {a: x / norm for a, x in new.items()}
            if before and abs(norm - before) < 1e-5:
                break
            before = norm
        want |= {(block, a): x for a, x in pi.items()}
    got = {(r.block, r.segment): r.p for r in QUERIES["segment_walk"](spark, SF).collect()}
    assert set(got) == set(want)
    assert got == pytest.approx(want, abs=1e-6)


def test_differences_are_those_of_a_sequence_matcher(spark):
    from lexaloom.operators.edits import differences

    r = random.Random(5)
    rows = [(k, [r.choice("abcdef") for _ in range(r.randint(0, 15))], [r.choice("abcdef") for _ in range(r.randint(0, 15))]) for k in range(200)]
    got = {x.edit_id: [tuple(o) for o in x.ops] for x in differences(spark.createDataFrame(rows, "edit_id long, tokens1 array<string>, tokens2 array<string>")).collect()}
    for k, a, b in rows:  # the spans rebuild the second from the first, and lie between equal stretches
        out, at = [], 0
        for i1, i2, j1, j2 in got[k]:
            assert a[at:i1] == b[len(out) : j1]
            out += a[at:i1] + b[j1:j2]
            at = i2
        assert out + a[at:] == b and all(a[i1:i2] != b[j1:j2] for i1, i2, j1, j2 in got[k])


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
