"""Toxicity: a logistic classifier on word and word-prefix features with a counterfactual penalty.

Labelled texts that name a group are copied with the identity terms swapped for others of their set;
the fit penalises the squared change of the score, so that a neutral mention carries no weight.

The classifier is fitted on the driver from at most SAMPLE labelled ids, the first by a hash of them, and
has weights for the KEEP features with the most evidence at most (a bounded sample is all that a few
thousand weights need). Executors count the features; only those kept go to the driver. Every row is
scored on its whole text.

Defined results: null, empty and letterless texts score as a text without features; labels of null
ids or null toxic are ignored, of several labels for an id the largest counts; ids that repeat are
scored each; without labels of both kinds every score is the share of toxic labels (0 if none);
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, small_batches, utf8

SAMPLE = 10_000
PREFIX = 4
KEEP, EVIDENCE = 4096, 24.0
THRESHOLD = 0.3
MEMORY = 100_000  # words that a scorer remembers before it starts again

# Sets of identity terms that may stand for each other.
IDENTITY = [
    ["women", "men"],
    ["woman", "man"],
    ["girls", "boys"],
    ["female", "male"],
    ["christian", "muslim", "jewish", "hindu", "buddhist"],
    ["christians", "muslims", "jews", "hindus", "buddhists"],
    ["black", "white", "asian", "latino"],
    ["gay", "straight", "lesbian", "bisexual"],
    ["immigrants", "natives", "refugees"],
    ["disabled", "deaf", "blind"],
    ["old", "young"],
]


def swaps(terms: Sequence[Sequence[str]] = IDENTITY) -> dict[bytes, bytes]:
    """For each term the next of its set; terms are lower-case words, of any language."""
    return {w.lower().encode(): s[(k + 1) % len(s)].lower().encode() for s in terms for k, w in enumerate(s) if len(s) > 1}


_LETTERS = re.compile(rb"[a-z\x80-\xff]+")


def tokens(data: bytes | None) -> set[bytes]:
    return set(_LETTERS.findall(data.lower())) if data else set()


def word_features(word: bytes) -> tuple[int, int]:
    return xxhash.xxh32_intdigest(word), xxhash.xxh32_intdigest(b"^" + word[:PREFIX])


def text_features(words: set[bytes]) -> np.ndarray:
    return np.unique(np.array([f for w in words for f in word_features(w)], np.uint32))


def swapped(words: set[bytes], swap: dict[bytes, bytes]) -> set[bytes] | None:
    """The words with identity terms swapped; None where there are none."""
    return {swap.get(w, w) for w in words} if words & swap.keys() else None


@dataclass
class ToxicityModel:
    bias: float = -30.0
    weights: dict[int, float] = field(default_factory=dict)
    pairs: int = 0  # labelled texts with identity terms, whose swapped copies the fit used

    def scorer(self):
        """A function from text bytes to the score; words without weights are remembered as such."""
        weights, memory = self.weights, {}

        def of(word: bytes) -> tuple[int, ...]:
            found = tuple(f for f in word_features(word) if f in weights)
            if len(memory) >= MEMORY:
                memory.clear()
            memory[word] = found
            return found

        def score(data: bytes | None) -> float:
            hits: set[int] = set()
            for w in tokens(data):
                f = memory.get(w)
                if f is None:
                    f = of(w)
                if f:
                    hits.update(f)
            z = self.bias + sum(weights[f] for f in sorted(hits))
            return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))

        return score


def fit(rows: list[tuple[np.ndarray, np.ndarray | None, int]], *, l2: float = 1e-4, counterfactual: float = 1.0, steps: int = 1000) -> ToxicityModel:
    """rows: (features, features with terms swapped or None, label)."""
    y = np.array([r[2] for r in rows], np.float64)
    rate = float(y.mean()) if len(y) else 0.0
    if not 0 < rate < 1:
        return ToxicityModel(bias=30.0 if rate else -30.0)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    names, ids = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    ids = ids.astype(np.int32)
    df, pos = np.bincount(ids, minlength=len(names)), np.bincount(ids[y[row] == 1], minlength=len(names))
    some = np.flatnonzero(df >= 3)
    n, n1 = len(y), y.sum()
    expected = df[some] * (n1 / n)
    chi2 = (pos[some] - expected) ** 2 / np.maximum(expected * (1 - df[some] / n) * (1 - n1 / n), 1e-9)
    told = chi2 >= EVIDENCE  # about what the best of many thousand features without meaning reaches
    some, chi2 = some[told], chi2[told]
    kept = names[np.sort(some[np.lexsort((some, -chi2))[:KEEP]])]
    if not len(kept):
        return ToxicityModel(bias=float(np.log(rate / (1 - rate))))

    def compact(row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(kept, ids)
        ok = (at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == ids)
        return row[ok], at[ok]

    r, c = compact(row, names[ids])
    del ids, row, names
    pairs = [(k, x) for k, x in enumerate(rows) if x[1] is not None]
    changes = [(np.setdiff1d(a, b), np.setdiff1d(b, a)) for _, (a, b, _) in pairs]
    plus = compact(np.repeat(np.arange(len(pairs)), [len(a) for a, _ in changes]), np.concatenate([a for a, _ in changes] or [np.empty(0, np.uint32)]))
    minus = compact(np.repeat(np.arange(len(pairs)), [len(b) for _, b in changes]), np.concatenate([b for _, b in changes] or [np.empty(0, np.uint32)]))
    w, b = np.zeros(len(kept)), float(np.log(rate / (1 - rate)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = b + np.bincount(r, w[c], minlength=n)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        gw = np.bincount(c, g[r], minlength=len(w)) + l2 * w / 10
        if pairs:
            d = np.bincount(plus[0], w[plus[1]], minlength=len(pairs)) - np.bincount(minus[0], w[minus[1]], minlength=len(pairs))
            d = d * (2 * counterfactual / len(pairs))  # whole numbers where no swapped word has a weight
            gw += np.bincount(plus[1], d[plus[0]], minlength=len(w)) - np.bincount(minus[1], d[minus[0]], minlength=len(w))
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        b -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    big = np.abs(w) > 1e-3
    return ToxicityModel(float(b), dict(zip(kept[big].tolist(), w[big].tolist(), strict=True)), len(pairs))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic (0 or 1) of the texts of at most `sample` labelled ids that aren't held out; the ids (8 bytes each) are broadcast."""
    chosen = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))


def telling_features(texts: DataFrame, n: int, n1: int) -> np.ndarray:
    """The KEEP features with the most evidence, as fit() keeps them of n texts, n1 of them toxic; counted by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [text_features(tokens(x)) for x in utf8(b.column(0))]
            toxic = np.repeat(b.column(1).to_numpy().astype(np.int64), [len(f) for f in found])
            names, ids = np.unique(np.concatenate([*found, np.empty(0, np.uint32)]), return_inverse=True)
            df, pos = np.bincount(ids, minlength=len(names)), np.bincount(ids[toxic == 1], minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (names, df, pos)], names=["feature", "df", "pos"])

    counts = texts.mapInArrow(released(run), "feature long, df long, pos long").groupBy("feature").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos")).where("df >= 3")
    expected, one = F.col("df") * F.lit(n1 / n), F.lit(1.0)
    gap = F.col("pos") - F.col("expected")
    spread = F.col("expected") * (one - F.col("df") / F.lit(float(n))) * F.lit(1 - n1 / n)
    told = counts.withColumn("expected", expected).withColumn("chi2", gap * gap / F.greatest(spread, F.lit(1e-9))).where(F.col("chi2") >= EVIDENCE)
    return np.sort(np.array([r[0] for r in told.orderBy(F.desc("chi2"), "feature").select("feature").limit(KEEP).collect()], np.uint32))


def labelled_features(texts: DataFrame, kept: np.ndarray, terms: Sequence[Sequence[str]] = IDENTITY) -> DataFrame:
    """features, swapped, toxic of labelled texts, with the kept features alone."""
    swap = swaps(terms)

    def of(words: set[bytes]) -> bytes:
        return np.intersect1d(text_features(words), kept, assume_unique=True).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [tokens(x) for x in utf8(b.column(0))]
            other = [swapped(x, swap) for x in words]
            yield pa.RecordBatch.from_arrays([pa.array([of(x) for x in words], pa.binary()), pa.array([None if x is None else of(x) for x in other], pa.binary()), b.column(1)], names=["features", "swapped", "toxic"])

    return texts.mapInArrow(released(run), "features binary, swapped binary, toxic int")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, *, terms: Sequence[Sequence[str]] = IDENTITY, counterfactual: float = 1.0) -> ToxicityModel:
    """The driver gets no features but those that the fit keeps, so that long texts and ids that repeat don't fill it."""
    small_batches(docs.sparkSession)
    texts = labelled_texts(docs, labels, sample)
    n, n1 = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    kept = telling_features(texts, n, n1) if 0 < n1 < n else np.empty(0, np.uint32)
    if not len(kept):
        return ToxicityModel(bias=float(np.log(n1 / (n - n1))) if 0 < n1 < n else 30.0 if n1 else -30.0)
    columns = [c.to_pylist() for c in labelled_features(texts, kept, terms).toArrow().columns]
    rows = [(np.frombuffer(f, np.uint32), None if s is None else np.frombuffer(s, np.uint32), t) for f, s, t in zip(*columns, strict=True)]
    return fit(sorted(rows, key=lambda r: (r[2], r[0].tobytes(), r[1] is not None, b"" if r[1] is None else r[1].tobytes())), counterfactual=counterfactual)


def scored(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and score for every row of docs, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([score(x) for x in utf8(b.column(b.num_columns - 1))], pa.float64())], names=[*keep, "score"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(released(run), ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "score double"]))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, *, terms: Sequence[Sequence[str]] = IDENTITY, counterfactual: float = 1.0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. terms: sets of identity words that may stand for each other."""
    return scored(docs, train(docs, labels, sample, terms=terms, counterfactual=counterfactual)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
