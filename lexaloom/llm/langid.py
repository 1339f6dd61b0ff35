"""Language ID: interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

Texts are lower-cased and whatever is not a letter counts as a space. For each GROUP of languages, each
order keeps one sorted array of n-gram hashes with the interpolated probability under every language of
the group, so the arrays grow with the languages' n-grams alone; n-grams that no language of a group has
seen back off through the same arrays. A symbol has 16 bits; letters beyond the first 65,534 that the
training texts have share symbols by a hash. The language of the lowest cross-entropy per
character wins; a text whose cross-entropy lies far above what its language's own texts have is
marked `rejected` (the limit is calibrated on the training texts) and its score is halved.

The models are fitted on the driver from about PER_LANGUAGE texts of each language, chosen by a hash
of the id; every row is judged on its whole text.

Defined results: null texts and texts without a letter are `und` with score 0; null languages and held
out or null ids are never learned from; without anything to learn all is `und`; equal entropies go to
the first language by code point; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_batches
from .toxicity import held_out

ORDER, BITS = 4, 16
GROUP = 8
DISCOUNT = 0.75
PER_LANGUAGE = 400
SHARPNESS = 8.0
_M = np.uint64(0x9E3779B97F4A7C15)


def hashed(codes: np.ndarray) -> np.ndarray:
    """A one-to-one mix of packed n-grams."""
    h = codes.astype(np.uint64) * _M
    return (h ^ (h >> np.uint64(32))) * _M


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


_SHIFT = np.uint64(BITS)


def low(codes: np.ndarray, symbols: int) -> np.ndarray:
    """The last symbols of packed n-grams."""
    return codes & np.uint64((1 << BITS * symbols) - 1)


class Tables:
    """The sorted hash arrays of a group of languages: for each order, n-grams with their interpolated probabilities, and contexts with the weight of the next lower order; a column for each language."""

    def __init__(self, languages: int, floor: float):
        self.languages, self.floor = languages, floor
        self.keys: list[np.ndarray] = []
        self.probs: list[np.ndarray] = []
        self.context_keys: list[np.ndarray] = []
        self.back_off: list[np.ndarray] = []

    def prob(self, order: int, codes: np.ndarray) -> np.ndarray:
        if not order:
            return np.full((len(codes), self.languages), self.floor)
        keys, h = self.keys[order - 1], hashed(codes)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        p = self.probs[order - 1][at]
        miss = np.flatnonzero(keys[at] != h)
        if len(miss):
            p[miss] = self.weights(order, codes[miss] >> _SHIFT) * self.prob(order - 1, low(codes[miss], order - 1))
        return p

    def weights(self, order: int, contexts: np.ndarray) -> np.ndarray:
        keys, h = self.context_keys[order - 1], hashed(contexts)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where((keys[at] == h)[:, None], self.back_off[order - 1][at], 1.0)

    def add(self, grams: np.ndarray, p: np.ndarray, contexts: np.ndarray, weight: np.ndarray) -> None:
        for codes, values, keys, kept in ((grams, p, self.keys, self.probs), (contexts, weight, self.context_keys, self.back_off)):
            h = hashed(codes)
            o = np.argsort(h)
            keys.append(h[o])
            kept.append(values[o])


@dataclass
class LanguageModel:
    languages: list[str]
    symbols: np.ndarray  # a symbol for each code point: 0 for all but letters, 1 for letters never seen
    groups: list[Tables]
    limits: np.ndarray | None = None

    def _prob(self, order: int, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([g.prob(order, codes) for g in self.groups], axis=1)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language (nats), and whether it has a letter."""
        out, known = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        k = 0
        while k < len(texts):  # about a million characters at once
            parts, n = [], 0
            first = k
            while k < len(texts) and (n < 1_000_000 or not parts):
                s = self.symbols[code_points(texts[k] or "")]
                known[k] = s.any()
                parts.append(s)
                n += len(s)
                k += 1
            if not n:
                continue
            pad = np.zeros(ORDER - 1, np.uint64)
            codes = np.concatenate([grams(np.concatenate([pad, p]), ORDER) for p in parts])
            sizes = np.array([len(p) for p in parts])
            nll = np.zeros((len(parts), len(self.languages)))
            some = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[some]
            nll[some] = np.add.reduceat(-np.log(self._prob(ORDER, codes)), starts, axis=0)
            out[first:k] = nll / np.maximum(sizes, 1)[:, None]
        return out, known

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        e, known = self.entropies(texts)
        best = e.argmin(1)
        lowest = e[np.arange(len(e)), best]
        share = 1 / np.exp(-SHARPNESS * np.minimum(e - lowest[:, None], 10)).sum(1)
        rejected = ~known | (lowest > self.limits[best] if self.limits is not None else False)
        score = np.where(known, share * np.where(rejected, 0.5, 1.0), 0.0)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, known, strict=True)], score.tolist(), rejected.tolist()


def grams(symbols: np.ndarray, n: int) -> np.ndarray:
    """Packed n-grams, one for each place from the n-th on."""
    codes = np.zeros(max(0, len(symbols) - n + 1), np.uint64)
    for k in range(n):
        codes = codes << _SHIFT | symbols[k : len(symbols) - n + 1 + k]
    return codes


def fit(rows: list[tuple[str, str]]) -> LanguageModel:
    """rows: (language, text)."""
    rows = sorted((lang, text) for lang, text in rows if text)
    languages = sorted({lang for lang, _ in rows})
    points = {lang: [code_points(t) for g, t in rows if g == lang] for lang in languages}
    seen = np.unique(np.concatenate([p for v in points.values() for p in v])) if rows else np.empty(0, np.uint32)
    letters = np.array([c for c in seen.tolist() if chr(c).isalpha()], np.int64)
    most = (1 << BITS) - 2
    symbols = np.fromiter((int(chr(c).isalpha()) for c in range(0x110000)), np.uint64, 0x110000)
    symbols[letters] = np.r_[np.arange(len(letters[:most])), letters[most:] * 0x9E3779B1 % most].astype(np.uint64) + np.uint64(2)
    model = LanguageModel(languages, symbols, [])
    if not languages:
        return model
    pad = np.zeros(ORDER - 1, np.uint64)
    for start in range(0, len(languages), GROUP):
        group = languages[start : start + GROUP]
        tables = Tables(len(group), 1.0 / (min(len(letters), most) + 2))
        counted = {}
        for lang in group:  # counts of the highest order; below, how many different symbols come before
            codes, n = np.unique(np.concatenate([grams(np.concatenate([pad, symbols[p]]), ORDER) for p in points[lang]]), return_counts=True)
            counted[lang, ORDER] = codes, n
            for k in range(ORDER - 1, 0, -1):
                codes, n = np.unique(low(codes, k), return_counts=True)
                counted[lang, k] = codes, n
        for k in range(1, ORDER + 1):
            every = np.unique(np.concatenate([counted[lang, k][0] for lang in group]))
            contexts = np.unique(every >> _SHIFT)
            weight, p = np.ones((len(contexts), len(group))), np.zeros((len(every), len(group)))
            for j, lang in enumerate(group):
                codes, n = counted[lang, k]
                at = np.searchsorted(contexts, codes >> _SHIFT)
                total, kinds = np.bincount(at, n, minlength=len(contexts)), np.bincount(at, minlength=len(contexts))
                some = total > 0
                weight[some, j] = DISCOUNT * kinds[some] / total[some]
                p[np.searchsorted(every, codes), j] = (n - DISCOUNT) / total[at]
            p += weight[np.searchsorted(contexts, every >> _SHIFT)] * tables.prob(k - 1, low(every, k - 1))
            tables.add(every, p, contexts, weight)
        model.groups.append(tables)
    e, known = model.entropies([t for _, t in rows])
    own = np.array([languages.index(g) for g, _ in rows])
    e = e[np.arange(len(rows)), own]
    limits = []
    for j in range(len(languages)):
        x = e[(own == j) & known]
        limits.append(float(np.quantile(x, 0.99) + 2 * x.std() + 0.1) if len(x) else np.inf)
    model.limits = np.array(limits)
    return model


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang, text of about per_language rows of each language, chosen by a hash of the id."""
    known = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003).select("lang", "text")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    got = training_rows(docs, per_language).toArrow()
    return fit(list(zip(got["lang"].to_pylist(), got["text"].to_pylist(), strict=True)))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of docs."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, rejected = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")


def identify_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs."""
    return identify(docs, train(docs, per_language)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
