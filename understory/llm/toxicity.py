"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text. Both hold what recurs
in ordinary text; the toxic one ends with the strings that recur in toxic
documents and hardly anywhere else, the ordinary one with as many neutral bytes.
A window of a text that the toxic dictionary packs into fewer bytes speaks for
toxicity, by how much is read off labelled windows, and a document's windows are
weighed together by a logistic curve fitted on further labelled documents.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_TOXIC, SAMPLE_ORDINARY = 3000, 6000  # labelled documents to learn from, at most, by the order of a hash
HELD_OUT = 5  # one in so many documents is never learned from
WINDOW_WORDS = 8
BASE_BYTES = 32_768
DISTINCT_BYTES = 2048
STRING_LENGTHS = range(5, 14)  # with the space before the word
LEAST_DOCUMENTS = 4
LEAST_SHARE = 0.02  # of toxic documents that a string of the toxic dictionary is in
LEAST_LIFT = 10  # times as common in toxic documents as in ordinary ones
LEAST_DEVIATION = 5  # standard deviations that the toxic count is above the expected one
SAVINGS = range(-16, 16)  # bytes, beyond which savings count as these


def windows(text: str) -> list[bytes]:
    """Runs of eight lower-case words; together they are the whole text."""
    words = text.lower().split()
    return [
        f" {' '.join(words[i:i + WINDOW_WORDS])} ".encode("utf-8", "surrogatepass")
        for i in range(0, len(words), WINDOW_WORDS)
    ]


def _beginnings(text: str) -> set[str]:
    """The shortest strings that a text's words begin with."""
    return {f" {word} "[:STRING_LENGTHS[0]] for word in text.lower().split()}


def _strings(text: str, beginnings: set[str]) -> set[str]:
    """Beginnings of a text's words, and the words themselves, with the spaces around them; only those that begin so."""
    out = set()
    for word in set(text.lower().split()):
        padded = f" {word} "
        if padded[:STRING_LENGTHS[0]] in beginnings:
            out.update(padded[:n] for n in STRING_LENGTHS if n < len(padded))
            if len(padded) <= 2 * STRING_LENGTHS[-1]:
                out.add(padded)
    return out


def distinct_strings(toxic: list[str], ordinary: list[str]) -> bytes:
    """What marks toxic documents, the most telling last, where a window finds it at the least cost."""
    least = max(LEAST_DOCUMENTS, LEAST_SHARE * len(toxic))
    # a string is in no more documents than its beginning, which saves counting most
    common = {s for s, c in Counter(s for t in toxic for s in _beginnings(t)).items() if c >= least}
    counts = {s: c for s, c in Counter(s for t in toxic for s in _strings(t, common)).items() if c >= least}
    common = {s[:STRING_LENGTHS[0]] for s in counts}
    other = Counter(s for t in ordinary for s in _strings(t, common) & counts.keys())
    telling = []
    for s, c in counts.items():
        expected = (other[s] + 0.5) / len(ordinary) * len(toxic)
        deviation = (c - expected) / math.sqrt(expected + 1)
        if c >= LEAST_LIFT * expected and deviation > LEAST_DEVIATION:
            telling.append((c * len(s.encode("utf-8", "surrogatepass")), s))
    picked: list[str] = []
    size = 0
    for _, s in sorted(telling, reverse=True):
        if not any(s.startswith(p) or p.startswith(s) for p in picked):
            size += len(s.encode("utf-8", "surrogatepass"))
            if size > DISTINCT_BYTES:
                break
            picked.append(s)
    return "".join(reversed(picked)).encode("utf-8", "surrogatepass")


def _common(ordinary: list[str]) -> bytes:
    """A dictionary trained on ordinary windows; their plain text where they are too few to train on."""
    sizes = [-(-len(t.split()) // WINDOW_WORDS) for t in ordinary]
    chosen = set(np.random.default_rng(0).permutation(sum(sizes))[:100_000].tolist())
    samples, at = [], 0
    for text, n in zip(ordinary, sizes, strict=True):
        samples += [w for i, w in enumerate(windows(text), at) if i in chosen]
        at += n
    samples = [samples[i] for i in np.random.default_rng(1).permutation(len(samples))]
    try:
        return zstd.train_dictionary(BASE_BYTES * 2, samples, k=32, d=8).as_bytes()[-BASE_BYTES:]
    except zstd.ZstdError:
        return b"".join(samples)[:BASE_BYTES]


def _packer(content: bytes):
    dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    how = zstd.ZstdCompressionParameters.from_level(
        5, source_size=64, dict_size=len(content), min_match=3, strategy=zstd.STRATEGY_BTOPT,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS)
    dictionary.precompute_compress(compression_params=how)
    return zstd.ZstdCompressor(compression_params=how, dict_data=dictionary).compress


@dataclass
class Model:
    """Bounded by the constants above, whatever the corpus."""

    ordinary: bytes
    toxic: bytes
    evidence: np.ndarray = field(default_factory=lambda: np.zeros(len(SAVINGS)))  # by savings
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))  # of the features and a constant
    prior: float = 0.0
    fitted: bool = False  # whether the weights were learned from documents of both kinds

    def __post_init__(self):
        self._packers = None

    def __getstate__(self):
        return {**self.__dict__, "_packers": None}

    def savings(self, text: str) -> np.ndarray:
        """How many windows save how many bytes under the toxic dictionary."""
        if self._packers is None:
            self._packers = _packer(self.ordinary), _packer(self.toxic)
        plain, toxic = self._packers
        found = [len(plain(w)) - len(toxic(w)) for w in windows(text)]
        clipped = np.clip(np.array(found, int), SAVINGS[0], SAVINGS[-1]) - SAVINGS[0]
        return np.bincount(clipped, minlength=len(SAVINGS))

    def features(self, counts: np.ndarray) -> np.ndarray:
        n = counts.sum()
        present = self.evidence[counts > 0]
        total = float(counts @ self.evidence)
        return np.array([total / n, np.tanh(total / 10), present.max(), present.max() * math.log1p(n), math.log1p(n), 1.0])

    def score(self, text: str | None, wordless: float | None = None) -> float:
        counts = self.savings(text) if text else np.zeros(0)
        if not counts.sum():
            return self.prior if wordless is None else wordless
        return float(1 / (1 + np.exp(-np.clip(self.features(counts) @ self.weights, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a slight ridge, on standardized features; the last column is the constant."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    mean[-1], spread[-1] = 0, 1
    z, w = (x - mean) / spread, np.zeros(x.shape[1])
    ridge = np.eye(len(w)) * 0.5
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
    out = w / spread
    out[-1] -= (w[:-1] * mean[:-1] / spread[:-1]).sum()
    return out


def _log_odds(share: float) -> float:
    return math.log(max(share, 1e-6) / max(1 - share, 1e-6))


def train(toxic: list[str], ordinary: list[str], prior: float) -> Model:
    """Six tenths of either list make the dictionaries, two the evidence of savings, two the curve."""
    toxic, ordinary = list(dict.fromkeys(filter(None, toxic))), list(dict.fromkeys(filter(None, ordinary)))
    cuts = [(x[: len(x) * 6 // 10], x[len(x) * 6 // 10: len(x) * 8 // 10], x[len(x) * 8 // 10:]) for x in (toxic, ordinary)]
    (t1, t2, t3), (o1, o2, o3) = cuts
    if min(map(len, (t1, t2, t3, o1, o2, o3))) == 0:
        model = Model(b"\x01", b"\x01", prior=prior)
        model.weights[-1] = _log_odds(prior)
        return model
    base, telling = _common(o1), distinct_strings(t1, o1)
    model = Model(base + b"\x01" * max(1, len(telling)), base + (telling or b"\x01"), prior=prior)
    seen = [sum((model.savings(t) for t in part), np.zeros(len(SAVINGS))) for part in (o2, t2)]
    shares = [(s + 0.5) / (s.sum() + 0.5 * len(s)) for s in seen]
    model.evidence = np.log(shares[1] / shares[0])
    rows = [(model.features(c), y) for part, y in ((t3, 1), (o3, 0)) for t in part if (c := model.savings(t)).sum()]
    if len({y for _, y in rows}) == 2:
        # documents of either kind count as often as they occur among the labelled
        x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
        model.weights, model.fitted = _logistic(x, y), True
        model.weights[-1] += _log_odds(prior) - _log_odds(y.mean())
    else:
        model.weights[-1] = _log_odds(prior)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the document is left out of learning; rows without an id are not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled documents that are not held out; a bounded number of either kind.

    The sample is learned from in one task, which returns the model; no text comes
    to the driver. Labels that are null or neither 0 nor 1 are not used; of several labels of
    one document the largest counts.
    """
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(n.values())
    prior = n.get(1, 0) / total if total else 0.0

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(order=rows["doc_id"].map(hash_order), text=rows["text"].fillna("")).sort_values(["order", "text"])
        texts = [rows.loc[rows["toxic"] == kind, "text"].tolist() for kind in (1, 0)]
        return pd.DataFrame({"model": [pickle.dumps(train(*texts, prior))]})

    picked = [
        known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for kind, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY))
    ]
    sample = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    learned = sample.groupBy().applyInPandas(learn, "model binary").first()
    return pickle.loads(learned["model"]) if learned else train([], [], prior)


def hash_order(doc_id: int) -> int:
    """An order that has nothing to do with the documents'."""
    return (doc_id * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 64) >> 16


def toxicity_score(docs: DataFrame, model: Model, text: str = "text", wordless: float | None = None) -> Column:
    """The chance of label 1; texts without a word get ``wordless`` or the labelled share, as does any text without a model."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(t, wordless) for t in texts], dtype="float64")

    return score(F.coalesce(F.col(text), F.lit("")))
