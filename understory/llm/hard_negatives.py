"""Hard-negative mining with rotated one-bit codes and residual intervals.

A vector is rotated and kept as its signs, one bit per dimension, with its length and
its alignment, the cosine between it and the corner of the cube that the signs
stand for. An anchor's product with that corner comes from popcounts over bit
planes of the rotated anchor. What the corner leaves of the vector is orthogonal to it and of
known length, so Cauchy-Schwarz bounds its part of the product: every score lies in a certain
interval. Rows whose interval can't reach the best found so far are passed
over; the others are scored in whole numbers, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from understory.sources.shared import cut_lineage

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LEAST_PERCENT, MOST_PERCENT = 80, 100  # of the positive's score
PASS_BYTES = 8_000_000  # of anchors that are sent to all tasks at once; more anchors take more passes
PLANES = 6  # bits of a rotated anchor's components
BLOCK = 1024  # dimensions rotated together
_PAIRS = 1 << 20  # pairs of a row and an anchor estimated at once
_EXACT = 2.0**52  # squared lengths below it: all products and their sums are whole in double precision
_LONG = (1 << 63) - 1

Batches = Iterator[pd.DataFrame]


@lru_cache(maxsize=16)
def _rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def rotate(rows: np.ndarray) -> np.ndarray:
    """An orthogonal map of the rows, by blocks of dimensions."""
    parts = [rows[:, lo:lo + BLOCK] for lo in range(0, rows.shape[1], BLOCK)]
    return np.concatenate([p @ _rotation(p.shape[1]) for p in parts], axis=1) if parts else rows


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    n, dim = bits.shape
    padded = np.zeros((n, max(1, -(-dim // 64)) * 64), np.uint8)
    padded[:, :dim] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _whole(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), dim)


def _encode(batches: Batches) -> Batches:
    """Codes of whole vectors; those too long for exact double arithmetic are marked."""
    for batch in batches:
        dims = batch["v"].map(len).to_numpy()
        for dim in np.unique(dims):
            part = batch[dims == dim]
            most = np.finfo(np.float64).max
            with np.errstate(over="ignore"):
                rows = np.clip(np.floor(SCALE * _whole(part["v"], dim)), -most, most)
                square = (rows**2).sum(axis=1)
            exact = square < _EXACT
            turned, norm = rotate(np.where(exact[:, None], rows, 0)), np.sqrt(np.where(exact, square, 0))
            corner = np.abs(turned).sum(axis=1)
            align = np.divide(corner, np.sqrt(max(dim, 1)) * norm, out=np.ones(len(rows)), where=norm > 0)
            yield part.drop(columns="v").assign(
                whole=list(rows), dim=int(dim), exact=exact, norm=norm, align=np.minimum(align, 1.0),
                code=list(_pack(turned > 0).view(np.int64)))


_INDEX = ("node long, vec_id long, label long, whole array<double>, dim int, exact boolean, norm double,"
          " align double, code array<long>")


class Anchors:
    """Anchors of one pass and one dimension, rotated and cut into bit planes."""

    def __init__(self, part: pd.DataFrame, dim: int):
        self.node, self.vec_id, self.label = (part[c].to_numpy(np.int64) for c in ("node", "vec_id", "label"))
        self.whole = _whole(part["whole"], dim)
        self.exact, self.dim = part["exact"].to_numpy(bool), dim
        turned = rotate(np.where(self.exact[:, None], self.whole, 0))
        self.norm = part["norm"].to_numpy(np.float64)
        low = turned.min(axis=1, initial=0)
        step = (turned.max(axis=1, initial=0) - low) / (2**PLANES - 1)
        step[step == 0] = 1
        levels = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
        self.error = np.linalg.norm(turned - (low[:, None] + step[:, None] * levels), axis=1)
        self.planes = np.stack([_pack((levels >> b) & 1) for b in range(PLANES)])
        self.low, self.step, self.total = low, step, levels.sum(axis=1)

    def corner_products(self, code: np.ndarray) -> np.ndarray:
        """Products of the quantized anchors with the corners of ``code``, by popcounts: rows by anchors."""
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        inside = np.zeros((len(code), len(self.node)), np.int64)
        for b, plane in enumerate(self.planes):
            for w in range(code.shape[1]):
                inside += np.bitwise_count(code[:, None, w] & plane[None, :, w]).astype(np.int64) << b
        signs = (2 * ones - self.dim)[:, None]
        return (self.low * signs + self.step * (2 * inside - self.total)) / np.sqrt(max(self.dim, 1))

    def intervals(self, code: np.ndarray, norm: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds between which every score lies: rows by anchors."""
        along = self.corner_products(code)
        least = np.maximum(np.abs(along) - self.error, 0)
        across = np.sqrt(np.maximum(self.norm**2 - least**2, 0))
        residual = np.sqrt(np.maximum(1 - align**2, 0))[:, None]
        half = align[:, None] * self.error + residual * across
        centre, length = align[:, None] * along, norm[:, None]
        slack = 1e-9 * length * self.norm + 1e-6
        return length * (centre - half) - slack, length * (centre + half) + slack

    def scores(self, rows: np.ndarray, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Whole-number products of pairs; both sides are exact."""
        if len(row) * 4 > len(rows) * len(self.node):
            return np.rint((rows @ self.whole.T)[row, anchor]).astype(np.int64)
        out = np.empty(len(row), np.int64)
        for lo in range(0, len(row), _PAIRS // 16):
            i, j = row[lo:lo + _PAIRS // 16], anchor[lo:lo + _PAIRS // 16]
            out[lo:lo + len(i)] = np.einsum("ij,ij->i", rows[i], self.whole[j])
        return out


def _long_score(x: np.ndarray, y: np.ndarray) -> int:
    """A product of components of any size; beyond 64 bits it counts as the largest or smallest long."""
    return max(-_LONG, min(_LONG, sum(int(a) * int(b) for a, b in zip(x, y, strict=True))))


class Best:
    """The best ``k`` (score, id) of each slot, higher scores and then smaller ids first."""

    def __init__(self, slots: int, k: int):
        self.k, self._new, self._n_new = k, [], 0
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(slots, -_LONG)  # of slots that are full

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self._new.append((slot, score, ids))
        self._n_new += len(slot)
        if self._n_new > len(self.slot) // 2:
            self.settle()

    def settle(self) -> "Best":
        """Take up what was added since."""
        slot, score, ids = (np.concatenate(p) for p in zip((self.slot, self.score, self.id), *self._new, strict=True))
        self._new, self._n_new = [], 0
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = place < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        full = place == self.k - 1
        self.least[slot[full]] = score[full]
        return self


def _scan(anchors: dict[int, Anchors], batches: Batches,
          wanted: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
          found: Callable[[int, np.ndarray, np.ndarray, np.ndarray], None]) -> None:
    """Score all pairs of rows and anchors that may matter.

    ``wanted(dim, labels, ids)`` gives, for rows with these, a mask of pairs that are asked for, and the lowest
    and highest score of use by anchor; ``found(dim, anchor, score, id)`` takes scored pairs.
    """
    for batch in batches:
        dims = batch["dim"].to_numpy()
        for dim in np.unique(dims):
            if (to := anchors.get(int(dim))) is None:
                continue
            part = batch[dims == dim]
            code = np.array(part["code"].tolist(), np.int64).view(np.uint64)
            rows, exact = _whole(part["whole"], int(dim)), part["exact"].to_numpy(bool)
            ids, labels = part["vec_id"].to_numpy(np.int64), part["label"].to_numpy(np.int64)
            norm, align = part["norm"].to_numpy(), part["align"].to_numpy()
            size = max(1, _PAIRS // len(to.node))
            for lo in range(0, len(part), size):
                at = slice(lo, lo + size)
                asked, lowest, highest = wanted(int(dim), labels[at], ids[at])
                sure = exact[at, None] & to.exact[None, :]
                low, high = to.intervals(code[at], norm[at], align[at])
                i, j = np.nonzero(asked & sure & (high >= lowest) & (low <= highest))
                found(int(dim), j, to.scores(rows[at], i, j), ids[at][i])
                i, j = np.nonzero(asked & ~sure)
                if len(i):
                    long = np.array([_long_score(rows[at][x], to.whole[y]) for x, y in zip(i, j, strict=True)], np.int64)
                    found(int(dim), j, long, ids[at][i])


def _by_dim(rows: pd.DataFrame) -> dict[int, Anchors]:
    return {int(d): Anchors(part, int(d)) for d, part in rows.groupby("dim")}


def _nearest_of_label(sent) -> Callable[[Batches], Batches]:
    """For each anchor, the task's first rows of its label: (node, score, vec_id)."""

    def run(batches: Batches) -> Batches:
        anchors = _by_dim(sent.value)
        best = {d: Best(len(a.node), POSITIVES) for d, a in anchors.items()}

        def wanted(dim: int, labels: np.ndarray, ids: np.ndarray):
            to = anchors[dim]
            asked = (labels[:, None] == to.label) & (ids[:, None] != to.vec_id)
            return asked, best[dim].least, np.full(len(to.node), np.inf)

        _scan(anchors, batches, wanted, lambda dim, j, score, ids: best[dim].add(j, score, ids))
        for dim, b in best.items():
            b.settle()
            yield pd.DataFrame({"node": anchors[dim].node[b.slot], "score": b.score, "vec_id": b.id})

    return run


def _nearest_below(sent, positives) -> Callable[[Batches], Batches]:
    """For each anchor and positive, the task's first rows of other labels within the range: (node, place, score, vec_id)."""

    def run(batches: Batches) -> Batches:
        anchors = _by_dim(sent.value)
        limits, best = {}, {}
        given = positives.value
        for dim, to in anchors.items():
            low, high = np.full((len(to.node), POSITIVES), _LONG), np.full((len(to.node), POSITIVES), -_LONG)
            slot = {n: i for i, n in enumerate(to.node.tolist())}
            for node, place, score in given:
                if node in slot:
                    low[slot[node], place - 1] = max(-_LONG, min(_LONG, -(-LEAST_PERCENT * score // MOST_PERCENT)))
                    high[slot[node], place - 1] = score
            limits[dim], best[dim] = (low, high), Best(low.size, NEGATIVES)

        def wanted(dim: int, labels: np.ndarray, ids: np.ndarray):
            to, (low, high) = anchors[dim], limits[dim]
            need = np.maximum(low, best[dim].least.reshape(low.shape)).min(axis=1)
            asked = (labels[:, None] != to.label) & (ids[:, None] != to.vec_id)
            return asked, need, high.max(axis=1)

        def found(dim: int, j: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
            low, high = limits[dim]
            fits = (score[:, None] >= low[j]) & (score[:, None] <= high[j])
            i, place = np.nonzero(fits)
            best[dim].add(j[i] * POSITIVES + place, score[i], ids[i])

        _scan(anchors, batches, wanted, found)
        for dim, b in best.items():
            b.settle()
            yield pd.DataFrame({"node": anchors[dim].node[b.slot // POSITIVES], "place": b.slot % POSITIVES + 1,
                                "score": b.score, "vec_id": b.id})

    return run


def _usable(v: str) -> str:
    return f"{v} is not null and forall({v}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    frame: DataFrame, anchors: Column, label: Column | str = "label", vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(256 x), scores are whole-number inner products. ``anchors`` says which
    rows are anchors; an anchor's positives are the first five rows of its label that have another id,
    its negatives for a positive the first five of other labels that score 80 to 100 percent of it. Higher scores come
    first, then smaller ids. Rows without id, label or vector, or with null or non-finite components, take no
    part. Vectors of different length have no score. Rows that repeat an id count each, as row and as anchor;
    rows of an anchor's own id are neither its positives nor its negatives.
    Scores beyond 64 bits count as the largest or smallest long, components beyond the range of doubles as its end. Anchors are the query set: they
    pass in blocks of bounded size over all rows, so the work is rows times anchors.
    """
    spark = frame.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    rows = frame.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                        F.col(embedding).cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    rows = rows.where("vec_id is not null and label is not null").where(_usable("v"))
    rows = rows.withColumn("node", F.monotonically_increasing_id())
    index = cut_lineage(rows.mapInPandas(_encode, f"{_INDEX}, is_anchor boolean"))
    asked = index.where("is_anchor")
    n_bytes = asked.agg(F.sum(F.col("dim") * 16 + 1024)).first()[0] or 0
    passes = -(-n_bytes // PASS_BYTES)
    turn = F.pmod(F.xxhash64("node"), F.lit(max(1, passes)))
    out = []
    for p in range(passes):
        part = asked.where(turn == p).drop("is_anchor").toPandas()
        if not len(part):
            continue
        sent = spark.sparkContext.broadcast(part)
        near = index.mapInPandas(_nearest_of_label(sent), "node long, score long, vec_id long")
        positives = cut_lineage(_first(near, ["node"], POSITIVES))
        given = spark.sparkContext.broadcast([tuple(r) for r in positives.select("node", "rank", "score").collect()])
        below = index.mapInPandas(_nearest_below(sent, given), "node long, place int, score long, vec_id long")
        mined = _first(below, ["node", "place"], NEGATIVES).select(
            "node", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        chosen = positives.select("node", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"),
                                  F.col("score").alias("positive_score"))
        out.append(cut_lineage(mined.join(chosen, ["node", "place"])))
    if not out:
        empty = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        return spark.createDataFrame([], empty)
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    names = asked.select("node", F.col("vec_id").alias("anchor_id"))
    return found.join(names, "node").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
