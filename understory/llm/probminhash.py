"""Near-duplicate documents by ProbMinHash: weighted shingles, banding, exact verification.

A document is its five-word shingles, weighted by how often each occurs. Every
shingle starts a Poisson process whose rate is its weight; each arrival goes to
a random register, which keeps the shingle of its earliest arrival. Two documents
agree in a register with a chance equal to their probability Jaccard similarity.
Arrivals later than the latest register can't change anything, so a document
stops early. Bands of registers propose groups; inside a proposed group every
pair is verified on the shingles themselves, block against block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.llm.components import components
from understory.llm.keys import join_by_frequency, with_ids
from understory.llm.words import hash_words, in_chunks, mix, shingles
from understory.sources.shared import cut_lineage

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4  # a pair at similarity 0.8 misses all bands with chance 3e-5
BLOCK_DOCS, BLOCK_WORDS = 256, 200_000  # of one side of a verification task
_COLUMNS = 16_384  # shingles of a block compared at a time


def weighted_shingles(hashes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) and their counts, by text; ``texts`` ascends."""
    order = np.lexsort((hashes, texts))
    h, t = hashes[order], texts[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return h[at], t[at], np.diff(np.append(at, len(h)))


def prob_min_hash(elements: np.ndarray, sets: np.ndarray, weights: np.ndarray, n_sets: int, registers: int) -> np.ndarray:
    """Registers of every set as an array (n_sets, registers) of elements; a set without elements has zeros."""
    earliest = np.full(n_sets * registers, np.inf)
    holder = np.zeros(n_sets * registers, np.uint64)
    now = np.zeros(len(elements))
    e, s, w = elements, sets, weights.astype(np.float64)
    arrival = 0
    while len(e):
        arrival += 1
        seed = mix(np.array([arrival], np.uint64))[0]
        u = mix(e ^ seed)
        now = now - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / w
        slot = s * registers + (mix(u) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, slot, now)
        first = earliest[slot] == now
        holder[slot[first]] = e[first]
        latest = earliest.reshape(n_sets, registers).max(axis=1)
        alive = now < latest[s]
        e, s, w, now = e[alive], s[alive], w[alive], now[alive]
    return holder.reshape(n_sets, registers)


def _band_keys(registers: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(registers), BANDS), np.uint64)
    rows = registers.reshape(len(registers), BANDS, ROWS)
    for r in range(ROWS):
        keys = mix(keys + rows[:, :, r])
    return mix(keys ^ np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def content_key(words: np.ndarray, text: str | None) -> bytes | None:
    """Equal for texts of equal words; by the text itself where it has no word; none for empty texts."""
    if len(words):
        return hashlib.blake2b(words.tobytes(), digest_size=16).digest()
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest() if text else None


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lo, hi in in_chunks(texts := batch["text"].tolist()):
            part = texts[lo:hi]
            words = hash_words(part)
            hashes, _, owner = shingles(words, WIDTH)
            elements, sets, weights = weighted_shingles(hashes, owner)
            bands = _band_keys(prob_min_hash(elements, sets, weights, len(part), BANDS * ROWS))
            size = np.diff(words.first)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].to_numpy()[lo:hi],
                "content": [content_key(words.of(i), t) for i, t in enumerate(part)],
                "n_words": size,
                "bands": [b if n >= WIDTH else [] for b, n in zip(bands, size, strict=True)],
            })


def probability_jaccard(x: dict[int, int], y: dict[int, int]) -> float:
    """Sum over shared elements i of 1 / sum_j max(x_j/x_i, y_j/y_i); plain Jaccard where all weights are equal."""
    keys = list(x.keys() | y.keys())
    a = np.array([x.get(k, 0) for k in keys], float)
    b = np.array([y.get(k, 0) for k in keys], float)
    return _pj(a, b)


def _pj(a: np.ndarray, b: np.ndarray) -> float:
    with np.errstate(divide="ignore"):
        ratio = a / b
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    lo = np.searchsorted(ratio, ratio, "left")
    above = np.append(np.cumsum(a[::-1])[::-1], 0.0)[lo]
    below = np.insert(np.cumsum(b), 0, 0.0)[lo]
    shared = (a > 0) & (b > 0)
    return float(np.sum(1.0 / (above[shared] / a[shared] + below[shared] / b[shared])))


class _Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def linked_rows(left: list[int], right: list[int], ids: np.ndarray, owner: np.ndarray, counts: np.ndarray,
                n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows ``left`` and ``right`` of one block pair.

    ``ids, owner, counts`` are the distinct shingles of all rows, by row. A pair's
    similarity is at most the share of either document's weight that lies on
    common shingles; pairs that reach it that way are verified exactly.
    """
    total = np.bincount(owner, counts, n)
    distinct = np.bincount(owner, minlength=n)
    same = np.bincount(owner, counts != 1, n) == 0  # all weights one
    vocabulary, code, df = np.unique(ids, return_inverse=True, return_counts=True)
    shared = df[code] > 1
    column = np.cumsum(df > 1)[code[shared]] - 1
    row, mass = owner[shared], counts[shared]
    left_at, right_at = np.full(n, -1), np.full(n, -1)
    left_at[left], right_at[right] = np.arange(len(left)), np.arange(len(right))
    of_left = np.zeros((len(left), len(right)))
    of_right = np.zeros((len(left), len(right)))
    for lo in range(0, int(column.max(initial=-1)) + 1, _COLUMNS):
        here = (column >= lo) & (column < lo + _COLUMNS)
        width = min(_COLUMNS, int(column.max()) + 1 - lo)
        mats = []
        for at, size in ((left_at, len(left)), (right_at, len(right))):
            mine = here & (at[row] >= 0)
            r, c = at[row[mine]], column[mine] - lo
            there, weight = np.zeros((size, width), np.float32), np.zeros((size, width), np.float32)
            there[r, c], weight[r, c] = 1, mass[mine]
            mats.append((there, weight))
        (there_l, weight_l), (there_r, weight_r) = mats
        of_left += weight_l @ there_r.T
        of_right += there_l @ weight_r.T
    tl, tr = total[left][:, None], total[right][None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        near = (of_left >= (SIMILARITY - 1e-6) * tl) & (of_right >= (SIMILARITY - 1e-6) * tr)
        plain = same[left][:, None] & same[right][None, :]
        jaccard = of_left / (distinct[left][:, None] + distinct[right][None, :] - of_left)
    forest, links = _Forest(n), []
    sure = np.argwhere(near & plain & (jaccard >= SIMILARITY))
    for i, j in sure.tolist():
        if forest.join(left[i], right[j]):
            links.append((left[i], right[j]))
    first = np.searchsorted(owner, np.arange(n + 1))
    for i, j in np.argwhere(near & ~plain).tolist():
        x, y = left[i], right[j]
        if forest.root(x) != forest.root(y):
            sx, sy = slice(first[x], first[x + 1]), slice(first[y], first[y + 1])
            keys = np.union1d(ids[sx], ids[sy])
            a, b = np.zeros(len(keys)), np.zeros(len(keys))
            a[np.searchsorted(keys, ids[sx])], b[np.searchsorted(keys, ids[sy])] = counts[sx], counts[sy]
            if _pj(a, b) >= SIMILARITY:
                forest.join(x, y)
                links.append((x, y))
    return links


def _verify(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    _, low, high = key
    texts = group["text"].tolist()
    words = hash_words(texts)
    right_text = [content_key(words.of(i), t) == c for i, (t, c) in enumerate(zip(texts, group["content"], strict=True))]
    rows = group.assign(at=range(len(group)))[right_text].drop_duplicates("node")
    hashes, _, owner = shingles(words, WIDTH)
    ids, owner, counts = weighted_shingles(hashes, owner)
    left = rows.loc[rows["block"] == low, "at"].tolist()
    right = left if low == high else rows.loc[rows["block"] == high, "at"].tolist()
    nodes = group["node"].to_numpy()
    links = linked_rows(left, right, ids, owner, counts, len(group)) if left and right else []
    return pd.DataFrame({"a": [nodes[i] for i, _ in links], "b": [nodes[j] for _, j in links]}, dtype="int64")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, component_id, kept), one row for every row of ``docs``.

    ``class_id`` is the smallest doc_id whose text has the same words;
    ``component_id`` the smallest one reachable by links of probability Jaccard
    similarity 0.8 or more; ``kept`` marks the smallest. Texts under five words
    link to equal ones only. Empty and null texts, and rows without a doc_id,
    belong to no group: they are their own class and are kept.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = cut_lineage(rows.mapInPandas(_sketches, "doc_id long, content binary, n_words long, bands array<long>"))
    grouped = sketches.where("doc_id is not null and content is not null")
    classes = grouped.groupBy("content").agg(
        F.min("doc_id").alias("class_id"), F.max("n_words").alias("n_words"), F.any_value("bands").alias("bands"))
    classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()))
    proposed = _proposed_groups(classes)
    links = _verified_links(rows, classes, proposed)
    found = components(links)
    of_class = classes.select("content", "class_id", "node").join(found, "node", "left").select(
        "content", "class_id", F.coalesce("component", "node").alias("component"))
    smallest = of_class.groupBy("component").agg(F.min("class_id").alias("component_id"))
    of_class = cut_lineage(of_class.join(smallest, "component").select("content", "class_id", "component_id"))
    alone = F.col("doc_id").isNull() | F.col("content").isNull()
    out = sketches.select("doc_id", F.when(~alone, F.col("content")).alias("content")).join(of_class, "content", "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
                     F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _proposed_groups(classes: DataFrame) -> DataFrame:
    """(node, proposed) for classes that share a band with another; groups are joined through their smallest node."""
    banded = classes.select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(
        F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("n")).where("hub != last").drop("last")
    star = join_by_frequency(banded, cut_lineage(hubs), "band", "n").where("node != hub").select("node", "hub").distinct()
    return components(star, "node", "hub").withColumnRenamed("component", "proposed")


def _verified_links(rows: DataFrame, classes: DataFrame, proposed: DataFrame) -> DataFrame:
    members = cut_lineage(proposed.join(classes.select("node", "class_id", "content", "n_words"), "node"))
    size = members.groupBy("proposed").agg(F.count("*").alias("n"), F.sum("n_words").alias("w")).select(
        "proposed",
        F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("w") / BLOCK_WORDS)).cast("int").alias("blocks"))
    placed = members.join(size, "proposed").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "class_id", "node", "content", "proposed", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    # only texts of proposed classes move, at any size by the same kind of join
    wanted = with_ids(rows, members.select("class_id"))
    texts = wanted.join(meets.hint("merge"), wanted["doc_id"] == meets["class_id"]).select(
        "node", "content", "text", "proposed", "block", "low", "high")
    return texts.groupBy("proposed", "low", "high").applyInPandas(_verify, "a long, b long")
