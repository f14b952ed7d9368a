"""Benchmark items inside documents: size-partitioned MinHash containment search.

Whole documents are far longer than test items, so a document is searched in
overlapping windows. Items are partitioned by size (powers of two); for each
partition the windows are twice its size and step by its size, so an item that
is present lies in a window of like size and their Jaccard similarity is high
although the document's is not. One minimum per hash function is a key; items
and windows that share a key are candidates, and a candidate counts only if the
document holds at least 0.8 of the item's distinct shingles, counted exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.llm.words import Words, hash_words, in_chunks, mix, shingles
from understory.sources.shared import cut_lineage

WIDTH = 5
CONTAINMENT = 0.8
FUNCTIONS = 64  # a contained item shares a key with chance above 1 - 2e-6, a half in each of two windows 0.999
FILTER_BITS = 25  # the filter sent to executors has 2^25 bits, 4 MB, however many items there are

Batches = Iterator[pd.DataFrame]


def _multipliers() -> np.ndarray:
    return mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64)) | np.uint64(1)


def partition_size(n: int) -> int:
    """The partition of an item of n shingles: the next power of two."""
    return 1 << max(0, int(n) - 1).bit_length()


def _key(minima: np.ndarray, function: int, width: int, size: int) -> np.ndarray:
    return mix(minima + np.uint64((function << 40) + (width << 32) + size))


def _bits(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _item_rows(batches: Batches) -> Batches:
    """Distinct shingles of each item; an item under five words is one shingle of its own width."""
    for batch in batches:
        words = hash_words(batch["text"].tolist())
        for i, item in enumerate(batch["item_id"].tolist()):
            own = words.of(i)
            width = min(WIDTH, len(own))
            if width:
                one = Words(own, np.zeros(len(own), int), np.array([0, len(own)]), words.start, words.end, b"")
                found = np.unique(shingles(one, width)[0])
                yield pd.DataFrame({"item_id": [item], "width": [width], "n": [len(found)],
                                    "size": [partition_size(len(found))], "shingles": [found.view(np.int64)]})


def _item_keys(batches: Batches) -> Batches:
    multipliers = _multipliers()
    for batch in batches:
        for row in batch.itertuples():
            found = np.asarray(row.shingles, np.int64).view(np.uint64)
            keys = [_key((found * m).min(keepdims=True), k, row.width, row.size)[0] for k, m in enumerate(multipliers)]
            yield pd.DataFrame({"key": np.array(keys, np.uint64).view(np.int64), "item_id": row.item_id})


def _filter_of(keys: DataFrame, column: str) -> Broadcast:
    """A bitmap of hashed keys, of fixed size; parts are built on the executors and joined here one by one."""

    def part(batches: Batches) -> Batches:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[_bits(mix(batch[column].to_numpy().view(np.uint64)))] = True
        yield pd.DataFrame({"bits": [np.packbits(bits).tobytes()]})

    whole = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in keys.select(column).coalesce(8).mapInPandas(part, "bits binary").toLocalIterator():
        whole |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(whole.tobytes())


def _probe(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _bits(mix(keys))
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _window_minima(values: np.ndarray, owner: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, Callable]]:
    """For each size: the owners of the windows and a function from values to the windows' minima."""
    n = len(owner)
    starts = np.flatnonzero(np.diff(owner, prepend=-1) != 0)
    offset = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    for size in sizes:
        at = np.flatnonzero(offset % size == 0)
        block_owner = owner[at]
        pair = np.append(block_owner[1:] == block_owner[:-1], False)
        alone = ~pair & ~np.insert(pair[:-1], 0, False)
        yield size, (at, block_owner, pair, alone)


def _document_keys(bitmap: Broadcast, partitions: list[tuple[int, int]]) -> Callable[[Batches], Batches]:
    """(key, doc_id) of windows whose key may be an item's."""

    def run(batches: Batches) -> Batches:
        bits, multipliers = np.frombuffer(bitmap.value, np.uint8), _multipliers()
        widths = sorted({w for w, _ in partitions})
        for batch in batches:
            ids, texts = batch["doc_id"].to_numpy(), batch["text"].tolist()
            for lo, hi in in_chunks(texts):
                words = hash_words(texts[lo:hi])
                out_key, out_doc = [], []
                for width in widths:
                    hashes, _, owner = shingles(words, width)
                    if not len(hashes):
                        continue
                    sizes = sorted(s for w, s in partitions if w == width)
                    layout = list(_window_minima(hashes, owner, sizes))
                    for k, m in enumerate(multipliers):
                        values, base = hashes * m, None
                        for size, (at, block_owner, pair, alone) in layout:
                            if base is None:
                                blocks = np.minimum.reduceat(values, at)
                            else:  # larger blocks are made of smaller ones, which begin in the same places
                                blocks = np.minimum.reduceat(base[1], np.searchsorted(base[0], at))
                            base = (at, blocks)
                            following = np.append(blocks[1:], blocks[-1:])
                            minima = np.where(pair, np.minimum(blocks, following), blocks)
                            keys = _key(minima, k, width, size)
                            hit = (pair | alone) & _probe(bits, keys)
                            if hit.any():
                                out_key.append(keys[hit])
                                out_doc.append(ids[lo + block_owner[hit]])
                if out_key:
                    frame = pd.DataFrame({"key": np.concatenate(out_key).view(np.int64), "doc_id": np.concatenate(out_doc)})
                    yield frame.drop_duplicates()

    return run


def _document_shingles(bitmap: Broadcast, widths: list[int]) -> Callable[[Batches], Batches]:
    """Distinct (doc_id, shingle) of shingles that may be an item's."""

    def run(batches: Batches) -> Batches:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            ids, texts = batch["doc_id"].to_numpy(), batch["text"].tolist()
            for lo, hi in in_chunks(texts):
                words = hash_words(texts[lo:hi])
                for width in widths:
                    hashes, _, owner = shingles(words, width)
                    hit = _probe(bits, hashes)
                    yield pd.DataFrame({"doc_id": ids[lo + owner[hit]], "shingle": hashes[hit].view(np.int64)}).drop_duplicates()

    return run


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) for items of which a document holds 0.8 or more.

    Documents of one doc_id count as one, items of one item_id as several texts of
    which the best counts. Rows without an id, and texts without a word, match
    nothing; an item under five words is searched as one run of its words.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.where("doc_id is not null and text is not null")
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    rows = rows.where("item_id is not null and text is not null").distinct()
    sets = cut_lineage(
        rows.mapInPandas(_item_rows, "item_id long, width int, n long, size long, shingles array<long>")
        .withColumn("part", F.monotonically_increasing_id()))
    partitions = [tuple(r) for r in sets.select("width", "size").distinct().collect()]  # at most 5 x 64
    item_keys = sets.select(F.col("part").alias("item_id"), "width", "size", "shingles").mapInPandas(
        _item_keys, "key long, item_id long").withColumnRenamed("item_id", "part").distinct()
    item_keys = cut_lineage(item_keys)
    doc_keys = docs.mapInPandas(_document_keys(_filter_of(item_keys, "key"), partitions), "key long, doc_id long")
    candidates = cut_lineage(doc_keys.join(item_keys, "key").select("doc_id", "part").distinct())
    item_shingles = cut_lineage(sets.select("part", F.explode("shingles").alias("shingle")))
    wanted = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    there = wanted.mapInPandas(
        _document_shingles(_filter_of(item_shingles, "shingle"), sorted({w for w, _ in partitions})),
        "doc_id long, shingle long").distinct()
    found = there.join(item_shingles, "shingle").groupBy("doc_id", "part").agg(F.count("*").alias("n_found"))
    found = found.join(candidates, ["doc_id", "part"]).join(sets.select("part", "item_id", "n"), "part")
    found = found.withColumn("containment", F.col("n_found") / F.col("n")).where(F.col("containment") >= CONTAINMENT)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n", "n_found")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n").alias("n_shingles"), F.col("b.n_found").alias("n_found"),
                       F.col("b.containment").alias("containment"))
