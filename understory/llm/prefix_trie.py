"""Conversation prefix trie by truncation peeling.

Every distinct beginning of a conversation is a node. From the deepest level up,
the conversations that end at a level are merged with the nodes that survive
from below; then the last turn of each node is stripped, and what is left is
grouped again one level higher. Counts, leaves and savings are aggregated while
the nodes are found, so every level is one grouping of at most as many rows as
it has nodes below it and conversations that end in it.

A beginning is known by 128 bits, the exclusive or of a hash of each turn with
its place. A row carries the hashes of its own beginnings down to the start of
a band of levels only, and takes up those of the next band there. Rows of
different beginnings at the start of a band never meet within it, so small groups of
one such beginning are peeled in one task through the whole band, and large
ones level by level over the cluster. Few long conversations then take few rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from understory.llm.keys import join_by_frequency
from understory.sources.shared import cut_lineage

STARTS, WIDEST = (0, 16, 32, 64, 128), 256  # levels at which bands start; beyond the last, the multiples of the widest
GROUP_ROWS = 4096  # of one beginning, peeled in one task at most
IDS_PER_CHUNK = 4096
NOTHING = hashlib.sha256(b"").hexdigest()  # digest of no ids
_KEY = ["depth", "k1", "k2"]
_PATH = "array<struct<depth:int,k1:long,k2:long,chars:long>>"

Batches = Iterator[pd.DataFrame]


def turn_sequences(
    frame: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """(conv_id, depth, digest, chars): turns in order from depth 1, and each conversation's start at depth 0.

    Turns are ordered by ``turn``, null first, equal ones by the digest of role and
    text. Null roles and texts are empty. Rows without a conv_id belong to no conversation.
    """
    part = {name: F.coalesce(F.col(c).cast("string"), F.lit("")) for name, c in (("role", role), ("text", text))}
    said = F.concat(F.octet_length(part["role"]).cast("string"), F.lit(":"), part["role"], part["text"])
    rows = frame.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.unhex(F.md5(said)).alias("digest"),
        F.length(part["text"]).cast("long").alias("chars")).where("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    turns = rows.select("conv_id", F.row_number().over(order).alias("depth"), "digest", "chars")
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    own = F.struct("depth", "digest", "chars")
    return turns.select("conv_id", F.inline(F.when(F.col("depth") == 1, F.array(start, own)).otherwise(F.array(own))))


def graft_openings(sequences: DataFrame, source: Column, length: Column, most: int) -> DataFrame:
    """Sequences whose first ``length`` turns are replaced by those of the conversation ``source``.

    ``source`` and ``length`` (at most ``most``) are functions of conv_id, and a source is its own source.
    A source that has fewer turns, or is absent, gives what it has.
    """
    turns = sequences.where("depth > 0")
    opening = turns.where((F.col("depth") <= most) & (source == F.col("conv_id"))).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("depth", "digest", "chars"))).alias("opening"))
    starts = sequences.where("depth = 0").select("conv_id", "digest", "chars", source.alias("source"), length.alias("h"))
    opening = opening.withColumnRenamed("conv_id", "source")
    met = starts.join(opening, "source", "left").withColumn("opening", F.slice("opening", F.lit(1), F.col("h")))
    met = met.select("conv_id", "digest", "chars", "h", "opening", F.coalesce(F.size("opening"), F.lit(0)).alias("given"))
    # size of a null array is null or -1, by session setting
    met = met.withColumn("given", F.greatest("given", F.lit(0)))
    own = turns.join(met.select("conv_id", "h", "given"), "conv_id").where("depth > h")
    return met.select("conv_id", F.lit(0).alias("depth"), "digest", "chars").unionByName(
        met.select("conv_id", F.inline("opening"))).unionByName(
        own.select("conv_id", (F.col("depth") - F.col("h") + F.col("given")).cast("int").alias("depth"), "digest", "chars"))


def _runs(batch: pd.DataFrame, columns: list[str]) -> list[tuple[int, int]]:
    """Bounds of runs of rows that agree in ``columns``."""
    new = np.zeros(len(batch), bool)
    for c in columns:
        values = batch[c].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    cuts = [0, *np.flatnonzero(new).tolist(), len(batch)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def _chunks(batches: Batches) -> Batches:
    """Ascending ids of each key, joined, at most IDS_PER_CHUNK to a row; rows come sorted by key and id."""
    for batch in batches:
        ids, out = batch["conv_id"].tolist(), []
        keys = list(zip(*(batch[c].tolist() for c in _KEY), strict=True))
        for lo, hi in _runs(batch, _KEY):
            for at in range(lo, hi, IDS_PER_CHUNK):
                part = ids[at:min(hi, at + IDS_PER_CHUNK)]
                out.append((*keys[at], part[0], len(part), ",".join(map(str, part))))
        yield pd.DataFrame(out, columns=[*_KEY, "conv_id", "n_convs", "ids"])


def _digests(batches: Batches) -> Batches:
    """One row for each key: smallest id, number of ids and digest of all; chunks come sorted by key and id."""
    held, digest = None, None
    for batch in batches:
        out = []
        for row in batch[[*_KEY, "conv_id", "n_convs", "ids"]].itertuples(index=False, name=None):
            key, ids = row[:3], row[5].encode()
            if held is not None and held[:3] == key:
                digest.update(b"," + ids)
                held = (*held[:4], held[4] + row[4])
            else:
                if held is not None:
                    out.append((*held, digest.hexdigest()))
                held, digest = row[:5], hashlib.sha256(ids)
        yield pd.DataFrame(out, columns=[*_KEY, "conv_id", "n_convs", "ends"])
    if held is not None:
        yield pd.DataFrame([(*held, digest.hexdigest())], columns=[*_KEY, "conv_id", "n_convs", "ends"])


def _endings(last: DataFrame) -> DataFrame:
    """Conversations that are equal as one row: (depth, k1, k2, conv_id, n_convs, ends).

    Ids are sorted over the whole cluster and joined in chunks where they stand. A
    digest is taken in order, so the chunks of one ending, a row for 4,096 ids,
    stream through one task, which holds one at a time.
    """
    order = [*_KEY, "conv_id"]
    sorted_ids = last.repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = cut_lineage(sorted_ids.mapInPandas(_chunks, "depth int, k1 long, k2 long, conv_id long, n_convs long, ids string"))
    dealt = chunks.repartition(*_KEY).sortWithinPartitions(*order)
    return dealt.mapInPandas(_digests, "depth int, k1 long, k2 long, conv_id long, n_convs long, ends string")


def band_start(depth: int) -> int:
    return depth - depth % WIDEST if depth >= WIDEST else max(s for s in STARTS if s <= depth)


def _band_start(depth: Column) -> Column:
    start = F.lit(0)
    for s in STARTS[1:]:
        start = F.when(depth >= s, s).otherwise(start)
    return F.when(depth >= WIDEST, depth - depth % WIDEST).otherwise(start).cast("int")


_ROW = ["conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends", "path"]
_NODE = ["depth", "k1", "k2", "p1", "p2", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
_NODES = ("depth int, k1 long, k2 long, p1 long, p2 long, conv_id long, n_convs long, n_children long, n_leaves long,"
          " saved long, ends string")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node.

    ``sequences`` are those of :func:`turn_sequences`. A node is a distinct sequence of first
    ``depth`` turns, known by its smallest member; its last turn is turn ``depth`` of that
    conversation. ``n_convs`` counts its members, ``n_leaves`` the nodes without children
    in its subtree, ``saved_tokens`` the code points of last turns that its subtree need not hold
    again, ``ends_sha256`` is of the members that end there. The root has no parent. Without
    conversations there is no node. Levels that over GROUP_ROWS conversations share beyond
    the first sixteen take a round each.
    """
    upto = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    paths = cut_lineage(sequences.select(
        "conv_id", "depth", F.bit_xor(F.xxhash64("depth", "digest")).over(upto).alias("k1"),
        F.bit_xor(F.xxhash64(F.lit(1), "depth", "digest")).over(upto).alias("k2"), "chars"))
    last = paths.groupBy("conv_id").agg(F.max_by(F.struct(*_KEY), "depth").alias("end"))
    ends = cut_lineage(_endings(cut_lineage(last.select("conv_id", "end.*"))))
    # beginnings of one conversation of each ending, a band of levels to a row
    bands = cut_lineage(paths.join(ends.select("conv_id"), "conv_id").groupBy(
        "conv_id", _band_start(F.col("depth")).alias("band")).agg(
        F.sort_array(F.collect_list(F.struct(*_KEY, "chars"))).cast(_PATH).alias("path")))
    none = F.lit(0).cast("long")
    ended = cut_lineage(ends.withColumn("band", _band_start(F.col("depth"))).join(bands, ["conv_id", "band"]).select(
        "band", "depth", "conv_id", "n_convs", none.alias("n_children"), none.alias("n_leaves"), none.alias("saved"), "ends", "path"))
    depths = dict(map(tuple, ended.groupBy("band").agg(F.max("depth")).collect()))
    nodes, alive = [], None
    band = max(depths, default=-1)
    while band >= 0:
        rows = ended.where(F.col("band") == band).select(*_ROW)
        deepest = depths.get(band, band)
        if alive is not None:
            rows, deepest = rows.unionByName(_stripped(alive)), max(deepest, next_start - 1)
        above = band_start(band - 1) if band else -1
        made, alive = _peel_band(rows, band, deepest, bands.where(F.col("band") == above).select("conv_id", "path"))
        nodes += made
        band, next_start = above, band
    if not nodes:
        out = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long,"
               " saved_tokens long, ends_sha256 string")
        return sequences.sparkSession.createDataFrame([], out)
    found = nodes[0]
    for more in nodes[1:]:
        found = found.unionByName(more)
    return _with_parents(cut_lineage(found))


def _peel_band(rows: DataFrame, start: int, deepest: int, above: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Nodes of a band, as frames, and its survivors, which have the beginnings of the band above."""
    if not start:
        return _peel_levels(rows, start, deepest, above)
    rows = cut_lineage(rows.withColumn("first", F.get("path", F.lit(0))))
    large = cut_lineage(rows.groupBy("first").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS))
    if not large.count():
        return _peel_groups(rows, start, above)
    # hot beginnings are sent to their rows, the others move
    hot = join_by_frequency(rows, large, "first", "n")
    cold = rows.join(large.select("first"), "first", "left_anti")
    made, alive = _peel_groups(cold, start, above)
    more, also = _peel_levels(hot.select(*_ROW), start, deepest, above)
    return made + more, alive.unionByName(also)


def _peel_groups(rows: DataFrame, start: int, above: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    peeled = cut_lineage(rows.groupBy("first").applyInPandas(_peel, _NODES))
    top = peeled.where(F.col("depth") == start)
    alive = _survivors(cut_lineage(top.drop("p1", "p2").join(above, "conv_id")))
    return [peeled.where(F.col("depth") > start), alive.select(*_NODE)], alive


def _survivors(level: DataFrame) -> DataFrame:
    """Nodes whose path ends above them; ``_ROW`` of it are rows of the next level, ``_NODE`` the nodes themselves."""
    up = F.element_at("path", -1)
    return level.select("*", up["k1"].alias("p1"), up["k2"].alias("p2"))


def _stripped(alive: DataFrame) -> DataFrame:
    return alive.withColumns({"n_children": F.lit(1).cast("long"), "ends": F.lit(None).cast("string")}).select(*_ROW)


def _peel(group: pd.DataFrame) -> pd.DataFrame:
    """All nodes of a band below one beginning; those at the start of the band have no parent here."""
    waiting: dict[int, list] = {}
    for row in group[_ROW].itertuples(index=False, name=None):
        waiting.setdefault(int(row[-1][-1]["depth"]), []).append(row)
    start, out, survivors = int(group["path"].iloc[0][0]["depth"]), [], []
    for depth in range(max(waiting), start - 1, -1):
        nodes: dict[tuple, list] = {}
        for conv_id, n, children, leaves, saved, ends, path in waiting.pop(depth, []) + survivors:
            at = path[depth - start]
            node = nodes.setdefault((at["k1"], at["k2"]), [conv_id, 0, 0, 0, 0, None, path])
            node[0], node[5] = min(node[0], conv_id), node[5] or ends
            for i, more in enumerate((n, children, leaves, saved), 1):
                node[i] += more
        survivors = []
        for key, (conv_id, n, children, leaves, saved, ends, path) in nodes.items():
            saved, leaves = saved + (n - 1) * path[depth - start]["chars"], leaves if children else 1
            up = path[depth - start - 1] if depth > start else {"k1": 0, "k2": 0}
            out.append((depth, *key, up["k1"], up["k2"], conv_id, n, children, leaves, saved, ends or NOTHING))
            survivors.append((conv_id, n, 1, leaves, saved, None, path))
    return pd.DataFrame(out, columns=_NODE)


def _peel_levels(rows: DataFrame, start: int, deepest: int, above: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Level by level, each written before the next."""
    rows = rows.withColumn("at", F.element_at("path", -1)["depth"])
    nodes, alive = [], None
    for depth in range(deepest, start - 1, -1):
        here = rows.where(F.col("at") == depth).select(*_ROW)
        level = _level(here if alive is None else here.unionByName(_stripped(alive)), depth)
        if depth > start or not start:
            level = level.withColumn("path", F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))))
        else:
            level = level.drop("path").join(above, "conv_id")
        alive = _survivors(cut_lineage(level)) if depth else cut_lineage(level).withColumns(
            {"p1": F.lit(None).cast("long"), "p2": F.lit(None).cast("long")})
        nodes.append(alive.select(*_NODE))
    return nodes, alive


def _level(rows: DataFrame, depth: int) -> DataFrame:
    """Nodes of one level, from the conversations that end there and the nodes stripped of their last turn."""
    rows = rows.withColumn("at", F.element_at("path", -1))
    nodes = rows.groupBy(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2")).agg(
        F.min_by("path", "conv_id").alias("path"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"),
        F.max("ends").alias("ends"))
    chars = F.element_at("path", -1)["chars"]
    return nodes.select(
        F.lit(depth).alias("depth"), "k1", "k2", "conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * chars).alias("saved"), F.coalesce("ends", F.lit(NOTHING)).alias("ends"), "path")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with their parent's smallest member, which was known only after them."""
    columns = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
               F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    parent = F.struct((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    lower = nodes.where("depth > 0").select("*", parent.alias("parent"))
    upper = nodes.where("n_children > 0").select(
        F.struct(*_KEY).alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return join_by_frequency(lower, upper, "parent", "n").select(*columns).unionByName(root.select(*columns))
