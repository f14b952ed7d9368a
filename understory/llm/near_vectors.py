"""Embedding near-duplicates: an exact metric range join over pivot cells.

On the unit sphere, cosine 0.9 is a chord of length r. Every vector lives in the
cell of its nearest pivot. By the triangle inequality, a vector within r of
another cell's half-space may have partners there, and only then is it copied to
that cell; of two cells one takes the copies. Cells then join on their own, block
against block, so a cell of any size needs the memory of two blocks. Counts and
spanning trees leave a block, never all its pairs. Equal vectors are one class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.llm.components import components
from understory.sources.shared import cut_lineage

COSINE = 0.9
PIVOTS = 32  # vectors that mark cells; which ones are taken changes the work, not the result
BLOCK = 4096  # vectors on either side of a task
_SLICE = 512

Batches = Iterator[pd.DataFrame]


def _unit(vectors: list) -> np.ndarray:
    """Vectors of length one. Powers of two bring the largest component near one first, so no square over- or underflows."""
    rows = np.array([np.asarray(v, np.float64) for v in vectors])
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def nearby_cells(units: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector's own cell, and a mask of other cells that take a copy of it.

    If x is nearest to p, y to q and |x - y| <= r, then x is at most r away from the
    plane between p and q: (|x - q|^2 - |x - p|^2) / (2 |p - q|) <= r. A link is
    found in either cell if both send copies, so each pair of cells has one direction.
    """
    r = np.sqrt(2 - 2 * COSINE)
    apart = np.sqrt(np.maximum(0, (pivots**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * pivots @ pivots.T))
    square = (pivots**2).sum(1)[None] - 2 * units @ pivots.T
    home = square.argmin(axis=1)
    excess = square - square[np.arange(len(units)), home][:, None]
    near = excess <= 2 * r * apart[home] + 1e-9
    cells = np.arange(len(pivots))
    takes = (home[:, None] < cells[None]) == ((home[:, None] + cells[None]) % 2 == 0)
    return home, near & takes & (home[:, None] != cells[None])


def _fit(pivots: np.ndarray, dim: int) -> np.ndarray:
    """Pivots as points of the space of another dimension; any points will do."""
    out = np.zeros((len(pivots), dim))
    out[:, :min(dim, pivots.shape[1])] = pivots[:, :dim]
    return out


def _places(pivots: list[list[float]]) -> Callable[[Batches], Batches]:
    """(node, dim, cell, home) for the cell of each vector and for those that take copies."""

    def run(batches: Batches) -> Batches:
        width = max(map(len, pivots))
        marks = _unit([np.pad(np.asarray(p, float), (0, width - len(p))) for p in pivots])
        for batch in batches:
            dims = batch["embedding"].map(len).to_numpy()
            for dim in np.unique(dims):
                part = batch[dims == dim]
                home, copies = nearby_cells(_unit(part["embedding"].tolist()), _fit(marks, int(dim)))
                at, cell = np.nonzero(copies)
                node = part["node"].to_numpy()
                yield pd.DataFrame({
                    "node": np.append(node, node[at]), "dim": int(dim), "cell": np.append(home, cell),
                    "home": np.append(np.ones(len(node), bool), np.zeros(len(at), bool)),
                })

    return run


def linked_in_block(left: np.ndarray, right: np.ndarray, same: bool) -> np.ndarray:
    """Which rows of ``left`` link to which of ``right``; with ``same`` the sides are one and no row links to itself.

    Single precision decides all pairs beyond its rounding error; the rest are
    decided in double precision.
    """
    slack = max(1e-5, left.shape[1] * 1.2e-7)
    a, b = left.astype(np.float32), right.astype(np.float32)
    linked = np.empty((len(left), len(right)), bool)
    for lo in range(0, len(left), _SLICE):
        cosine = a[lo:lo + _SLICE] @ b.T
        linked[lo:lo + _SLICE] = cosine >= COSINE
        i, j = np.nonzero(np.abs(cosine - np.float32(COSINE)) <= slack)
        linked[lo + i, j] = np.einsum("ij,ij->i", left[lo + i], right[j]) >= COSINE
    if same:
        np.fill_diagonal(linked, False)
    return linked


def _roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest label reachable from each row of either side; rows without links keep their own."""
    highest = np.iinfo(np.int64).max
    while True:
        new_left, new_right = left.copy(), right.copy()
        for lo in range(0, len(left), _SLICE):
            part = linked[lo:lo + _SLICE]
            new_left[lo:lo + _SLICE] = np.minimum(left[lo:lo + _SLICE], np.where(part, right, highest).min(axis=1))
            new_right = np.minimum(new_right, np.where(part, new_left[lo:lo + _SLICE, None], highest).min(axis=0))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def _join_block(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """(node, links, root) of the vectors of one block pair that have links in it."""
    _, _, inner, low, high = key
    same = inner and low == high
    first = (group["home"] & (group["block"] == low)).to_numpy()
    units, nodes = _unit(group["embedding"].tolist()), group["node"].to_numpy()
    copies = group["copies"].to_numpy()
    rows, columns = np.flatnonzero(first), np.flatnonzero(first if same else ~first)
    empty = pd.DataFrame({"node": [], "links": [], "root": []}, dtype="int64")
    if not len(rows) or not len(columns):
        return empty
    linked = linked_in_block(units[rows], units[columns], same)
    rows_with, columns_with = linked.any(axis=1), linked.any(axis=0)
    if not rows_with.any():
        return empty
    linked, rows, columns = linked[rows_with][:, columns_with], rows[rows_with], columns[columns_with]
    root_r, root_c = _roots(linked, nodes[rows], nodes[columns])
    out = [pd.DataFrame({"node": nodes[rows], "links": linked @ copies[columns], "root": root_r})]
    if not same:
        out.append(pd.DataFrame({"node": nodes[columns], "links": copies[rows] @ linked, "root": root_c}))
    return pd.concat(out).astype("int64")


def _usable(v: str) -> str:
    """Not null or empty, all components there and finite, and not all zero."""
    return (f"{v} is not null and size({v}) > 0 and forall({v}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
            f" and exists({v}, x -> x != 0)")


def similar_vectors(frame: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for every row of ``frame``.

    Two rows link if their vectors have equal dimension and a cosine of 0.9 or more
    in double precision, whatever else the rows hold. Vectors that are null, empty
    or zero, or hold null or non-finite components, and rows without an id, link
    with nothing. Rows that repeat an id count as vectors of their own.
    """
    rows = frame.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    usable = F.coalesce(F.expr(_usable("embedding")) & F.col("vec_id").isNotNull(), F.lit(False))
    keyed = rows.select("vec_id", F.when(usable, F.col("embedding")).alias("embedding")).select(
        "*", F.when(usable, F.xxhash64("embedding")).alias("k1"),
        F.when(usable, F.xxhash64(F.lit(1), "embedding")).alias("k2"))
    classes = keyed.where("embedding is not null").groupBy("k1", "k2").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("class_id"), F.any_value("embedding").alias("embedding"))
    classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()))
    marks = [r[0] for r in classes.orderBy("k1", "k2").select("embedding").limit(PIVOTS).collect()]
    if marks:
        blocks = cut_lineage(_block_pairs(classes, marks).groupBy("dim", "cell", "inner", "low", "high").applyInPandas(
            _join_block, "node long, links long, root long"))
    else:
        blocks = classes.selectExpr("node", "copies as links", "node as root")
    links = blocks.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(blocks.where("node != root"), "node", "root")
    own = classes.select("k1", "k2", "node", "copies", "class_id").join(links, "node", "left").join(found, "node", "left")
    own = own.withColumn("component", F.coalesce("component", "node"))
    smallest = own.groupBy("component").agg(F.min("class_id").alias("component_id"))
    own = own.join(smallest, "component").select(
        "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "k1", "k2").join(cut_lineage(own), ["k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                     F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _block_pairs(classes: DataFrame, marks: list) -> DataFrame:
    """Vectors dealt to the block pairs (dim, cell, inner, low, high) they take part in.

    Blocks of a cell's own vectors meet each other (``inner``) and the blocks of
    the copies sent to the cell.
    """
    placed = cut_lineage(classes.select("node", "embedding").mapInPandas(
        _places(marks), "node long, dim int, cell int, home boolean"))
    blocks = placed.groupBy("dim", "cell").agg(
        F.ceil(F.count_if("home") / BLOCK).cast("int").alias("own"),
        F.ceil(F.count_if(~F.col("home")) / BLOCK).cast("int").alias("sent"))
    dealt = placed.join(blocks.where("own > 0"), ["dim", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("own")).otherwise(F.col("sent"))).cast("int"))
    own = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda o: F.struct(
        F.lit(True).alias("inner"), F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))
    outer = F.transform(F.sequence(F.lit(0), F.col("sent") - 1), lambda s: F.struct(
        F.lit(False).alias("inner"), F.col("block").alias("low"), s.alias("high")))
    copied = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda o: F.struct(
        F.lit(False).alias("inner"), o.alias("low"), F.col("block").alias("high")))
    pairs = F.when(F.col("home"), F.concat(own, F.when(F.col("sent") > 0, outer).otherwise(F.filter(own, lambda _: F.lit(False)))))
    dealt = dealt.select("node", "dim", "cell", "home", "block", F.explode(pairs.otherwise(copied)).alias("p"))
    dealt = dealt.select("node", "dim", "cell", "home", "block", "p.inner", "p.low", "p.high")
    return dealt.join(classes.select("node", "copies", "embedding"), "node")
