"""Vector links against all pairs in double precision."""

import numpy as np
import pytest

from understory.llm import near_vectors
from understory.llm import queries as Q

SF = "/root/testdata/sf0.001"


def plain(rows):
    vectors = []
    for i, v in rows:
        usable = i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        vectors.append(np.array(v, np.float64) if usable else None)
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is not None and b is not None and len(a) == len(b):
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    smallest = {}
    for i, (v, _) in enumerate(rows):
        if vectors[i] is not None:
            smallest[find(i)] = min(v, smallest.get(find(i), v))
    return sorted(((v, links[i], smallest.get(find(i), v)) for i, (v, _) in enumerate(rows)), key=repr)


def found(frame):
    rows = frame.collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows), key=repr)


def near(rng, base, spread):
    return (base + spread * rng.standard_normal(len(base))).tolist()


def clustered(seed, n, dim=16):
    """Tight groups, chains of loosely linked vectors and single ones."""
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((8, dim))
    return [near(rng, centers[rng.integers(8)], rng.choice([0.05, 0.3, 0.45, 2.0])) for _ in range(n)]


def test_whole_table(spark):
    rows = [(r[0], list(r[1])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert found(Q.op1_embedding_near_dedup(spark, SF)) == plain(rows)


@pytest.mark.parametrize("block", [4096, 16])
def test_cells_and_blocks_lose_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    rows = [(i, v) for i, v in enumerate(clustered(7, 300))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    expected = plain([(r[0], r[1]) for r in frame.collect()])
    assert sum(r[1] for r in expected) > 300
    assert found(near_vectors.similar_vectors(frame)) == expected


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]),
            (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.1]), (1, [1.0, 0.0]),
            (10, [-1.0, 0.0]), (11, [-0.0, -3.0]), (12, [0.0, -3.0])]
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, node string, copies int")
    assert found(near_vectors.similar_vectors(frame)) == plain(rows)


def test_extreme_components(spark):
    """Squares of these over- or underflow; directions do not."""
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.0001e200]), (3, [1e-200, 0.0]), (4, [1.0, 0.0]), (5, [-1.7e308, 1.7e308]),
            (6, [-1.0, 1.0]), (7, [5e-324, 0.0]), (8, [0.0, -1e-310])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(near_vectors.similar_vectors(frame)) == [
        (1, 1, 1), (2, 1, 1), (3, 2, 3), (4, 2, 3), (5, 1, 5), (6, 1, 5), (7, 2, 3), (8, 0, 8)]


def test_empty_and_unusable(spark):
    schema = "vec_id long, embedding array<float>"
    assert near_vectors.similar_vectors(spark.createDataFrame([], schema)).count() == 0
    assert found(near_vectors.similar_vectors(spark.createDataFrame([(3, None)], schema))) == [(3, 0, 3)]


def test_copies_reach_every_cell_with_a_partner():
    rng = np.random.default_rng(0)
    units = np.array(clustered(3, 400))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    pivots = units[rng.choice(len(units), 20, replace=False)]
    home, copies = near_vectors.nearby_cells(units, pivots)
    linked = units @ units.T >= 0.9
    for i, j in np.argwhere(np.triu(linked, 1)):
        assert home[i] == home[j] or copies[i, home[j]] or copies[j, home[i]]
    assert copies.sum() < 0.6 * copies.size
