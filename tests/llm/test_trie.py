"""The prefix trie against a plain one."""

import hashlib
import zlib

import pytest

from understory.llm import prefix_trie as P
from understory.llm import queries as Q
from understory.llm.prefix_trie import graft_openings, prefix_trie, turn_sequences

COLUMNS = "conv_id long, turn long, role string, text string, depth int, k1 string"


def sequences(rows):
    """Turns of each conversation in order; ties are not told apart here."""
    out = {}
    for i, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        if i is not None:
            out.setdefault(i, []).append((role or "", text or ""))
    return out


def rebuilt(convs):
    out = {}
    for i, own in convs.items():
        h = zlib.crc32(str(i).encode()) % 6
        base = i - (abs(i) % 100) * (1 if i >= 0 else -1)
        out[i] = convs.get(base, [])[:h] + own[h:]
    return out


def plain(convs):
    members = {}
    for i, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(i)
    nodes = {}
    for path in sorted(members, key=len, reverse=True):
        own = members[path]
        children = [p for p in nodes if len(p) == len(path) + 1 and p[:-1] == path]
        ends = ",".join(str(i) for i in sorted(own) if len(convs[i]) == len(path))
        saved = (len(own) - 1) * len(path[-1][1]) if path else 0
        nodes[path] = (
            min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(children),
            sum(nodes[c][5] for c in children) if children else 1, saved + sum(nodes[c][6] for c in children),
            hashlib.sha256(ends.encode()).hexdigest())
    return sorted(nodes.values(), key=repr)


def found(frame):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, frame.select(columns).collect()), key=repr)


ROWS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi there"), (2, 0, "user", "hello"), (2, 1, "assistant", "hi there"),
    (2, 2, "user", "bye"), (3, 0, "user", "hello"), (3, 1, "assistant", "no"), (4, 0, None, None), (5, None, "", ""), (5, 3, "user", "x"),
    (6, 7, "user", "hello"), (6, None, None, "first"), (None, 0, "user", "lost"), (7, 0, "userh", "ello"), (8, 0, "user", "hello"),
    (8, 0, "user", "hello"), (9, 1, "a", "é😀"), (10, 1, "a", "é😀"), (-3, 1, "a", "é😀"), (100, 0, "user", "hello"), (100, 1, "user", "z"),
]
ROWS += [(100 + i, t, "user", f"{t}") for i in range(1, 40) for t in range(i % 9)]
ROWS += [(200 + i, t, "user", f"{t if t < 4 else i % 3 * t}") for i in range(0, 40) for t in range(i % 11)]


def test_trie_of_odd_rows(spark):
    frame = spark.createDataFrame([(*r, 1, "clash") for r in ROWS], COLUMNS).repartition(5)
    assert found(prefix_trie(turn_sequences(frame))) == plain(sequences(ROWS))


def test_query_rebuilds_conversations(spark, tmp_path):
    frame = spark.createDataFrame([(*r, 1, "clash") for r in ROWS], COLUMNS)
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    convs = rebuilt(sequences(ROWS))
    assert [] in convs.values()
    assert found(Q.op13_prefix_trie(spark, str(tmp_path))) == plain(convs)


@pytest.mark.parametrize("starts,widest,group,chunk", [((0, 2), 3, 4096, 3), ((0, 1), 4, 3, 1)])
def test_bands_groups_and_chunks(spark, monkeypatch, starts, widest, group, chunk):
    """Narrow bands, and groups of which some are peeled in a task and some by levels."""
    monkeypatch.setattr(P, "STARTS", starts)
    monkeypatch.setattr(P, "WIDEST", widest)
    monkeypatch.setattr(P, "GROUP_ROWS", group)
    monkeypatch.setattr(P, "IDS_PER_CHUNK", chunk)
    rows = ROWS + [(1000 + i, t, "u", f"{t}") for i in range(30) for t in range(6)]
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows], COLUMNS)
    assert found(prefix_trie(turn_sequences(frame))) == plain(sequences(rows))


def test_long_conversations(spark):
    rows = [(i, t, "user", f"{t}") for i in (1, 2) for t in range(300 + i)] + [(3, t, "user", f"{t}") for t in range(80)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(prefix_trie(turn_sequences(frame))) == plain(sequences(rows))


def test_ties_in_a_turn_have_one_order(spark):
    rows = [(1, 0, "b", "x"), (1, 0, "a", "x"), (2, 0, "a", "x"), (2, 0, "b", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [r[3] for r in found(prefix_trie(turn_sequences(frame)))] == [2, 2, 2]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    turns = turn_sequences(frame)
    assert prefix_trie(turns).count() == 0
    from pyspark.sql import functions as F

    assert prefix_trie(graft_openings(turns, F.col("conv_id"), F.lit(2), 5)).columns[0] == "conv_id"
