"""Line dedup against a plain version."""

import re

import pytest
from pyspark.sql import functions as F

from understory.llm import line_dedup
from understory.llm.line_dedup import drop_repeated_lines

COLUMNS = "doc_id long, text string, line string, owner int"


def plain(rows, least_chars=10, least_docs=2):
    lower = {c: c + 32 for c in range(65, 91)}

    def key(line):
        return line.strip(" \t\n\v\f\r").translate(lower)

    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines
                if i is None or len(holders.get(key(x), ())) < least_docs or min(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def found(frame):
    return sorted(map(tuple, frame.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)


ODD = [
    (1, None), (2, ""), (3, "\n"), (4, "a line that is shared\nown line of four"), (5, " A LINE that is Shared\t\n\nx"),
    (6, "\x0ba line that is shared\x0c"), (7, " a line that is shared"), (8, "Ä LINE ÄÄÄÄÄ\nä line äääää"), (9, "Ä line ÄÄÄÄÄ"),
    (10, "a line that is shared\r\na line that is shared"), (10, "own line of four"), (10, "own line of four"), (-5, "own line of four\n"),
    (None, "a line that is shared"), (None, "a line of nobody\na line of nobody"), (11, "123456789\n1234567890"), (12, "123456789\n1234567890"),
    (13, "\U0001f600" * 10), (14, "x\n" + "\U0001f600" * 10 + "\ny"), (15, "\U0001f600" * 9), (16, "\U0001f600" * 9),
]


def test_odd_rows(spark):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in ODD], COLUMNS).repartition(5)
    assert found(drop_repeated_lines(frame)) == plain(ODD)


def test_threshold_and_length(spark):
    rows = [(i, "\n".join(f"{w} {w}" for w in "abcdef"[: 1 + i % 6])) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(drop_repeated_lines(frame, least_chars=3, least_documents=5)) == plain(rows, 3, 5)


def test_empty_table(spark):
    assert drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_line_in_every_document_and_a_very_long_text(spark):
    """Time is linear in the text, and a line of all documents is no burden on one task."""
    common = "this line is everywhere"
    rows = [(i, f"{common}\nline number {i} here\n{common}") for i in range(2000)]
    rows.append((5000, "\n".join(common if i % 3 else f"line number {i} here" for i in range(200_000))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(drop_repeated_lines(frame)) == plain(rows)


@pytest.mark.parametrize("dropped", [[], [0], [4], [0, 1, 2, 3, 4], [1, 3]])
def test_positions(spark, dropped):
    frame = spark.createDataFrame([(list("abcde"), dropped)], "lines array<string>, dropped array<int>")
    got = frame.select(line_dedup.without_positions(F.col("lines"), F.col("dropped")).alias("x")).first().x
    assert got == [x for i, x in enumerate("abcde") if i not in dropped]


def test_texts_are_exploded_once(spark):
    """Lines reach the comparison as hashes: the stored table has no text."""
    frame = spark.createDataFrame(ODD, "doc_id long, text string")
    plan = drop_repeated_lines(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and not re.search(r"Relation \[.*key#", plan)
