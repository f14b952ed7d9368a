"""Line dedup: lines that many documents hold stay only in the first of them.

Texts are exploded into lines. A line's key is its text without white space at
both ends, with A-Z in lower case; its hash stands for it from then on, so
texts are not moved to compare lines. The documents of each hash are counted,
lines over the threshold are dropped by the documents that do not own them, and
what is left of a text is put together again by the positions of its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory.llm.keys import join_by_frequency
from understory.sources.shared import cut_lineage

BREAK = "\n"
WHITE = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS = 10
LEAST_DOCUMENTS = 2


def line_key(line: Column) -> Column:
    """Stripped of ASCII white space, A-Z in lower case, other letters as they are."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def without_positions(lines: Column, dropped: Column) -> Column:
    """Elements of an array but for those at ``dropped`` (ascending, from 0), in time proportional to the array.

    The runs between dropped elements are sliced out and put together. ``transform``
    over an array of one element binds each input once.
    """

    def runs(bound: Column) -> Column:
        cuts = bound["cuts"]
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda i: F.slice(
            bound["lines"], F.get(cuts, i - 1) + 2, F.get(cuts, i) - F.get(cuts, i - 1) - 1)))

    cuts = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))
    return F.get(F.transform(F.array(F.struct(lines.alias("lines"), cuts.alias("cuts"))), runs), F.lit(0))


def drop_repeated_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_chars: int = LEAST_CHARS,
    least_documents: int = LEAST_DOCUMENTS,
) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped), one row for every row of ``docs``.

    Lines whose key has at least ``least_chars`` code points and stands in at least
    ``least_documents`` documents are dropped, except in the smallest doc_id that
    holds the key, which keeps all of them. A null or empty text is one empty line.
    Rows that repeat a doc_id are one document. Rows without a doc_id are no
    document: they keep their lines and are not counted. A text that loses all lines is empty.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("content", F.xxhash64("text"))
    lines = rows.where("doc_id is not null").select(
        "doc_id", "content", F.posexplode(F.split("text", BREAK)).alias("pos", "line"))
    keyed = lines.select("doc_id", "content", "pos", line_key(F.col("line")).alias("key"))
    keyed = cut_lineage(keyed.where(F.length("key") >= least_chars).select(
        "doc_id", "content", "pos", F.struct(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")).alias("line")))
    holders = keyed.groupBy("line", "doc_id").agg(F.count("*").alias("n")).groupBy("line").agg(
        F.min("doc_id").alias("owner"), F.count("*").alias("documents"), F.sum("n").alias("n"))
    shared = cut_lineage(holders.where(F.col("documents") >= least_documents).select("line", "owner", "n"))
    lost = join_by_frequency(keyed, shared, "line", "n").where("doc_id != owner")
    lost = lost.groupBy("doc_id", "content").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    met = rows.join(lost, ["doc_id", "content"], "left").select(
        "doc_id", F.split("text", BREAK).alias("lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    return met.select(
        "doc_id", F.array_join(without_positions(F.col("lines"), F.col("dropped")), BREAK).alias("text"),
        F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"))
