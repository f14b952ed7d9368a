"""Licence scans by ordered signature rules, in DataFrame expressions only.

A text becomes its lower-case words. A rule's pattern is tried only on texts
that hold its keyword. Detections that lie inside a stronger one are suppressed.
Everything is computed within the text's row: no shuffle, and the rules, whose
number is fixed in the code, are a constant of the plan.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory.llm.license_rules import Rule, all_rules

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-case words; only A-Z change case. Empty for null and empty texts."""
    lower = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _rule_literals(rules: list[Rule]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(r.order).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"),
            F.lit(r.priority).alias("priority"), F.lit(r.pattern).alias("pattern"), F.lit(r.base).alias("base"),
        )
        for r in rules
    ])


SPANS = "array<struct<start:int,end:int,rule:int,label:string,priority:int,base:boolean>>"
MARK = "\x01"  # in no word


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where ``use`` reads it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _matches(line: Column, rule: Column) -> Column:
    """All matches of one rule: where they start and end, in words.

    Every match begins with the space before its first word. A mark put before each match ends the
    piece of the line before it, whose number among the pieces is the word the match starts at.
    """
    pieces = F.split(F.regexp_replace(line, rule["pattern"], F.lit(f"{MARK}$0")), " ", -1)
    at = F.transform(pieces, lambda piece, i: F.when(F.endswith(piece, F.lit(MARK)), i))
    starts = F.filter(at, lambda i: i.isNotNull())
    found = F.regexp_extract_all(line, rule["pattern"], F.lit(0))
    spans = F.zip_with(starts, found, lambda start, match: F.struct(
        start.alias("start"), (start + _spaces(match)).alias("end"), rule["rule"].alias("rule"),
        rule["label"].alias("label"), rule["priority"].alias("priority"), rule["base"].alias("base")))
    return F.when(F.rlike(line, rule["pattern"]), spans).otherwise(F.array().cast(SPANS))


def _suppressed(d: Column, others: Column) -> Column:
    """Another detection holds ``d``'s interval and is stronger; equal ones yield to the earlier rule."""

    def beats(o: Column) -> Column:
        holds = (o["start"] <= d["start"]) & (o["end"] >= d["end"])
        same = (o["start"] == d["start"]) & (o["end"] == d["end"])
        stronger = (o["priority"] > d["priority"]) | ((o["priority"] == d["priority"]) & (o["rule"] < d["rule"]))
        return holds & F.when(same, stronger).otherwise(o["priority"] >= d["priority"])

    return F.exists(others, beats)


FEW = 32  # detections that are compared with each other as they are


def _not_suppressed(found: Column, n_words: Column) -> Column:
    """Detections that stay. One that holds another starts no further before it than the longest is long.

    In the order of starts, with a place before the detections at each word, a word's place less its own number is how
    many detections start before it; so those that may hold a given one are a slice of the sorted ones.
    """
    plain = F.filter(found, lambda d: d["base"] | ~_suppressed(d, found))
    places = F.transform(F.sequence(F.lit(0), n_words), lambda w: F.struct(
        w.alias("start"), F.lit(-1).alias("end"), F.lit(-1).alias("rule"), F.lit("").alias("label"),
        F.lit(0).alias("priority"), F.lit(False).alias("base")))
    merged = F.array_sort(F.concat(places, found))
    before = F.filter(F.transform(merged, lambda d, i: F.when(d["end"] < 0, i - d["start"])), lambda n: n.isNotNull())
    longest = F.array_max(F.transform(found, lambda d: d["end"] - d["start"]))

    def stays(d: Column, known: Column) -> Column:
        first = F.get(known["before"], F.greatest(d["start"] - known["longest"], F.lit(0)))
        near = F.slice(known["sorted"], first + 1, F.get(known["before"], d["start"] + 1) - first)
        return d["base"] | ~_suppressed(d, near)

    known = F.struct(F.array_sort(found).alias("sorted"), before.alias("before"), longest.alias("longest"))
    indexed = _let(known, lambda k: F.filter(found, lambda d: stays(d, k)))
    return F.when(F.size(found) <= FEW, plain).otherwise(indexed)


def scan_licenses(frame: DataFrame, text: str, keep: list[str], rules: list[Rule] | None = None) -> DataFrame:
    """Detections of every text: ``keep`` columns, n_words, all_found, detections.

    ``detections`` is an array of (start, end, rule, label, priority, base) in words,
    after suppression; base rules are never suppressed. ``all_found`` has the
    suppressed ones too. Null and empty texts have no words and no detections.
    """
    rules = rules or all_rules()
    keywords = sorted({r.keyword for r in rules})
    table = frame.select(*keep, words_of(F.col(text)).alias("_words"))
    gate = F.array(*map(F.lit, keywords))
    hits = F.when(F.arrays_overlap("_words", gate), F.array_intersect(F.col("_words"), gate))
    table = table.select(*keep, F.size("_words").alias("n_words"), hits.alias("_hits"), F.when(
        hits.isNotNull(), F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))).alias("_line"))
    chosen = F.filter(_rule_literals(rules), lambda r: F.array_contains(F.col("_hits"), r["keyword"]))
    found = F.flatten(F.transform(chosen, lambda r: _matches(F.col("_line"), r)))
    none = F.array().cast(SPANS)
    table = table.select(*keep, "n_words", F.coalesce(F.when(F.col("_line").isNotNull(), found), none).alias("all_found"))
    kept = _not_suppressed(F.col("all_found"), F.col("n_words"))
    return table.select(*keep, "n_words", "all_found", kept.alias("detections"))


def joined_labels(detections: Column) -> Column:
    """Distinct labels, sorted, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")


def confidence(detections: Column) -> Column:
    """0 without detections, else towards 1 with the strength and length of the best one."""

    def strength(d: Column) -> Column:
        length = (d["end"] - d["start"]).cast("double")
        return (d["priority"] / F.lit(100.0)) * (F.lit(1.0) - F.lit(0.5) / length)

    return F.coalesce(F.array_max(F.transform(detections, strength)), F.lit(0.0))
