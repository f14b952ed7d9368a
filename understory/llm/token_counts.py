"""Token counts by the whole-token shortcut.

Before the job, every vocabulary string is encoded alone; those that come out as
one token, and are one pre-token, form a table. A text is cut into pre-tokens;
the ones in the table count one each, and only the rest are merged by the
tokenizer, which works on each pre-token by itself, so the counts are its own.

Pre-tokens are cut by a pattern over Unicode classes, and the library that cuts
here may know more characters than the tokenizer. All code points are compared
once, and a text that holds one of those that differ is left to the tokenizer whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEPT_MERGES = 400_000  # merged pre-tokens a worker remembers; beyond that it starts anew


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def special_strings(path: str) -> list[str]:
    """Strings cut out of a text before it is split into pre-tokens."""
    with open(path, encoding="utf-8") as file:
        settings = json.load(file)
    if settings["normalizer"] or settings["pre_tokenizer"] != {
        "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True,
    }:
        raise ValueError("the shortcut is proved for byte-level pre-tokenizers without a normalizer")
    added = settings["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that reach into their surroundings are not handled")
    return sorted((t["content"] for t in added), key=len, reverse=True)


def prove_whole_tokens(path: str, pattern: str) -> list[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token.

    A string found as a pre-token of any text is encoded by itself, so what holds
    for it alone holds in every text.
    """
    tokenizer, split = _tokenizer(path), regex.compile(pattern)
    special = set(special_strings(path))
    strings = {tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())}
    whole = sorted(s for s in strings if s not in special and "�" not in s and split.findall(s) == [s])
    encoded = tokenizer.encode_batch(whole, add_special_tokens=False)
    return [s for s, e in zip(whole, encoded, strict=True) if len(e.ids) == 1]


PLANES = (0, 1, 2, 3, 14)  # the others have no letters, numbers or spaces in any version
_PROBE = "a{0}1{0}!"  # cut differently around a letter, a number, white space and anything else


_CHUNK = 0x1000
_differing: dict[str, str] = {}


def differing_in(lo: int, pattern: str) -> list[str]:
    """Of a chunk of code points, those that ``pattern`` and the tokenizer's own pre-tokenizer class differently."""
    from tokenizers.pre_tokenizers import ByteLevel

    split, own = regex.compile(pattern), ByteLevel(add_prefix_space=False, use_regex=True)
    part = [chr(c) for c in range(lo, lo + _CHUNK) if not 0xD800 <= c <= 0xDFFF]
    text = "".join(_PROBE.format(c) + "\n" for c in part)
    mine, theirs = {m.span() for m in split.finditer(text)}, {span for _, span in own.pre_tokenize_str(text)}
    return sorted({part[start // 6] for start, _ in mine ^ theirs})  # a probe and its line end are six characters


def differing_characters(spark: SparkSession, pattern: str) -> str:
    """All such code points; compared once in a session, by tasks, and no more than Unicode has."""
    if pattern not in _differing:
        starts = [(lo,) for lo in range(0, 0x110000, _CHUNK) if lo >> 16 in PLANES]

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"c": [ord(c) for lo in batch["lo"] for c in differing_in(lo, pattern)]}, dtype="int64")

        found = spark.createDataFrame(starts, "lo long").repartition(16).mapInPandas(compare, "c long").collect()
        _differing[pattern] = "".join(sorted(chr(r[0]) for r in found))
    return _differing[pattern]


class _Costs(dict):
    """Tokens of each pre-token; unknown ones are merged when asked for."""

    def __init__(self, whole: list[str], path: str):
        super().__init__(dict.fromkeys(whole, 1))
        self.limit = len(whole) + KEPT_MERGES
        self.encode = _tokenizer(path).encode

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self.encode(piece, add_special_tokens=False).ids)
        return n


_costs: dict[str, _Costs] = {}


@lru_cache(maxsize=4)
def _suspect(differing: str) -> re.Pattern:
    """Finds texts that may hold one of these characters: those of the first plane exactly, and all beyond it.

    A class of many single characters beyond the first plane is tried one by one at each place of a text.
    """
    first = "".join(c for c in differing if c <= "\uffff")
    return re.compile(f"[{re.escape(first)}\U00010000-\U0010ffff]")


def text_counter(whole: list[str], path: str, pattern: str, special: list[str], differing: str = "") -> Callable[[str], int]:
    costs = _costs.get(path)
    if costs is None or len(costs) > costs.limit:
        costs = _costs[path] = _Costs(whole, path)
    split, cut = regex.compile(pattern), regex.compile("|".join(map(regex.escape, special)) or r"(?!)")

    unlike, suspect = frozenset(differing), _suspect(differing)
    encode = _tokenizer(path).encode

    def count(text: str) -> int:
        if not text.isascii() and suspect.search(text) and not unlike.isdisjoint(text):
            return len(encode(text, add_special_tokens=False).ids)
        parts = cut.split(text) if any(s in text for s in special) else [text]
        return len(parts) - 1 + sum(sum(map(costs.__getitem__, split.findall(p))) for p in parts)

    return count


def count_tokens(frame: DataFrame, text: str | Column, path: str, pattern: str) -> Column:
    """A column with the number of tokens of ``text``: 0 for empty and null texts.

    ``path`` is the tokenizer's file, the same on every machine; ``pattern`` splits
    texts into pre-tokens. The proved table is bounded by the vocabulary and is
    sent to the executors once.
    """
    special = special_strings(path)
    table = frame.sparkSession.sparkContext.broadcast((prove_whole_tokens(path, pattern), differing_characters(frame.sparkSession, pattern)))

    @F.pandas_udf(T.LongType())
    def tokens(texts: pd.Series) -> pd.Series:
        whole, differing = table.value
        count = text_counter(whole, path, pattern, special, differing)
        return pd.Series([count(t) if t else 0 for t in texts], dtype="int64")

    return tokens(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")))
