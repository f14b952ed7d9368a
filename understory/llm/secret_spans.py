"""Secrets in texts: keyword automaton, anchored patterns at its hits, embedded checks.

An Aho-Corasick automaton finds all keywords of all kinds in one pass over the
lower-cased text; a kind's pattern is tried only where its keyword begins. Hex
runs have no keyword and are scanned for directly. Kinds that carry a checksum
or a structure of their own are kept only if it holds.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def base62_crc(match: re.Match) -> bool:
    """Six base-62 digits at the end hold the CRC-32 of the random part before them."""
    body, digits = match[1][:-6], match[1][-6:]
    value = 0
    for c in digits:
        value = value * 62 + _BASE62.index(c)
    return value == zlib.crc32(body.encode())


def base58_check(match: re.Match) -> bool:
    """The last four bytes are the double SHA-256 of the others."""
    number = 0
    for c in match[0]:
        number = number * 58 + _BASE58.index(c)
    raw = number.to_bytes(82, "big") if number < 1 << 656 else b""
    return bool(raw) and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_check(match: re.Match) -> bool:
    """The polynomial checksum over prefix and data is one."""
    text = match[0].lower()
    prefix, _, data = text.rpartition("1")
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]
    check = 1
    for value in values + [_BECH32.index(c) for c in data]:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ value
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    return check == 1


def jwt_header(match: re.Match) -> bool:
    """The first part decodes to a JSON object that names an algorithm."""
    head = match[0].split(".")[0]
    try:
        value = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(value, dict) and "alg" in value


def luhn(match: re.Match) -> bool:
    """Digits pass the mod-10 check of payment cards."""
    digits = [int(c) for c in match[2] if c.isdigit()]
    total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
    return 13 <= len(digits) <= 19 and total % 10 == 0


def long_value(match: re.Match) -> bool:
    return len(match[2]) >= 6


def long_access(match: re.Match) -> bool:
    return len(match[0]) >= 20


def always(match: re.Match) -> bool:
    return True


class Kind(NamedTuple):
    name: str
    keywords: tuple[str, ...]  # lower case; the pattern begins with one of them
    pattern: re.Pattern
    holds: Callable[[re.Match], bool]
    run: re.Pattern | None = None  # what a failed try reads through: tries that begin inside it fail as well


# The first two kinds and HEX are given; the others are public token formats.
KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
         re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII), long_value),
    Kind("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), long_access),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
         re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), base62_crc),
    Kind("npm", ("npm_",), re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), base62_crc),
    Kind("jwt", ("eyj",), re.compile(r"eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+"), jwt_header,
         re.compile(r"eyJ[A-Za-z0-9_-]+")),
    Kind("xprv", ("xprv",), re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])"), base58_check),
    Kind("age", ("age-secret-key-1",),
         re.compile(r"AGE-SECRET-KEY-1[QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58}(?![A-Za-z0-9])"), bech32_check),
    Kind("card", ("card",), re.compile(r"(card)[^\d\n]{0,20}(\d(?:[ -]?\d){12,18})(?![\d])", re.IGNORECASE | re.ASCII), luhn),
    Kind("slack", ("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"),
         re.compile(r"xox[baprs]-[0-9]{8,}-[0-9A-Za-z-]{16,}"), always),
    Kind("google", ("aiza",), re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), always),
    Kind("stripe", ("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[0-9A-Za-z]{24,}"), always),
    Kind("private_key", ("-----begin",),
         re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----"), always),
)
HEX = re.compile(r"[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")
KIND_ORDER = BASE_KINDS + tuple(k.name for k in KINDS if k.name not in BASE_KINDS)

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
]))


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for i, kind in enumerate(KINDS):
        for word in kind.keywords:
            found.add_word(word, (i, len(word)))
    found.make_automaton()
    return found


def _ascii_lower(text: str) -> str:
    """Lower case of A-Z only, so offsets stay."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of one text by start, then kind; offsets in code points, ends exclusive.

    Matches of one kind don't overlap, leftmost first; a match that fails its
    check still takes its place, as a scan by the pattern would have it.
    """
    hits: dict[int, list[int]] = {}
    for end, (kind, size) in _automaton().iter(_ascii_lower(text)):
        hits.setdefault(kind, []).append(end - size + 1)
    spans = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    for i, starts in hits.items():
        kind, past = KINDS[i], 0
        for at in sorted(starts):
            if at < past:
                continue
            if match := kind.pattern.match(text, at):
                past = match.end()
                if kind.holds(match):
                    spans.append((kind.name, match.start(), match.end()))
            elif kind.run and (passed := kind.run.match(text, at)):
                past = passed.end()
    return sorted(spans, key=lambda s: (s[1], KIND_ORDER.index(s[0]), s[2]))


@F.pandas_udf(SPANS)
def _spans(texts: pd.Series) -> pd.Series:
    return pd.Series([
        [{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)] if t else [] for t in texts
    ], dtype=object)


def secret_spans(text: Column) -> Column:
    """All secret spans of a text as array<struct<kind,start,end>>; empty and null texts have none."""
    return _spans(F.coalesce(text, F.lit("")))


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """The text with every run of overlapping spans replaced by ``mark``."""
    out, past = [], 0
    merged: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[past:a], mark]
        past = b
    return "".join([*out, text[past:]])


@F.pandas_udf(T.StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    return pd.Series([redact(t, s) if t and (s := find_spans(t)) else t for t in texts], dtype=object)


def redact_secrets(text: Column) -> Column:
    """The text without its secrets; clean, empty and null texts come back as they are."""
    return _redacted(text)
