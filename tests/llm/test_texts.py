"""Licence scans, secret scans and token counts against plain versions of the same rules."""

import hashlib
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from understory.llm import queries as Q
from understory.llm.license_rules import all_rules
from understory.llm.secret_spans import find_spans, redact, redact_secrets

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

ODD = [
    (1, None), (2, ""), (3, "CC BY cc-by, cc\nby 4.0 All Rights Reserved. ALL RIGHTS  reserved"),
    (4, "GNU General Public License version 3 general public license"), (5, "é cc by" + " x" * 30_000 + " cc by"),
    (5, "é cc by"), (6, "password = 'abc' token: secret=abcdef Token=\"AbCdEf1\" ſecret=abcdefg AKIA" + "A1" * 10),
    (7, "0123456789abcdef01234567 ABCDEF 😀 deadbeefdeadbeefdeadbeefdeadbeef<|endoftext|>a  b\n\n c"), (None, "x"),
]


def documents(spark, tmp_path, rows):
    path = tmp_path / "documents.parquet"
    frame = spark.createDataFrame([(i, t, "en", "score", 1) for i, t in rows],
                                  "doc_id long, text string, lang string, n_words string, n_tokens long")
    frame.write.mode("overwrite").parquet(str(path))
    return str(tmp_path)


def both(spark, tmp_path, query):
    """(doc_id, text, result row) for the odd rows and the test table."""
    for folder in (documents(spark, tmp_path, ODD), SF):
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        result = query(spark, folder).collect()
        assert len(result) == len(docs)
        key = lambda r: (r[0] is not None, r[0] or 0)
        for d in sorted(docs, key=key):
            yield d["text"] or "", [r for r in result if r["doc_id"] == d["doc_id"]]


def test_license_base(spark, tmp_path):
    for text, found in both(spark, tmp_path, Q.op7_licenses):
        words = WORD.findall(text.translate(LOWER))
        places = [
            (i, label) for phrase, label in PHRASES.items() for i in range(len(words))
            if words[i:i + len(phrase.split())] == phrase.split()
        ]
        at = [i for i, _ in places]
        expected = (len(words), len(at), min(at, default=None), max(at, default=None),
                    ",".join(sorted({x for _, x in places})))
        got = [tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) for r in found]
        assert expected in got
        for r in found:
            assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
            assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_license_suppression(spark, tmp_path):
    from understory.llm.licenses import scan_licenses

    frame = spark.createDataFrame([("Licensed under the Creative Commons, CC BY-NC-SA 4.0",)], "text string")
    found = scan_licenses(frame, "text", []).first()
    kept = {(d["label"], d["start"], d["end"]) for d in found["detections"]}
    assert ("cc-by-nc-sa", 5, 11) in kept and ("cc-by", 5, 7) in kept
    assert not any(label == "cc-by-nc" for label, _, _ in kept)
    assert any(d["label"] == "cc-by-nc" for d in found["all_found"])


def brute_detections(text):
    """Every rule on every text, without keywords; then suppression pair by pair."""
    line = "".join(f" {w}" for w in WORD.findall(text.translate(LOWER))) + " "
    found = []
    for rule in all_rules():
        for m in re.finditer(rule.pattern, line):
            start = line[:m.start()].count(" ")
            found.append((start, start + m[0].count(" "), rule))

    def beaten(d):
        for o in found:
            if o[0] <= d[0] and o[1] >= d[1]:
                if (o[0], o[1]) == (d[0], d[1]):
                    if (o[2].priority, -o[2].order) > (d[2].priority, -d[2].order):
                        return True
                elif o[2].priority >= d[2].priority:
                    return True
        return False

    return [d for d in found if d[2].base or not beaten(d)]


def brute_licenses(text):
    return ",".join(sorted({d[2].label for d in brute_detections(text)}))


def test_license_labels(spark, tmp_path):
    for text, found in both(spark, tmp_path, Q.op7_licenses):
        if len(text) < 20_000:
            assert brute_licenses(text) in [r["labels"] for r in found]


NOTICES = ("Licensed under the Creative Commons CC BY-NC-SA 4.0 license. ", "GNU General Public License version 3 or later ",
           "Apache License, Version 2.0 ", "All rights reserved. MIT license ", "released under cc by, see the lesser general public license ")


def test_many_detections_in_one_text(spark):
    """Suppression by slices of the sorted detections equals suppression pair by pair; time grows with the text."""
    import random
    import time

    from understory.llm.licenses import scan_licenses

    rng = random.Random(3)
    texts = ["".join(rng.choice(NOTICES) + "and so on " * rng.randrange(3) for _ in range(n)) for n in (3, 60, 160)]
    found = scan_licenses(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string"), "text", ["i"])
    for r in found.collect():
        got = sorted((d["start"], d["end"], d["rule"]) for d in r["detections"] if not d["base"])
        assert got == sorted((a, b, o.order) for a, b, o in brute_detections(texts[r["i"]]) if not o.base)
    spent = []
    for n in (25_000, 100_000):
        text = "".join(NOTICES) * (n // 33)
        frame = scan_licenses(spark.createDataFrame([(text,)], "text string"), "text", [])
        begin = time.perf_counter()
        assert frame.select(F.size("detections")).first()[0] > n // 20
        spent.append(time.perf_counter() - begin)
    assert spent[1] < 8 * spent[0] + 5, spent


def test_long_unbroken_runs_are_read_once():
    import time

    begin = time.perf_counter()
    assert find_spans("eyJhb" * 400_000) == []
    assert time.perf_counter() - begin < 10
    head = "eyJhbGciOiJIUzI1NiJ9"
    text = f"eyJ.x {'eyJ' * 50} {head}.eyJa.b {head}.{head}.eyJc.d"
    assert [(a, b) for k, a, b in find_spans(text) if k == "jwt"] == [
        m.span() for m in re.finditer(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", text)]


def test_rules_hold_their_keyword():
    assert len({r.order for r in all_rules()}) == len(all_rules()) > 200
    for rule in all_rules():
        always, before = rule.pattern[4:-6], ""
        while always != before:  # without optional parts and choices
            always, before = re.sub(r"\(\?:[^()]*\)\??", "", always), always
        assert rule.keyword in re.findall(r"[a-z0-9]+", always), rule


def test_license_plan_has_no_python(spark):
    plan = Q.op7_licenses(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
    r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    kinds = {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6],
        "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
        "hex": [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24],
    }
    order = list(kinds)
    spans = sorted((a, order.index(k), k, b) for k, found in kinds.items() for a, b in found)
    return {k: len(v) for k, v in kinds.items()}, ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def test_secret_base(spark, tmp_path):
    seen = 0
    for text, found in both(spark, tmp_path, Q.op8_secrets):
        counts, spans = base_spans(text)
        seen += sum(counts.values())
        expected = (counts["assign"], counts["access"], counts["hex"], hashlib.sha256(spans.encode()).hexdigest())
        assert expected in [(r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in found]
        assert any(set(filter(None, spans.split(","))) <= set(r["spans"].split(",")) for r in found)
    assert seen > 10


def test_embedded_checks():
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    body, crc, tail = "A" * 30, zlib.crc32(b"A" * 30), ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        tail = digits[d] + tail
    good = f"see ghp_{body}{tail}."
    assert find_spans(good) == [("github", 4, 44)]
    assert find_spans(good.replace(tail, tail[::-1] if tail != tail[::-1] else "000000")) == []
    assert [s[0] for s in find_spans("card 4111 1111 1111 1111 and card 4111 1111 1111 1112")] == ["card"]
    jwt = "eyJhbGciOiJIUzI1NiJ9.e30.abc"
    assert [s[0] for s in find_spans(jwt)] == ["jwt"] and find_spans("eyJub3Q.e30.abc") == []


def test_redaction(spark):
    assert redact("a password=abcdefg b", find_spans("a password=abcdefg b")) == "a [secret] b"
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "clean"), (4, "token: abcdef é")], "i int, text string")
    out = dict(rows.select("i", redact_secrets(F.col("text"))).collect())
    assert out == {1: None, 2: "", 3: "clean", 4: "[secret] é"}


def test_token_counts(spark, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(Q.TOKENIZER))
    for text, found in both(spark, tmp_path, Q.op10_token_counts):
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (len(text.encode()), n, n > 1024) in [(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found]


@pytest.mark.parametrize("query", [Q.op7_licenses, Q.op8_secrets, Q.op10_token_counts])
def test_empty_table(spark, tmp_path, query):
    assert query(spark, documents(spark, tmp_path, [])).count() == 0


def test_whole_tokens_are_proved():
    from understory.llm.token_counts import prove_whole_tokens

    path = public_tokenizers.path(Q.TOKENIZER)
    whole = prove_whole_tokens(path, public_tokenizers.PATTERN)
    tokenizer = Tokenizer.from_file(path)
    assert len(whole) > 40_000 and " the" in whole
    assert all(len(tokenizer.encode(s, add_special_tokens=False).ids) == 1 for s in whole[::500])


def test_every_code_point_counts_as_the_tokenizer_does(spark):
    """In the patterns x's, 1x2 and  x!x; characters of differing classes in texts of their own."""
    from understory.llm import token_counts as T

    path, pattern = public_tokenizers.path(Q.TOKENIZER), public_tokenizers.PATTERN
    differing = T.differing_characters(spark, pattern)
    assert {"\u088f", "\ua7d2", "\U00010940"} <= set(differing) and not set("aé1 中") & set(differing)
    count = T.text_counter(T.prove_whole_tokens(path, pattern), path, pattern, T.special_strings(path), differing)
    unlike = set(differing)
    plain = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and chr(c) not in unlike]
    few = plain[:3000] + plain[3000::50]  # counting every one takes minutes; all were compared by class above
    texts = ["\n".join(f"{c}'s 1{c}2 {c}!{c}" for c in few[lo:lo + 512]) for lo in range(0, len(few), 512)]
    texts += [t for c in differing[::25] + "\u088f\ua7d2\U00010940" for t in (f"{c}'s", f"1{c}2", f" {c}!{c}")]
    encoded = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    wrong = [t[:20] for t, e in zip(texts, encoded, strict=True) if count(t) != len(e.ids)]
    assert not wrong, (len(wrong), wrong[:5])
