"""Toxicity by held-out accuracy; mixing against a plain solver."""

import random
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from understory.llm import mixing
from understory.llm import queries as Q
from understory.llm.toxicity import Model, held_out, train, train_on, windows

SF = "/root/testdata/sf0.01"
VILE = ["blast", "rotter", "swine"]


def corpus(seed, n, share=0.3):
    """Texts of common and rare words; toxic ones hold a few of VILE."""
    rng = random.Random(seed)
    common = ["".join(rng.choices("aeioulnrst", k=rng.randrange(2, 7))) for _ in range(300)]
    out = []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randrange(20, 200))]
        toxic = rng.random() < share
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(VILE))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_held_out_accuracy():
    rows = corpus(1, 1200)
    model = train([t for i, t, y in rows if y and i < 800], [t for i, t, y in rows if not y and i < 800], 0.3)
    right = [(model.score(t) >= 0.5) == bool(y) for i, t, y in rows if i >= 800]
    assert sum(right) / len(right) > 0.95


def test_query_on_the_table(spark):
    found = Q.op2_toxicity(spark, SF).collect()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    tested = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in tested) / len(tested) >= 0.9


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = train_on(docs, labels), train_on(docs, flipped)
    assert a.toxic == b.toxic and (a.weights == b.weights).all() and a.prior == b.prior


def table(spark, path, docs, labels):
    spark.createDataFrame([(i, t, 5, "s") for i, t in docs], "doc_id long, text string, score int, rate string").write.parquet(
        f"{path}/documents.parquet")
    spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string").write.parquet(
        f"{path}/labels.parquet")
    return str(path)


ODD_DOCS = [(1, None), (2, ""), (3, " \n "), (4, "word"), (4, "word"), (None, "no id"), (5, "swine " * 50_000), (6, "😀 ß\x00 é")]
ODD_LABELS = [(1, 1, 0), (2, None, 1), (None, 1, 1), (4, 1, 0), (4, 0, 1), (99, 1, 0), (5, 7, 7), (6, 0, None)]


@pytest.mark.parametrize("docs,labels", [(ODD_DOCS, ODD_LABELS), (ODD_DOCS, []), ([], ODD_LABELS), ([], []),
                                         ([(i, t) for i, t, _ in corpus(2, 60)], [(i, 1, y) for i, _, y in corpus(2, 60)])])
def test_odd_tables(spark, tmp_path, docs, labels):
    folder = table(spark, tmp_path, docs, labels)
    scored = Q.op2_toxicity(spark, folder).collect()
    mixed = Q.op4_mixing(spark, folder).collect()
    assert len(scored) == len(mixed) == len(docs)
    assert all(0 <= r["score"] <= 1 for r in scored) and all(r["rate"] >= 0 for r in mixed)
    for r in mixed:
        assert abs(sum(r[f"p_{d}"] for d in mixing.DOMAINS) - 1) < 1e-6
        if not r["n_tokens"]:
            assert r["rate"] == 1.0


def test_windows_are_the_whole_text():
    text = "A b  C\n" * 37
    assert b"".join(windows(text)).split() == text.lower().encode().split()
    assert train([], ["a b"], 0.2).score("any text") == pytest.approx(0.2) and train(["x"], [], 1.0).score("y") > 0.99
    assert windows("") == windows(" \n") == [] and Model(b"a", b"b", prior=0.2).score(" ") == 0.2


def mixed_totals(rows, rates, names):
    return {d: sum(r["n_tokens"] * r[f"p_{d}"] * q for r, q in zip(rows, rates, strict=True)) for d in names}


def test_totals_match_targets(spark):
    found = Q.op4_mixing(spark, SF).collect()
    total = sum(r["n_tokens"] for r in found)
    reached = mixed_totals(found, [r["rate"] for r in found], mixing.DOMAINS)
    for d, share in mixing.TARGETS.items():
        assert reached[d] == pytest.approx(share * total, rel=1e-3)


def test_rates_against_a_plain_solver(spark):
    """The same steps in numpy over all rows at once, on targets that are out of reach as well."""
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.4, 0.4, 0.4], 300)
    tokens = rng.integers(1, 500, 300)
    frame = spark.createDataFrame([(int(n), *map(float, q)) for n, q in zip(tokens, p, strict=True)],
                                  "n_tokens long, p_a double, p_b double, p_c double")
    total = float(tokens.sum())
    for shares in ({"a": 0.2, "b": 0.3, "c": 0.5}, {"a": 0.98, "b": 0.01, "c": 0.01}, {"a": 1.0, "b": 0.0, "c": 0.2}):
        rate, totals = mixing.fit_rates(frame, {d: s * total for d, s in shares.items()})
        names = [d for d in shares if shares[d] > 0]
        rates = np.array([r[0] for r in frame.select(rate.alias("rate")).collect()])
        a = np.stack([tokens * p[:, "abc".index(d)] / (shares[d] * total) for d in names])
        assert (rates >= 0).all() and np.allclose(a @ rates * [shares[d] * total for d in names], totals)
        plain, r = 1 / np.linalg.norm(a @ a.T, 2), np.ones(300)
        for _ in range(60_000):
            r = np.maximum(0, r - plain * a.T @ (a @ r - 1))
        assert np.linalg.norm(a @ rates - 1) <= np.linalg.norm(a @ r - 1) + 1e-3


def stages_of(spark, work):
    """(what ``work`` returns, the number of stages of each of its jobs)."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    return out, [len(tracker.getJobInfo(job).stageIds) for job in tracker.getJobIdsForGroup(group)]


def test_a_step_of_the_rates_is_one_stage(spark):
    """Steps are many, and what the driver plans and keeps grows with their stages; a null chance counts as none."""
    frame = spark.range(0, 400, 1, 4).selectExpr(
        "id % 90 + 1 as n_tokens", "if(id % 7 = 0, null, 0.9D) as p_a", "0.1D + (id % 5) / 100D as p_b")
    (rate, totals), stages = stages_of(spark, lambda: mixing.fit_rates(frame, {"a": 10.0, "b": 90_000.0}))
    assert len(stages) > 6 and sum(n > 1 for n in stages) <= 1
    rows = frame.withColumn("rate", rate).collect()
    assert all(r["rate"] >= 0 for r in rows)
    for name, total in zip("ab", totals, strict=True):
        assert sum(r["n_tokens"] * (r[f"p_{name}"] or 0) * r["rate"] for r in rows) == pytest.approx(total, rel=1e-9)


def test_a_pass_over_the_sample_has_few_stages(spark):
    docs = spark.range(0, 600, 1, 24).selectExpr("id as doc_id", "concat('w', id % 3, ' v', id % 11, ' x', id) as text")
    labels = spark.range(600).selectExpr("id as doc_id", "int(id % 2) as quality", "int(id % 3 = 0) as toxic")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        model, stages = stages_of(spark, lambda: mixing.fit_domains(docs, labels))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert model.numClasses == 4 and max(stages[-5:]) <= 2
