"""The pipeline, stage by stage, against what each stage's own operator decides on the stage's own input."""

import pytest

import corpus_pipeline
from tests.llm.test_near_copies import counted, plain_groups, words_of
from understory.llm.secret_spans import find_spans
from understory.llm.toxicity import train_on

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """(name, rows in, rows out) of every stage, written and read again."""
    folder = tmp_path_factory.mktemp("steps")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{i}")
        after = spark.read.parquet(f"{folder}/{i}")
        out.append((name, docs, after))
        docs = after
    return out


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_stages(steps):
    assert [name for name, _, _ in steps] == ["toxicity", "near_dedup", "decontamination", "secrets", "mixing"]
    for _, before, after in steps[:-1]:
        assert after.dtypes == before.dtypes
    for _, before, after in steps:
        assert set(ids(after)) <= set(ids(before))


def test_toxic_documents_go(spark, steps):
    _, before, after = steps[0]
    model = train_on(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == sorted(r["doc_id"] for r in before.collect() if model.score(r["text"]) < 0.5)


def test_one_of_each_group_stays(steps):
    _, before, after = steps[1]
    groups = plain_groups([(r["doc_id"], r["text"]) for r in before.collect()])
    assert ids(after) == sorted({i for i, _, first in groups if i == first}) and len(ids(after)) < len(ids(before))


def test_leaks_go(spark, steps):
    _, before, after = steps[2]
    items = [counted(words_of(r["text"])).keys() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = set()
    for r in before.collect():
        held = counted(words_of(r["text"])).keys()
        if any(len(held & item) >= 0.8 * len(item) for item in items):
            leaked.add(r["doc_id"])
    assert ids(after) == sorted(set(ids(before)) - leaked) and leaked


def test_secrets_are_gone(steps):
    _, before, after = steps[3]
    old, new = ({r["doc_id"]: r for r in f.collect()} for f in (before, after))
    assert old.keys() == new.keys()
    for i, r in new.items():
        if find_spans(old[i]["text"]):
            assert not find_spans(r["text"]) and r["n_chars"] == len(r["text"])
        else:
            assert r == old[i]


def test_rates(steps):
    _, before, after = steps[4]
    assert ids(after) == ids(before) and after.where("rate < 0 or rate is null").isEmpty()
    texts = [sorted(map(repr, f.select("doc_id", "text").collect())) for f in (before, after)]
    assert texts[0] == texts[1]


def test_run_is_the_stages(spark, steps):
    assert ids(corpus_pipeline.run(spark, SF)) == ids(steps[-1][2])


def test_odd_rows_pass(spark, tmp_path):
    """No id, no text, repeated rows, extra columns and no rows at all."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, n int"
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(1, None), (1, None), (2, ""), (None, long), (3, long), (3, long), (4, long + " end"), (5, "token: abcdefgh"), (None, None)]
    frame = spark.createDataFrame([(i, t, None, None, None, 1.0, "k", 1) for i, t in rows], columns)
    for docs in (frame, frame.where("false")):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            path = f"{tmp_path}/{docs.count()}-{i}-{frame.count()}"
            stage(spark, docs, SF).write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
            assert docs.columns == frame.columns
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert sorted(map(repr, last.select("doc_id", "text").collect())) == sorted(map(repr, docs.select("doc_id", "text").collect()))
        if not docs.isEmpty():
            left = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
            assert left == sorted([(1, None), (2, ""), (None, long), (3, long), (5, "[secret]"), (None, None)], key=repr)


def test_secrets_without_a_length_column(spark):
    docs = spark.createDataFrame([(1, "token: abcdefgh", "x"), (2, None, "y")], "doc_id long, text string, lang string")
    assert sorted(map(tuple, corpus_pipeline.redact(spark, docs, SF).collect())) == [(1, "[secret]", "x"), (2, None, "y")]


def test_mostly_toxic_labels(spark, tmp_path):
    """Rows without a word stay whatever the labelled share, and all rows do where nothing could be learned."""
    blank = [(9001, None), (9002, ""), (9003, " \n\u00a0"), (None, None)]
    for name, n in (("few", 4), ("many", 200)):
        rows = [(i, f"swine rotter blast word{i} more{i % 7}" if i % 5 else f"kind words only{i} and more{i % 7}") for i in range(n)]
        spark.createDataFrame([(i, 1, int(i % 5 > 0), "x") for i, _ in rows], "doc_id long, quality int, toxic int, text string"
                              ).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = spark.createDataFrame(rows + blank, "doc_id long, text string")
        left = {(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_toxic(spark, docs, f"{tmp_path}/{name}").collect()}
        assert set(blank) <= left
        assert left == {*rows, *blank} if name == "few" else len(left) < n


def test_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    numbers = sorted(int(q[2:].split("_")[0]) for q in __spark_entry__.queries() if q.startswith("op") and q[2].isdigit())
    assert numbers == list(range(1, 14))
