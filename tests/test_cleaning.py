import random

from pyspark.sql import functions as F

from tests.conftest import rows
from understory.operators import checks, corrections, duplicates
from understory.profiles import SURVEY_CORRECTIONS, RecodePlots, SetValue


def test_recode_touches_its_year_only(spark):
    frame = spark.createDataFrame(
        [("2024", "TR_GY_R001"), ("2025", "TR_GY_R001"), ("2024", "TR_TP_101"), ("2024", None)],
        "year string, plot_id string",
    )
    got = rows(corrections.recode_plot_ids(frame, SURVEY_CORRECTIONS.recodes))
    assert got == [("2024", "TR_GV_R001"), ("2024", "TR_TP_101"), ("2024", None), ("2025", "TR_GY_R001")]


def test_diameter_fix_needs_upper_case_and_leaves_nulls(trees_of):
    trees = trees_of([
        ("2025", "TR_TP_103", 1.0, "PSME", "L", 168.0),
        ("2025", "TR_TP_103", 2.0, "psme", "L", 168.0),
        ("2024", "TR_TP_103", 3.0, "PSME", "L", 168.0),
        ("2025", "TR_TP_103", 4.0, "PSME", "L", None),
        ("2025", "TR_TP_103", 5.0, None, "L", 168.0),
    ])
    got = rows(corrections.set_values(trees, SURVEY_CORRECTIONS.tree_values), "tree_num", "dbh_cm")
    assert got == [(1.0, 16.8), (2.0, 168.0), (3.0, 168.0), (4.0, None), (5.0, 168.0)]


def test_renumbering_is_null_where_undecided(trees_of):
    trees = trees_of([
        ("2025", "TR_TP_121", 23.0, "CADE", "L", 15.0),
        ("2025", "TR_TP_121", 23.0, "CADE", "L", 40.0),
        ("2025", "TR_TP_121", 23.0, "CADE", "D", None),
        ("2024", "TR_TP_121", 23.0, "ABCO", "L", None),
        ("2025", "TR_TP_121", 24.0, "ABCO", "D", None),
    ])
    fixed = corrections.set_values(trees, SURVEY_CORRECTIONS.tree_values)
    got = [r.tree_num for r in fixed.orderBy("src_row").collect()]
    assert got == [9000.0, 23.0, None, 23.0, 24.0]


def test_changed_rows(trees_of):
    trees = trees_of([
        ("2025", "TR_TP_103", 1.0, "PSME", "L", 168.0), ("2025", "TR_TP_103", 2.0, "PSME", "L", 20.0),
    ])
    got = rows(corrections.changed_rows(trees, SURVEY_CORRECTIONS.tree_values, ["tree_num", "dbh_cm"]))
    assert got == [(1.0, 16.8)]


def keep_later_by_hand(data, surveys):
    for survey in surveys:
        seen, kept = set(), []
        for row in data:
            key = row[:3]
            first = key not in seen
            seen.add(key)
            if not (first and key[:2] == survey):
                kept.append(row)
        data = kept
    return data


def test_keep_later_surveys(trees_of):
    data = [
        ("2024", "A", 1.0, "x", "L", 11.0), ("2024", "A", 2.0, "x", "L", 12.0), ("2024", "A", 3.0, "x", "L", 13.0),
        ("2024", "A", 1.0, "y", "L", 21.0), ("2024", "A", 2.0, "y", "L", 22.0), ("2024", "A", 1.0, "z", "L", 31.0),
        ("2025", "A", 1.0, "x", "L", 41.0), ("2024", "A", None, "x", "L", 1.0), ("2024", "A", None, "y", "L", 2.0),
        (None, None, 1.0, "x", "L", 51.0), ("2024", None, 1.0, "x", "L", 52.0),
    ]
    for surveys in ([("2024", "A")], [("2024", "A"), ("2024", "A")], [("2024", "A"), ("2025", "A")], []):
        got = rows(duplicates.keep_later_surveys(trees_of(data), surveys).drop("src_row"))
        assert got == sorted(keep_later_by_hand(data, surveys), key=repr), surveys


def test_keep_later_with_identical_copies_and_a_hot_tree(trees_of):
    rng = random.Random(1)
    data = [("2024", "A", 7.0, "x", "L", 20.0)] * 200
    data += [("2024", rng.choice("AB"), float(rng.randrange(20)), "x", "L", 15.0) for _ in range(200)]
    rng.shuffle(data)
    got = rows(duplicates.keep_later_surveys(trees_of(data), [("2024", "A")]).drop("src_row"))
    assert got == sorted(keep_later_by_hand(data, [("2024", "A")]), key=repr)


def test_keep_later_names_a_recoded_plot(trees_of):
    recodes = [RecodePlots("2024", {"OLD": "NEW"})]
    assert duplicates.source_surveys([("2024", "NEW"), ("2025", "NEW")], recodes) == [
        ("2024", "OLD"), ("2024", "NEW"), ("2025", "NEW"),
    ]
    assert duplicates.source_surveys([("2024", "OLD")], recodes) == []
    data = [("2024", "OLD", 1.0, "x", "L", 11.0), ("2024", "NEW", 1.0, "y", "L", 12.0), ("2024", "B", 1.0, "z", "L", 1.0)]
    kept = duplicates.keep_later_surveys(
        trees_of(data), [("2024", "NEW")], lambda f: corrections.recode_plot_ids(f, recodes), recodes
    )
    assert rows(kept, "plot_id", "species_code") == [("B", "z"), ("NEW", "y")]


def test_later_rows_treat_null_keys_as_equal(trees_of):
    data = [("2024", "A", None, "x", "L", 1.0), ("2024", "A", None, "y", "L", 2.0), ("2024", "A", 1.0, "z", "L", 3.0)]
    assert rows(duplicates.later_rows(trees_of(data)), "species_code") == [("y",)]
    flags = duplicates.flag_later(trees_of(data)).orderBy("src_row").select("is_later").collect()
    assert [r[0] for r in flags] == [False, True, False]


def test_fingerprint(trees_of):
    data = [
        ("2024", "A", 1.0, "PSME", "L", 20.0), ("2024", "A", 2.0, "ABCO", "L", 40.0),
        ("2024", "A", 1.0, "PSME", "D", None), ("2025", "A", 1.0, "PSME", "L", 20.0),
        ("2025", "B", 1.0, "PSME", "L", 20.0),
    ]
    got = [
        (r.plot_year, r.species_code, None if r.ba is None else round(r.ba, 6))
        for r in checks.survey_fingerprint(trees_of(data), "A").collect()
    ]
    assert got == [
        ("2024a", "ABCO", 12.566371), ("2024a", "PSME", 3.141593), ("2024b", "PSME", None), ("2025", "PSME", 3.141593),
    ]


def test_value_fix_that_raises_a_diameter_is_seen_by_the_size_limit(trees_of):
    fixes = [SetValue({"plot_id": "A"}, "dbh_cm", 30.0)]
    fixed = corrections.set_values(trees_of([("2024", "A", 1.0, "x", "L", 3.0)]), fixes)
    assert fixed.where(F.col("dbh_cm") >= 10).count() == 1


def test_checks(trees_of, plots_of):
    trees = trees_of([
        ("2024", "A", 1.0, "psme", "L", 178.0), ("2024", "A", 1.0, "PSME", "L", 20.0), ("2024", "C", 1.0, None, "L", None),
    ])
    plots = plots_of([("2024", "A", "s", None, 1.0, 1.0), ("2024", "B", "s", None, 1.0, 1.0)] * 2)
    keys = ["year", "plot_id"]
    assert rows(checks.ids_missing_from(plots, trees, keys)) == [("2024", "B")]
    assert rows(checks.ids_missing_from(trees, plots, keys)) == [("2024", "C")]
    assert rows(checks.repeated_keys(plots, keys)) == [("2024", "A", 2), ("2024", "B", 2)]
    assert rows(checks.oversize_trees(trees, keys)) == [("2024", "A", 1)]
    assert rows(checks.species_frequency(trees)) == [("PSME", 2)]


def test_a_frequent_key_is_spread_in_proportion(spark):
    """A key with a third of the rows gets a third of the pieces, others none; nulls are keys."""
    from understory.operators import joins

    keys = [("a", 4000), (None, 2000), ("b", 2), ("c", 1)]
    data = [(k, i) for k, n in keys for i in range(n)] + [(f"r{i}", i) for i in range(6000)]
    rows_ = spark.createDataFrame(data, "k string, i long")
    table = rows_.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    met = joins.join_by_frequency(rows_, table, ["k"], F.col("n"), F.col("i"))
    assert met.columns == ["k", "i", "n", "first"] and met.count() == len(data)
    assert met.where("n is null or first != 0 and k not like 'r%'").count() == 0
    pieces = {k: round(n * joins.PIECES / len(data)) for k, n in keys[:2]}
    spread = spark.createDataFrame([(pieces[k], i) for k, n in keys[:2] for i in range(n)], "p int, i long")
    used = dict(map(tuple, spread.groupBy("p").agg(F.countDistinct(joins.salt(F.col("p"), F.col("i")))).collect()))
    assert used[pieces["a"]] > 0.5 * 4000 and used[pieces[None]] > 0.5 * 2000


def test_pieces_of_a_frequent_key_meet_in_many_tasks(spark):
    from understory.operators import duplicates

    data = [("2024", "P", 1.0, i) for i in range(3000)] + [("2024", f"Q{i}", 1.0, 3000 + i) for i in range(6000)]
    trees = spark.createDataFrame(data, "year string, plot_id string, tree_num double, src_row long")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        later = duplicates.later_rows(trees)
        tasks = later.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in tasks) == 2999
    assert len(tasks) >= 12 and max(r["count"] for r in tasks) < 600
