import pytest
from pyspark.sql import functions as F

from understory import fixed_values as fv
from understory import functions as fn
from understory.profiles import ONE_YEAR, TWO_YEAR


def values(spark, column, data, kind):
    frame = spark.createDataFrame([(v,) for v in data], f"x {kind}")
    return [r[0] for r in frame.select(column).collect()]


def test_plot_area():
    assert fv.PLOT_AREA_AC == 0.15215543752239996


def test_size_classes_are_closed_on_the_right(spark):
    cm = [10.0, 25.4, 25.5, 76.2, 152.4, 177.8, 177.9, None]
    got = values(spark, fn.size_class(F.col("x") / fv.CM_PER_INCH), cm, "double")
    assert got == ["04-10", "04-10", "10-20", "20-30", "50-60", "60-70", None, None]


def test_size_class_edges_on_every_tenth_of_a_centimetre(spark):
    cm = [i / 10 for i in range(100, 1779)]
    got = values(spark, fn.size_class(F.col("x") / fv.CM_PER_INCH), cm, "double")
    want = [fv.SIZE_CLASSES[next(i for i, u in enumerate(fv.SIZE_CLASS_UPPER_IN) if v / 2.54 <= u)] for v in cm]
    assert got == want


@pytest.mark.parametrize("profile,pije", [(TWO_YEAR, "pine"), (ONE_YEAR, "unknown")])
def test_species_groups(spark, profile, pije):
    codes = ["ABCO", "PILA", "QUKE", "LIDE", "PIJE", "ZZZZ", None]
    got = values(spark, fn.species_group(F.col("x"), profile.species_codes), codes, "string")
    assert got == ["shade_tolerant", "pine", "hardwood", "tanoak", pije, "unknown", "unknown"]


def test_elevation_at_the_split_has_no_class(spark):
    got = values(spark, fn.elev_class(F.col("x"), F.lit(1305.0)), [1304.9, 1305.0, 1305.1, None], "double")
    assert got == ["Low elev", None, "High elev", None]


def test_membership_is_never_null(spark):
    got = values(spark, fn.is_one_of(F.col("x"), fv.TREATED_VALUES), [None, "y", "inferred", "n"], "string")
    assert got == [False, True, True, False]


def test_if_else_is_null_on_a_null_test(spark):
    got = values(spark, fn.if_else(F.col("x") == 1, F.lit("a"), F.lit("b")), [1, 2, None], "int")
    assert got == ["a", "b", None]


def test_project_code(spark):
    assert values(spark, fn.project_code(F.col("x")), ["TR_GV_R001", "abc", None], "string") == ["GV", "", None]


def test_cover_levels(spark):
    cover = fn.closed_levels(fn.recode(F.col("x"), fv.CWHR_COVER_CODES), fv.CWHR_COVERS)
    assert values(spark, cover, ["60+", "S", "25-40 percent open", None], "string") == ["D", "S", None, None]


def test_level_order_puts_null_last(spark):
    got = values(spark, fn.level_order(F.col("x"), fv.SPECIES_GROUPS), ["unknown", "pine", None, "other"], "string")
    assert got == [0, 3, 5, 5]


def test_aggregates(spark):
    frame = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("b", None), ("c", 2.0), ("c", 3.0)], "k string, x double"
    )
    got = {
        r.k: tuple(r)[1:]
        for r in frame.groupBy("k").agg(
            fn.zero_sum(F.col("x")), fn.strict_sum(F.col("x")), fn.count_true(F.col("x") > 1), fn.mean(F.col("x"))
        ).collect()
    }
    assert got == {"a": (1.0, None, 0, 1.0), "b": (0.0, None, 0, None), "c": (5.0, 5.0, 2, 2.5)}
