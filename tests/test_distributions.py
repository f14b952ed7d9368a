import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from understory.operators import density, figures, quantiles

PROBS = {"q1": 0.25, "median": 0.5, "q3": 0.75, "low": 0.0, "high": 1.0, "odd": 0.337}


def by_hand(data):
    groups = {}
    for g, v in data:
        if v is not None:
            groups.setdefault(g, []).append(v)
    return {g: [float(np.quantile(v, p)) for p in PROBS.values()] for g, v in groups.items()}


def check(spark, data, closed=None):
    frame = spark.createDataFrame(data, "g string, v double").repartition(5)
    got = quantiles.exact_quantiles(frame, ["g"], "v", PROBS, closed).collect()
    want = by_hand(data)
    assert {r.g for r in got} == set(want)
    for r in got:
        assert [r[name] for name in PROBS] == pytest.approx(want[r.g], rel=1e-12, abs=1e-12), r.g


GROUPS = ["even", "heavy", "ties", "one third", "single", "pair", "nulls"]


@pytest.mark.parametrize("accuracy", [100_000, 500])
def test_quantiles_against_numpy(spark, monkeypatch, accuracy):
    """The coarse sketch makes brackets real: most rows fall outside them."""
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "REACH", (2 / accuracy, *[d for d in (2e-3, 2e-2, 0.2) if d > 2 / accuracy]))
    rng = np.random.default_rng(5)
    data = [("even", float(v)) for v in rng.uniform(0, 1, 6001)]
    data += [("heavy", float(v)) for v in np.exp(rng.normal(0, 6, 6000))]
    data += [("ties", float(v)) for v in rng.integers(0, 4, 5000)]
    data += [("one third", 7.0)] * 2000 + [("one third", float(v)) for v in rng.normal(7, 1, 4000)]
    data += [(None, float(v)) for v in rng.normal(0, 1, 17)]
    data += [("single", 3.0), ("pair", 1.0), ("pair", 2.0), ("nulls", None), ("even", None)]
    check(spark, data)
    check(spark, data, closed={"g": GROUPS})


def rows_to_order(spark, n):
    frame = spark.range(n).select(F.lit("a").alias("g"), F.rand(3).alias("v"))
    sketch = quantiles._sketch(frame.withColumnRenamed("v", "_v"), ["g"], [0.5])
    b = sketch.select(quantiles._bracket(0, 0.5).alias("b")).first().b
    return frame.where((F.col("v") >= b.low) & (F.col("v") <= b.high)).count()


def test_brackets_do_not_grow_with_the_group(spark):
    """Within the sketch's error a hundred times the rows leave about as many to order."""
    few, many = rows_to_order(spark, 2_000), rows_to_order(spark, 200_000)
    assert 0 < many < 100 and many <= 5 * few


def test_closed_domain_names_every_column(spark):
    frame = spark.createDataFrame([("a", "x", 1.0)], "g string, h string, v double")
    with pytest.raises(ValueError, match="closed domain"):
        quantiles.exact_quantiles(frame, ["g", "h"], "v", {"m": 0.5}, {"g": ["a"]})


def false_brackets(place, p):
    """What a broken sketch would give: every wanted rank lies outside."""
    position = (F.col("n") - 1) * p
    low = F.floor(position)
    return F.struct(
        F.lit(p).alias("p"), low.alias("low_rank"), F.ceil(position).alias("high_rank"), (position - low).alias("weight"),
        F.lit(1e300).alias("low"), F.lit(2e300).alias("high"))


def test_missed_ranks_are_selected_exactly(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "_bracket", false_brackets)
    rng = np.random.default_rng(11)
    data = [("even", float(v)) for v in rng.normal(0, 1, 801)] + [("heavy", float(v)) for v in np.exp(rng.normal(0, 90, 500))]
    data += [("signs", v) for v in (-0.0, 0.0, -1e-300, 1e-300, -5.0, 5.0, -1e308, 1e308)] + [("ties", 2.0)] * 30 + [("ties", -2.0)] * 31
    data += [(None, float(v)) for v in range(7)] + [("single", 3.0), ("nulls", None)]
    check(spark, data)
    check(spark, data, closed={"g": ["even", "heavy", "signs", "ties", "single", "nulls"]})
    frame = spark.createDataFrame([(float(v),) for v in range(100)], "v double")
    assert quantiles.exact_quantiles(frame, [], "v", {"m": 0.5}).first().m == 49.5


def test_one_missed_group_leaves_the_others(spark, monkeypatch):
    """Only ranks that were missed are selected again; the results of the others are the bracket's."""
    honest = quantiles._bracket

    def sometimes(place, p):
        broken = F.col("g") == "broken"
        right, wrong = honest(place, p), false_brackets(place, p)
        return F.when(broken, wrong.cast("struct<p:double,low_rank:long,high_rank:long,weight:double,low:double,high:double>")).otherwise(
            right.cast("struct<p:double,low_rank:long,high_rank:long,weight:double,low:double,high:double>"))

    monkeypatch.setattr(quantiles, "_bracket", sometimes)
    rng = np.random.default_rng(12)
    check(spark, [(g, float(v)) for g in ("broken", "fine") for v in rng.normal(0, 1, 300)])


def test_bits_are_in_the_order_of_doubles(spark):
    values = [-np.inf, -1e308, -2.0, -1.0, -1e-310, 0.0, 1e-310, 1.0, 2.0, 1e308, np.inf, np.nan]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    bits = [r.b for r in frame.select("i", quantiles.ordered_bits(F.col("v")).alias("b")).orderBy("i").collect()]
    assert bits == sorted(bits) and len(set(bits)) == len(bits)


def test_a_round_counts_bits_not_rows(spark, monkeypatch):
    """No task orders a share of a group: a round's window runs over counts by 16 bits, not over values."""
    frame = spark.range(1000).select(F.lit("a").alias("g"), F.rand(1).alias("_v"))
    wanted = spark.createDataFrame([("a", 0.5, 500)], "g string, p double, rank long")
    got = quantiles.select_ranks(frame, wanted, ["g"])
    assert got.first().value == sorted(r._v for r in frame.collect())[500]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert len(windows) == 4 and all("next" in w and "_v#" not in w.split("windowspec")[1] for w in windows)


def test_nothing_missed_selects_nothing(spark, monkeypatch):
    frame = spark.range(5000).select((F.col("id") % 2).cast("string").alias("g"), F.rand(2).alias("v"))
    monkeypatch.setattr(quantiles, "select_ranks", None)
    assert quantiles.exact_quantiles(frame, ["g"], "v", {"m": 0.5}).count() == 2
    assert quantiles.exact_quantiles(frame, [], "v", {"m": 0.5}).count() == 1


def test_example_quartiles(spark):
    frame = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 10.0)], "g string, v double")
    assert rows(figures.box_hinges(frame, ["g"], "v")) == [("a", 1.75, 2.5, 4.75)]


def kernel_density(values, points):
    x = np.asarray(values)
    q1, q3 = np.quantile(x, [0.25, 0.75])
    bw = 0.9 * min(x.std(ddof=1), (q3 - q1) / 1.34) * len(x) ** -0.2
    z = (points[:, None] - x[None, :]) / bw
    return np.exp(-0.5 * z**2).sum(axis=1) / (len(x) * bw * np.sqrt(2 * np.pi))


def test_density_is_close_to_the_exact_kernel_sum(spark):
    rng = np.random.default_rng(8)
    values = {"a": rng.normal(50, 10, 400), "b": np.concatenate([rng.normal(0, 1, 150), rng.normal(9, 2, 150)])}
    data = [("p", g, float(v)) for g, xs in values.items() for v in xs]
    data += [("p", "single", 1.0), ("p", None, 1.0), ("p", None, 2.0), ("p", "flat", 4.0), ("p", "flat", 4.0)]
    frame = spark.createDataFrame(data, "panel string, x string, v double")
    got = density.violin_density(frame, "x", ["panel"], "v").toPandas()
    assert set(got.x.dropna()) == {"a", "b", "flat"} and got.x.isna().sum() == density.POINTS
    tallest = got.density.max()
    for g, xs in values.items():
        curve = got[got.x == g].sort_values("point")
        assert len(curve) == density.POINTS
        assert (curve.y.iloc[0], curve.y.iloc[-1]) == pytest.approx((xs.min(), xs.max()))
        exact = kernel_density(xs, curve.y.to_numpy())
        assert np.abs(curve.density.to_numpy() - exact).max() < 0.005 * exact.max()
        assert curve.violinwidth.to_numpy() == pytest.approx(curve.density.to_numpy() / tallest)
    flat = got[got.x == "flat"]
    assert flat.y.nunique() == 1 and np.isfinite(flat.density).all()


def test_stacked_bars(spark):
    data = [("s", "unknown", 1.0), ("s", "tanoak", 2.0), ("s", "hardwood", 3.0), ("t", "pine", 4.0)]
    frame = spark.createDataFrame(data, "x string, species_group string, v double")
    got = rows(figures.stacked_bars(frame, "x", [], "v").select("x", "species_group", "ymin", "ymax"))
    assert got == [("s", "hardwood", 0.0, 3.0), ("s", "tanoak", 3.0, 5.0), ("s", "unknown", 5.0, 6.0), ("t", "pine", 0.0, 4.0)]


def test_level_order_for_reading(spark):
    from understory.operators.trees import SPECIES_SIZE

    data = [("pine", "10-20"), ("unknown", None), ("unknown", "60-70"), ("tanoak", "04-10"), ("unknown", "04-10")]
    frame = spark.createDataFrame(data, "species_group string, size_class string")
    got = [tuple(r) for r in figures.in_level_order(frame, SPECIES_SIZE).collect()]
    assert got == [("unknown", "04-10"), ("unknown", "60-70"), ("unknown", None), ("tanoak", "04-10"), ("pine", "10-20")]


PLOTS = "plot_id string, cwhr_type string, cwhr_size string, cwhr_cover string, elev_class string"


def test_habitat_points(spark):
    data = [("a", "DFR", "0", "S", "Low elev"), ("b", "DFR", "6", "D", None), ("c", "DFR", "7", "D", "Low elev"),
            ("d", "DFR", None, "D", "Low elev"), ("e", None, "3", "D", "Low elev"), ("f", "DFR", "3", None, "Low elev"),
            ("g", "DFR", "3.0", "D", "Low elev")]
    frame = spark.createDataFrame(data, PLOTS)
    assert rows(figures.habitat_points(frame), "plot_id", "cwhr_size") == [("a", "0"), ("b", "6"), ("g", "3")]
    as_number = frame.withColumn("cwhr_size", F.col("cwhr_size").cast("double"))
    assert rows(figures.habitat_points(as_number), "plot_id") == [("a",), ("b",), ("g",)]
    assert (None, "6", "D", "DFR", 1) in rows(figures.habitat_counts(frame, "elev_class"))


def test_filter_on_open_cover_labels_changes_nothing(spark):
    """The labels are no cover levels, so they are null before the filter."""
    from understory import fixed_values as fv
    from understory.functions import closed_levels, recode

    labels = ["25-40 percent open", "24-40% open", "60+", "S"]
    frame = spark.createDataFrame([("p", "DFR", "3", c, None) for c in labels], PLOTS)
    cover = closed_levels(recode(F.col("cwhr_cover"), fv.CWHR_COVER_CODES), fv.CWHR_COVERS)
    points = figures.habitat_points(frame.withColumn("cwhr_cover", cover))
    assert rows(points, "cwhr_cover") == rows(points.where(~F.col("cwhr_cover").isin(labels[:2])), "cwhr_cover")


def test_paired_lines(spark):
    data = [("P", "a", "2024", 1.0, True), ("P", "a", "2025", 2.0, True), ("P", "b", "2024", 3.0, False), (None, "c", "2024", 4.0, None)]
    frame = spark.createDataFrame(
        data, "trt_project string, plot_id string, year string, ba_live_ft double, y2024_untrt_y2025_trt boolean"
    )
    assert rows(figures.paired_lines(frame)) == [("P", "a", "2024", 1.0, None), ("P", "a", "2025", 2.0, "a")]
