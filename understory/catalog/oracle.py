"""Reference SQL for the registered queries.

Written as the plain textbook form of each table, on purpose unlike the Spark
plans: windows instead of position joins, grids joined to cells instead of
nested maps, means over filled rows, built-in quantiles.
"""

from __future__ import annotations

import re

from understory import fixed_values as fv
from understory.catalog import inputs
from understory.catalog.queries import SHAPES

AREA = repr(fv.PLOT_AREA_AC)


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _domain(levels) -> str:
    rows = ", ".join(f"('{v}', {i})" for i, v in enumerate(levels))
    return f"select * from (values {rows}) t(level, ord)"


def _named(expressions: dict[str, str]) -> str:
    return ", ".join(f"{sql} as {name}" for name, sql in expressions.items())


def _same(left: str, right: str, keys) -> str:
    return " and ".join(f"{left}.{k} is not distinct from {right}.{k}" for k in keys)


def _cols(alias: str, names) -> str:
    return ", ".join(f"{alias}.{n}" for n in names)


SIZE_CASE = (
    "case when dbh_cm / 2.54e0 <= 10 then '04-10' when dbh_cm / 2.54e0 <= 20 then '10-20'"
    " when dbh_cm / 2.54e0 <= 30 then '20-30' when dbh_cm / 2.54e0 <= 40 then '30-40'"
    " when dbh_cm / 2.54e0 <= 50 then '40-50' when dbh_cm / 2.54e0 <= 60 then '50-60'"
    " when dbh_cm / 2.54e0 <= 70 then '60-70' end"
)
COVER_CASE = (
    "case when cwhr_cover = '60+' then 'D' when cwhr_cover in ('S', 'P', 'M', 'D') then cwhr_cover end"
)
TYPE_CASE = (
    "case when cwhr_type in ('Douglas fir', 'Douglas Fir') then 'DFR' when cwhr_type = 'Ponderosa Pine' then 'PPN'"
    " when cwhr_type = 'Sierran mixed conifer' then 'SMC' else cwhr_type end"
)
CELL_SUMS = (
    "count(*) filter (where status = 'L') as n_live_gt10cm,"
    " count(*) filter (where status = 'L' and dbh_cm > {cut}) as n_live_gt10in,"
    " count(*) filter (where status = 'D' and dbh_cm > {cut}) as n_dead_gt10in,"
    " count(*) filter (where status = 'D') as n_dead_gt10cm,"
    " coalesce(sum(ba_ft) filter (where status = 'L'), 0e0) as ba_live_ft,"
    " coalesce(sum(ba_ft) filter (where status = 'D'), 0e0) as ba_dead_ft,"
    " coalesce(sum(dbh_in * dbh_in) filter (where status = 'L'), 0e0) as dbh2_live"
)
CELL_METRICS = (
    "sqrt(dbh2_live / nullif(n_live_gt10cm, 0)) as qmd_live_in, ba_live_ft / {area} as ba_live_sqfac,"
    " n_live_gt10cm / {area} as tpa_live_gt10cm, n_live_gt10in / {area} as tpa_live_gt10in,"
    " n_dead_gt10in / {area} as tpa_snags_gt10in"
).format(area=AREA)
CELL_MEASURES = ["n_live_gt10cm", "n_live_gt10in", "n_dead_gt10in", "ba_live_ft", "qmd_live_in", "ba_live_sqfac",
                 "tpa_live_gt10cm", "tpa_live_gt10in", "tpa_snags_gt10in"]
MEANS = ["n_live_gt10cm", "n_live_gt10in", "n_dead_gt10in", "ba_live_ft", "qmd_live_in",
         "tpa_live_gt10cm", "tpa_live_gt10in", "tpa_snags_gt10in"]
VIOLINS = ["ba_live_ft", "tpa_live_gt10cm", "ba_dead_ft", "tpa_dead_gt10cm"]


def base_tables(two_year: bool) -> dict[str, str]:
    """Named subqueries, from raw tables to plot-level tables."""
    keys = ["year", "plot_id"] if two_year else ["plot_id"]
    key_list = ", ".join(keys)
    dims = ["elev_m", "elev_class", "trt_ctl"]
    if two_year:
        dims += ["treated_simp", "trt_project", "y2024_untrt_y2025_trt"]
    cut = "25.4e0" if two_year else "10e0"
    pine = "('PILA', 'PINUS', 'PIPO', 'PIJE')" if two_year else "('PILA', 'PINUS', 'PIPO')"
    dead_10cm = "n_dead_gt10cm" if two_year else "n_dead_gt10in"
    split = "1305e0" if two_year else "(select median(elev_m) from located)"
    fixed_id = "case when year = '2024' and plot_id = 'TR_P2_2' then 'TR_Q2_2' else plot_id end as plot_id"

    t: dict[str, str] = {}
    t["species"] = _domain(fv.SPECIES_GROUPS)
    t["sizes"] = _domain(fv.SIZE_CLASSES)
    t["dem"] = (
        f"select cell_x, cell_y, {inputs.ELEVATION} as elev_m from (select a.range as cell_x, b.range as cell_y"
        f" from range({inputs.DEM_SIDE}) a cross join range({inputs.DEM_SIDE}) b)"
    )
    if two_year:
        t["raw_plots"] = (
            f"select year, {_named(inputs.PLOTS)}, {_named(inputs.OTHER_COLUMNS)}, suffix,"
            f" {inputs.TREATED} as treated, {inputs.EASTING_BY_YEAR} as Easting"
            " from (select s.*, y.year, '' as suffix from supplier s cross join (values ('2024'), ('2025')) y(year)"
            f" union all select s.*, '2024', '{inputs.BARE_SUFFIX}' from supplier s where {inputs.BARE})"
            f" where {inputs.VISITED}"
        )
        t["raw_trees"] = (
            f"select {inputs.TREE_YEAR} as year, {_named(inputs.TREES)}, row_number() over () as src_row from lineitem"
        )
        t["raw_fuels"] = f"select {inputs.FUEL_YEAR} as year, {_named(inputs.FUELS)} from events"
        t["all_plots"] = "select * exclude (suffix) replace (concat(plot_id, suffix) as plot_id) from raw_plots"
        t["plots0"] = (
            f"select * replace ({fixed_id}) from all_plots where year = '2024' or Easting is not null"
        )
        t["recoded_trees"] = f"select * replace ({fixed_id}) from raw_trees"
        t["dbh_fixed"] = (
            "select * replace (case when year = '2025' and plot_id = 'TR_P1_1' and species_code = 'PSME'"
            " and dbh_cm = 171e0 then 17.1e0 else dbh_cm end as dbh_cm) from recoded_trees"
        )
        renumber = "year = '2025' and plot_id = 'TR_P2_2' and tree_num = 15e0 and dbh_cm = 54.5e0"
        t["fixed_trees"] = (
            f"select * replace (case when {renumber} then 9000e0 when not ({renumber}) then tree_num end as tree_num)"
            " from dbh_fixed"
        )
        t["numbered_trees"] = (
            "select *, row_number() over (partition by year, plot_id, tree_num order by src_row) as occurrence"
            " from fixed_trees"
        )
        t["trees"] = (
            "select * exclude (occurrence) from numbered_trees where not (occurrence = 1 and"
            " ((year = '2024' and plot_id = 'TR_P3_3') or (year = '2025' and plot_id = 'TR_P0_4')))"
        )
        t["fuels"] = f"select * replace ({fixed_id}) from raw_fuels"
    else:
        t["plots0"] = f"select {_named(inputs.PLOTS)}, {inputs.EASTING} as Easting from supplier"
        t["trees"] = f"select {_named(inputs.TREES)} from lineitem"
        t["fuels"] = f"select {_named(inputs.FUELS)} from events"
    t["located"] = (
        "select p.* exclude (Easting, Northing), d.elev_m from plots0 p left join dem d"
        " on cast(floor((p.Easting - 640000e0) / 30) as bigint) = d.cell_x"
        " and cast(floor((p.Northing - 4370000e0) / 30) as bigint) = d.cell_y"
    )
    flags = (
        ", coalesce(treated in ('y', 'inferred'), false) as treated_simp,"
        " split_part(plot_id, '_', 2) as trt_project" if two_year else ""
    )
    t["plots"] = (
        f"select * replace ({TYPE_CASE} as cwhr_type, {COVER_CASE} as cwhr_cover),"
        f" case when elev_m < {split} then 'Low elev' when elev_m > {split} then 'High elev' end as elev_class{flags}"
        " from located"
    )
    if two_year:
        t["paired"] = (
            "select distinct plot_id from plots where year = '2024' and not treated_simp"
            " and plot_id in (select plot_id from plots where year = '2025' and treated_simp)"
        )
        t["dim"] = (
            "select year, plot_id, elev_m, elev_class, Sample as trt_ctl, treated_simp, trt_project,"
            " plot_id in (select plot_id from paired) as y2024_untrt_y2025_trt from plots"
        )
    else:
        t["dim"] = "select plot_id, elev_m, elev_class, Sample as trt_ctl from plots"
    t["measured"] = (
        f"select * replace (upper(species_code) as species_code), dbh_cm / 2.54e0 as dbh_in,"
        " pi() * power(dbh_cm / 200, 2) * 10.7639e0 as ba_ft,"
        " case when upper(species_code) in ('ABCO', 'ABMA', 'CADE', 'PSME', 'TABR') then 'shade_tolerant'"
        f" when upper(species_code) in {pine} then 'pine'"
        " when upper(species_code) in ('ACMA', 'ARME', 'CONU', 'QUCH', 'QUKE') then 'hardwood'"
        f" when upper(species_code) = 'LIDE' then 'tanoak' else 'unknown' end as species_group,"
        f" {SIZE_CASE} as size_class from trees where dbh_cm >= 10"
    )
    sums = CELL_SUMS.format(cut=cut)
    for name, extra in (("plt", []), ("sp", ["species_group"]), ("size", ["species_group", "size_class"])):
        by = ", ".join([*keys, *extra])
        t[f"{name}_sums"] = f"select {by}, {sums} from measured group by {by}"
    t["observed"] = f"select distinct {key_list} from measured"
    t["trees_plt"] = (
        f"select m.* exclude (dbh2_live), sqrt(dbh2_live / nullif(n_live_gt10cm, 0)) as qmd_live_in,"
        f" ba_live_ft / {AREA} as ba_live_sqfac, ba_dead_ft / {AREA} as ba_dead_sqfac,"
        f" n_live_gt10cm / {AREA} as tpa_live_gt10cm, n_live_gt10in / {AREA} as tpa_live_gt10in,"
        f" {dead_10cm} / {AREA} as tpa_dead_gt10cm, n_dead_gt10in / {AREA} as tpa_dead_gt10in, {_cols('d', dims)}"
        f" from plt_sums m left join dim d on {_same('m', 'd', keys)}"
    )
    grid = {
        "sp": f"select {_cols('k', keys)}, s.level as species_group from observed k cross join species s",
        "size": (
            f"select {_cols('k', keys)}, s.level as species_group, z.level as size_class"
            " from observed k cross join species s cross join sizes z"
            f" union all select {key_list}, species_group, size_class from size_sums where size_class is null"
        ),
    }
    for name, extra in (("sp", ["species_group"]), ("size", ["species_group", "size_class"])):
        t[f"{name}_cells"] = f"select *, {CELL_METRICS} from {name}_sums"
        t[f"{name}_grid"] = grid[name]
        filled = ", ".join(f"coalesce(c.{m}, 0) as {m}" for m in CELL_MEASURES)
        t[f"{name}_dense"] = (
            f"select {_cols('g', [*keys, *extra])}, {filled}, {_cols('d', dims)} from {name}_grid g"
            f" left join {name}_cells c on {_same('g', 'c', [*keys, *extra])}"
            f" left join dim d on {_same('g', 'd', keys)}"
        )
    t["fuels_agg"] = (
        f"select {key_list}, coalesce(sum(count_1hr), 0e0) as count_1h, coalesce(sum(count_10h), 0e0) as count_10h,"
        " coalesce(sum(count_100h), 0e0) as count_100h, coalesce(sum(count_1000h), 0e0) as count_1000h"
        f" from fuels group by {key_list}"
    )
    t["mass"] = (
        "select *, 11.64e0 * count_1h * 0.021e0 * 0.56e0 * 1.023e0 / 13.12e0 as mass_1hr,"
        " 11.64e0 * count_10h * 0.212e0 * 0.55e0 * 1.023e0 / 13.12e0 as mass_10hr,"
        " 11.64e0 * count_100h * 2.672e0 * 0.53e0 * 1.023e0 / 19.68e0 as mass_100hr from fuels_agg"
    )
    t["fuels_mass"] = (
        f"select f.*, mass_1hr + mass_10hr + mass_100hr as mass_fine, {_cols('d', dims)}"
        f" from mass f left join dim d on {_same('f', 'd', keys)}"
    )
    t["fuels_long"] = (
        "select * exclude (mass_fine, mass_1hr, mass_10hr, mass_100hr), 'mass_fine' as fuel_class,"
        " mass_fine as mass_tons_ac from fuels_mass"
    )
    # stratum means over the filled tables
    in_year = "where year = '2024'" if two_year else ""
    for name, source, by, where in (
        ("trees_sp_elev", "sp_dense", ["species_group", "elev_class"], in_year),
        ("trees_sp_trtctl", "sp_dense", ["species_group", "trt_ctl"], in_year),
        ("trees_sp_size", "size_dense", ["species_group", "size_class"], in_year),
        ("trees_sp_size_elev", "size_dense", ["species_group", "size_class", "elev_class"], in_year),
        ("trees_sp_size_trtctl", "size_dense", ["species_group", "size_class", "trt_ctl"], in_year),
        ("trees_sp_trtuntrt", "sp_dense", ["species_group", "year", "trt_project"], "where y2024_untrt_y2025_trt"),
        ("trees_sp_size_y2024untrt_y2025trt", "size_dense",
         ["species_group", "size_class", "treated_simp", "year", "trt_project"],
         "where plot_id in (select plot_id from paired)"),
    ):
        if not two_year and ("untrt" in name):
            continue
        averages = ", ".join(f"avg({m}) as {m}" for m in MEANS)
        by_list = ", ".join(by)
        t[name] = f"select {by_list}, {averages} from {source} {where} group by {by_list}"
    unpivot = " union all ".join(
        f"select {{ids}}, '{m}' as measure, cast({m} as double) as value from trees_plt {{where}}" for m in VIOLINS
    )
    t["elev_long"] = unpivot.format(ids="elev_class", where="where elev_class is not null")
    t["trt_long"] = unpivot.format(ids="trt_ctl", where="")
    if two_year:
        t["paired_long"] = unpivot.format(ids="year, trt_project", where="where y2024_untrt_y2025_trt")
        t["fuels_paired"] = "select * from fuels_long where y2024_untrt_y2025_trt"
    t["complete_cwhr"] = (
        "select *, Sample as trt_ctl from plots where cwhr_size is not null and cwhr_cover is not null"
        " and cwhr_type is not null and cwhr_cover not in ('25-40 percent open', '24-40% open')"
        " and cwhr_size in ('0', '1', '2', '3', '4', '5', '6')"
    )
    return t


def with_needed(tables: dict[str, str], body: str) -> str:
    """Prefix ``body`` with the subqueries it mentions, directly or not."""
    needed: set[str] = set()
    open_texts = [body]
    while open_texts:
        words = set(re.findall(r"\w+", open_texts.pop()))
        found = [n for n in tables if n in words and n not in needed]
        needed.update(found)
        open_texts.extend(tables[n] for n in found)
    parts = ",\n".join(f"{n} as ({sql})" for n, sql in tables.items() if n in needed)
    return f"with {parts}\n{body}" if parts else body


def _stack(source: str, x: str, facets: list[str], value: str) -> str:
    by = ", ".join([*facets, x])
    return (
        f"select {by}, species_group, upper_end as ymax, upper_end - {value} as ymin from ("
        f"select m.*, sum({value}) over (partition by {by} order by s.ord desc"
        f" rows between unbounded preceding and current row) as upper_end"
        f" from ({source}) m join species s on m.species_group = s.level)"
    )


def _box(source: str, by: str, value: str) -> str:
    return (
        f"select {by}, quantile_cont({value}, 0.25) as q1, quantile_cont({value}, 0.5) as median,"
        f" quantile_cont({value}, 0.75) as q3 from {source} where {value} is not null group by {by}"
    )


def _violin(source: str, panel: list[str], x: str, value: str) -> str:
    by = [*panel, x]
    b = ", ".join(by)
    return f"""
select {_cols('c', by)}, c.n, c.point, c.y, c.density,
  c.density / max(c.density) over (partition by {_cols('c', panel)}) as violinwidth
from (
  with st0 as (
    select {b}, count(*) as n, min({value}) as lo, max({value}) as hi, stddev_samp({value}) as sd,
      quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25) as iqr
    from {source} where {value} is not null group by {b} having count(*) >= 2),
  st1 as (select *, 0.9e0 * power(n, -0.2e0) * case when least(sd, iqr / 1.34e0) > 0 then least(sd, iqr / 1.34e0)
      when sd > 0 then sd when abs(lo) > 0 then abs(lo) else 1e0 end as bw from st0),
  st as (select *, lo - 4 * bw as low, (hi + 4 * bw - (lo - 4 * bw)) / 511 as step from st1),
  pos as (select {_cols('st', by)}, (v.{value} - st.low) / st.step as spot
    from {source} v join st on {_same('v', 'st', by)} where v.{value} is not null),
  shares as (select {b}, floor(spot) as bin, 1 - (spot - floor(spot)) as w from pos
    union all select {b}, floor(spot) + 1, spot - floor(spot) from pos),
  bins as (select {b}, bin, sum(w) as w from shares group by all),
  knots as (select {_cols('st', by)}, j.range as knot,
      sum(bins.w * exp(-0.5e0 * power((j.range - bins.bin) * st.step / st.bw, 2)))
        / any_value(st.n * st.bw * sqrt(2 * pi())) as k
    from st join bins on {_same('st', 'bins', by)} cross join range(512) j group by {_cols('st', by)}, j.range),
  grid as (select st.*, i.range as point, lo + i.range * ((hi - lo) / 511) as y from st cross join range(512) i),
  placed as (select *, (y - low) / step as spot, least(floor((y - low) / step), 510) as below from grid)
  select {_cols('p', by)}, p.n, cast(p.point as int) as point, p.y, a.k + (z.k - a.k) * (p.spot - p.below) as density
  from placed p join knots a on {_same('p', 'a', by)} and a.knot = p.below
    join knots z on {_same('p', 'z', by)} and z.knot = p.below + 1
) c"""


def _tile_keys() -> str:
    """Inverse UTM by its series, then Web-Mercator tile and pixel."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    b1, b2, b3 = n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480
    d1, d2, d3 = 2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15
    return f"""
select year, plot_id, lon, lat, cast(floor(tx) as bigint) as tile_x, cast(floor(ty) as bigint) as tile_y,
  cast(floor((tx - floor(tx)) * 256) as bigint) as pixel_x, cast(floor((ty - floor(ty)) * 256) as bigint) as pixel_y
from (
  select *, (lon + 180) / 360 * 4096 as tx, (1 - asinh(tan(radians(lat))) / pi()) / 2 * 4096 as ty from (
    select year, plot_id, -123e0 + degrees(atan2(sinh(eta), cos(xi))) as lon,
      degrees(chi + {d1!r} * sin(2 * chi) + {d2!r} * sin(4 * chi) + {d3!r} * sin(6 * chi)) as lat from (
      select *, asin(sin(xi) / cosh(eta)) as chi from (
        select year, plot_id,
          x - {b1!r} * sin(2 * x) * cosh(2 * e) - {b2!r} * sin(4 * x) * cosh(4 * e)
            - {b3!r} * sin(6 * x) * cosh(6 * e) as xi,
          e - {b1!r} * cos(2 * x) * sinh(2 * e) - {b2!r} * cos(4 * x) * sinh(4 * e)
            - {b3!r} * cos(6 * x) * sinh(6 * e) as eta
        from (select year, plot_id, Northing / {radius!r} as x, (Easting - 500000e0) / {radius!r} as e
              from all_plots where Easting is not null)))))"""


def _tile_elevation() -> str:
    x0, y0 = inputs.PIXEL_ORIGIN
    inside = f"gx between {x0} and {x0 + inputs.PIXEL_SIDE - 1} and gy between {y0} and {y0 + inputs.PIXEL_SIDE - 1}"
    return (
        f"select *, case when {inside} then {inputs.TILE_ELEVATION} end as elev_m from (select *,"
        f" tile_x * 256 + pixel_x as gx, tile_y * 256 + pixel_y as gy from ({_tile_keys()}))"
    )


def _panels(source: str) -> str:
    """Panels numbered from the last, in each year."""
    return (
        "select *, dense_rank() over (partition by year order by trt_project desc nulls last) as panel_rank"
        f" from ({source})"
    )


def _count(source: str, name: str = "n", by: str = "year, plot_id") -> str:
    return f"select {by}, count(*) as {name} from {source} group by {by}"


STACKS = {
    "stack_size": ("trees_sp_size", "size_class", [], "tpa_live_gt10cm"),
    "stack_size_elev": ("trees_sp_size_elev", "size_class", ["elev_class"], "tpa_live_gt10cm"),
    "stack_size_trtctl": ("trees_sp_size_trtctl", "size_class", ["trt_ctl"], "tpa_live_gt10cm"),
    "stack_elev_tpa": ("trees_sp_elev", "elev_class", [], "tpa_live_gt10cm"),
    "stack_elev_ba": ("trees_sp_elev", "elev_class", [], "ba_live_ft"),
    "stack_trtctl_tpa": ("trees_sp_trtctl", "trt_ctl", [], "tpa_live_gt10cm"),
    "stack_trtctl_ba": ("trees_sp_trtctl", "trt_ctl", [], "ba_live_ft"),
}
PAIRED_SIZE = "trees_sp_size_y2024untrt_y2025trt"


# Surveyed plots under the recode that gives two of them one identifier.
COLLIDED = (
    "(select * replace (case when year = '2024' and plot_id = 'TR_P2_2' then 'TR_P3_3' else plot_id end as plot_id)"
    " from all_plots where year = '2024' or Easting is not null)"
)
COLLIDED_TREES = (
    "(select * replace (case when year = '2024' and plot_id = 'TR_P2_2' then 'TR_P3_3' else plot_id end as plot_id) from raw_trees)"
)


def _run_checks(trees: str, plots: str, keys: list[str]) -> str:
    """Each check in its own words, one below the other."""
    by = ", ".join(keys)

    def lacking(mine: str, theirs: str) -> str:
        return f"select {by}, count(*) as n from {mine} a where not exists (from {theirs} b where {_same('a', 'b', keys)}) group by {by}"

    parts = {
        "oversize_trees": _count(f"(select * from {trees} where dbh_cm / 2.54e0 > 70)", by=by),
        "trees_without_plots": lacking(trees, plots),
        "plots_without_trees": lacking(plots, trees),
        "duplicate_plots": f"select * from ({_count(plots, by=by)}) where n > 1",
        "species_freq": (
            f"select upper(species_code) as species_code, count(*) as n from {trees} where species_code is not null group by 1"),
    }
    return " union all by name ".join(f"select '{name}' as \"check\", * from ({sql})" for name, sql in parts.items())


FUEL_FACTORS = (0.010673383170731708, 0.10582623109756098, 0.8568717863414635)


def bodies() -> dict[str, str]:
    """The last select of each query over the two-year (or ``_b``) subqueries."""
    q = {
        "plots_union_recode": "select * replace (case when year = '2025' then treated end as treated) from plots0",
        "trees_union_recode": _count("recoded_trees"),
        "fuels_union_recode": _count("fuels"),
        "tree_corrections": (
            "select f.* from fixed_trees f join recoded_trees r on f.src_row = r.src_row"
            " where f.dbh_cm is distinct from r.dbh_cm or f.tree_num is distinct from r.tree_num"
        ),
        "dedupe_keep_later": _count("trees", "n_rows"),
        "dup_report": (
            "select * from (select *, row_number() over (partition by year, plot_id, tree_num order by src_row)"
            " as again from trees) where again > 1"
        ),
        "survey_fingerprint": (
            "select *, row_number() over (partition by plot_year order by ba desc nulls last, species_code nulls last)"
            " as row_rank from (select case when year = '2025' then '2025' when occurrence > 1 then '2024b' else '2024a' end"
            " as plot_year, species_code, case when count(dbh_cm) = count(*) then"
            " sum(pi() * power(dbh_cm / 20, 2)) end as ba"
            f" from numbered_trees where plot_id = '{inputs.FINGERPRINT_PLOT}' group by all)"
        ),
        "plots_without_trees": "select year, plot_id from located except select year, plot_id from trees",
        "trees_without_plots": "select year, plot_id from trees except select year, plot_id from located",
        "duplicate_plots": (
            "select year, plot_id, count(*) as n from (select * replace (case when year = '2024' and plot_id = 'TR_P2_2'"
            " then 'TR_P3_3' else plot_id end as plot_id) from all_plots where year = '2024' or Easting is not null)"
            " group by year, plot_id having count(*) > 1"
        ),
        "ingest_csv_keep_later": _count("trees", "n_rows"),
        "plots_set_aside": f"select * from {COLLIDED} qualify count(*) over (partition by year, plot_id) > 1",
        "fuels_set_aside": (
            "select f.*, case when d.n = 1 then d.trt_ctl end as trt_ctl,"
            " case when d.n = 1 then split_part(f.plot_id, '_', 2) end as trt_project,"
            f" f.h1 * {FUEL_FACTORS[0]} as mass_1hr,"
            f" f.h1 * {FUEL_FACTORS[0]} + f.h10 * {FUEL_FACTORS[1]} + f.h100 * {FUEL_FACTORS[2]} as mass_fine"
            " from (select year, case when year = '2024' and plot_id = 'TR_P2_2' then 'TR_P3_3' else plot_id end as plot_id,"
            " coalesce(sum(count_1hr), 0e0) as h1, coalesce(sum(count_10h), 0e0) as h10, coalesce(sum(count_100h), 0e0) as h100"
            f" from raw_fuels group by 1, 2) f left join (select year, plot_id, count(*) as n, any_value(Sample) as trt_ctl"
            f" from {COLLIDED} group by all) d on f.year = d.year and f.plot_id = d.plot_id"
        ),
        "duplicate_trees": f"select * from ({_count('trees', by='year, plot_id, tree_num')}) where n > 1",
        "oversize_trees": _count("(select * from trees where dbh_cm / 2.54e0 > 70)"),
        "species_freq": (
            "select upper(species_code) as species_code, count(*) as n from trees"
            " where species_code is not null group by 1"
        ),
        "tree_metrics": "select * from measured",
        "plots_elev": "select * from located",
        "plots_elev_stored": "select * from located",
        "run_checks": _run_checks(COLLIDED_TREES, COLLIDED, ["year", "plot_id"]),
        "run_checks_b": _run_checks("trees", "located", ["plot_id"]),
        "plots_tile_keys": _tile_keys(),
        "plots_elev_tiles": _tile_elevation(),
        "ingest_trees_plt": "select * from trees_plt",
        "trees_sp_size_ranked": (
            "select m.*, row_number() over (partition by m.species_group order by z.ord nulls last) as row_rank"
            " from trees_sp_size m left join sizes z on m.size_class = z.level"
        ),
        "elev_median": "select median(elev_m) as elev_median from located",
        "plot_dimension": "select * from dim",
        "paired_plots": "select * from paired",
        "trees_plt": "select * from trees_plt",
        "trees_plt_sp": "select * from sp_dense",
        "trees_plt_sp_size": "select * from size_dense",
        "rollup_shared_scan": (
            "select 'plot' as level, null as species_group, null as size_class, * from plt_sums union all by name"
            " select 'species' as level, null as size_class, * from sp_sums union all by name"
            " select 'species_size' as level, * from size_sums"
        ),
        "fuels_agg": "select * from fuels_agg",
        "fuels_mass": "select * from fuels_mass",
        "fuels_long": "select * from fuels_long",
        "fuels_long_paired": "select * from fuels_paired",
        "bar_totals_size": (
            "select *, round_even(total_tpa, 0) as label from (select trt_project, year, size_class,"
            f" coalesce(sum(tpa_live_gt10cm), 0e0) as total_tpa from {PAIRED_SIZE} group by all)"
        ),
        "bar_totals_tpa": _panels(
            "select *, round_even(total_tpa, 0) as label from (select year, trt_project,"
            " coalesce(sum(tpa_live_gt10cm), 0e0) as total_tpa from trees_sp_trtuntrt group by all)"
        ),
        "bar_totals_ba": _panels(
            "select *, round_even(total_ba, 0) as label from (select year, trt_project,"
            " coalesce(sum(ba_live_ft), 0e0) as total_ba from trees_sp_trtuntrt group by all)"
        ),
        "stack_paired_size": _stack(
            "select trt_project, year, size_class, species_group, sum(tpa_live_gt10cm) as tpa_live_gt10cm"
            f" from {PAIRED_SIZE} group by all",
            "size_class", ["trt_project", "year"], "tpa_live_gt10cm",
        ),
        "stack_paired_tpa": _panels(
            _stack("select * from trees_sp_trtuntrt", "year", ["trt_project"], "tpa_live_gt10cm")),
        "stack_paired_ba": _panels(
            _stack("select * from trees_sp_trtuntrt", "year", ["trt_project"], "ba_live_ft")),
        "box_elev": _box("elev_long", "measure, elev_class", "value"),
        "box_paired": _box("paired_long", "measure, trt_project, year", "value"),
        "box_fuels": _box("fuels_long", "fuel_class, elev_class", "mass_tons_ac"),
        "box_fuels_paired": _box("fuels_paired", "fuel_class, trt_project, year", "mass_tons_ac"),
        "box_trtctl": _box("trt_long", "measure, trt_ctl", "value"),
        "box_fuels_trtctl": _box("fuels_long", "fuel_class, trt_ctl", "mass_tons_ac"),
        "density_elev": _violin("elev_long", ["measure"], "elev_class", "value"),
        "density_paired": _violin("paired_long", ["measure", "trt_project"], "year", "value"),
        "density_fuels": _violin("fuels_long", ["fuel_class"], "elev_class", "mass_tons_ac"),
        "density_fuels_paired": _violin("fuels_paired", ["fuel_class", "trt_project"], "year", "mass_tons_ac"),
        "density_trtctl": _violin("trt_long", ["measure"], "trt_ctl", "value"),
        "density_fuels_trtctl": _violin("fuels_long", ["fuel_class"], "trt_ctl", "mass_tons_ac"),
        "paired_ba_lines": (
            "select *, case when year = '2025' then plot_id end as label from trees_plt where y2024_untrt_y2025_trt"
        ),
        "cwhr_counts_elev": _count("complete_cwhr", by="elev_class, cwhr_size, cwhr_cover, cwhr_type"),
        "cwhr_counts_trtctl": _count("complete_cwhr", by="trt_ctl, cwhr_size, cwhr_cover, cwhr_type"),
    }
    for name, (source, x, facets, value) in STACKS.items():
        q[name] = _stack(f"select * from {source}", x, facets, value)
    for name in ("trees_sp_elev", "trees_sp_trtctl", "trees_sp_size", "trees_sp_size_elev", "trees_sp_size_trtctl",
                 "trees_sp_trtuntrt", PAIRED_SIZE):
        q[name] = f"select * from {name}"
    q["plot_dimension_b"] = "select * from dim"
    # years added to stored sums come to the same as all years at once
    for name, source in (("trees_plt", "trees_plt"), ("rollup", "rollup_shared_scan"), ("trees_sp_size", "trees_sp_size"),
                         ("trees_sp_size_paired", PAIRED_SIZE), ("fuels_mass", "fuels_mass")):
        q[f"yearly_{name}"] = q[source]
    return q


def all_oracles() -> dict[str, str]:
    two, one = base_tables(True), base_tables(False)
    texts = bodies()
    result = {}
    for name, (plain, rounded) in SHAPES.items():
        one_year = name.endswith("_b")
        body = texts.get(name) or texts[name.removesuffix("_b")]
        columns = [*[f'"{c}"' for c in plain], *[f"round({c}, 6) + 0e0 as {c}" for c in rounded]]
        outer = f"select {', '.join(columns)} from ({body}) final_rows"
        result[name] = with_needed(one if one_year else two, outer)
    return result
