"""Zero-filled cells: every observed plot gets a row for every level.

A plot's cells are first nested into one small map (at most levels + 1 per
domain, so 40 entries), then the map is unrolled over the closed domain. This
needs one shuffle of the observed cells. Joining a plots x levels grid back to
them would shuffle the grid as well, which is many times larger.

Cells are addressed by a code: the level positions of the domain columns in
mixed radix, where the position after the last level stands for null. A null
level is kept only where it was observed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory.functions import level_order
from understory.operators.joins import PACKED, pack

Domains = Mapping[str, Sequence[str]]


def _sql_array(values: Sequence) -> str:
    return "array(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def cell_code(domains: Domains) -> Column:
    """Code of a row's cell."""
    code = F.lit(0)
    for name, levels in domains.items():
        code = code * (len(levels) + 1) + level_order(F.col(name), levels)
    return code


def domain_codes(domains: Domains) -> list[int]:
    """Codes of all combinations of levels."""
    codes = [0]
    for levels in domains.values():
        codes = [code * (len(levels) + 1) + position for code in codes for position in range(len(levels))]
    return codes


def levels_of(code: str, domains: Domains) -> list[str]:
    """Domain columns back from a code, as SQL."""
    columns, divisor = [], 1
    for name, levels in reversed(domains.items()):
        radix = len(levels) + 1
        columns.append(f"get({_sql_array(levels)}, cast({code} div {divisor} % {radix} as int)) as {name}")
        divisor *= radix
    return columns[::-1]


def nest_cells(cells: DataFrame, keys: Sequence[str], domains: Domains, measures: Sequence[str]) -> DataFrame:
    """One row per key with its observed cells as ``cells: map<code, measures>``.

    The packed key stays beside the keys for a join that follows.
    """
    entry = F.struct(cell_code(domains).alias("code"), F.struct(*measures).alias("measures"))
    nested = cells.groupBy(pack(keys)).agg(F.map_from_entries(F.collect_list(entry)).alias("cells"))
    return nested.select(f"{PACKED}.*", PACKED, "cells")


def unnest_cells(nested: DataFrame, domains: Domains, measures: Sequence[str]) -> DataFrame:
    """All levels plus observed null levels, one row each; absent measures are 0."""
    others = [c for c in nested.columns if c not in ("cells", PACKED)]
    codes = f"array_union({_sql_array(domain_codes(domains))}, map_keys(cells))"
    rows = f"inline(transform({codes}, c -> struct(c as _code, try_element_at(cells, c) as _m)))"
    filled = [f"coalesce(_m.{m}, 0) as {m}" for m in measures]
    return nested.selectExpr(*others, rows).selectExpr(*others, *levels_of("_code", domains), *filled)


def densify(cells: DataFrame, keys: Sequence[str], domains: Domains, measures: Sequence[str]) -> DataFrame:
    """Cells of every key over the whole domain, zero where nothing was observed."""
    return unnest_cells(nest_cells(cells, keys, domains, measures), domains, measures)
