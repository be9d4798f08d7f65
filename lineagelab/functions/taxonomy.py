"""Lineage-string column expressions.

A lineage looks like ``k__Bacteria|p__Firmicutes|g__Faecalibacterium``. All
parsing is expressed with Spark SQL higher-order functions so it runs
JVM-side; it is applied once per feature in the dimension job, never per
(sample, feature) cell.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DISPLAY_ORDER, LEVEL_CODES, UNNAMED

_WS_TRIM = r"^\s+|\s+$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, _WS_TRIM, "")


def _level_name(code: Column) -> Column:
    expr = None
    for k, name in LEVEL_CODES:
        expr = (F.when(code == k, F.lit(name)) if expr is None
                else expr.when(code == k, F.lit(name)))
    return expr.otherwise(code)


def lineage_parts(lineage: Column) -> Column:
    """array<struct<level, name>> of the usable parts, in lineage order.

    Parts without ``__`` are skipped; the code is trimmed and lower-cased and
    mapped to its level name (unknown codes keep the code); the name is
    trimmed and ``_`` becomes a space; empty / unclassified / unknown names
    are dropped.
    """
    parts = F.split(lineage, r"\|")

    def parse(p: Column) -> Column:
        pos = F.instr(p, "__")
        code = F.lower(_strip(F.substring_index(p, "__", 1)))
        name = F.replace(_strip(F.substr(p, pos + 2)), F.lit("_"), F.lit(" "))
        return F.when(pos > 0, F.struct(_level_name(code).alias("level"), name.alias("name")))

    parsed = F.transform(parts, parse)
    return F.filter(parsed, lambda x: x.isNotNull() & ~F.lower(x["name"]).isin(UNNAMED))


def level_value(parts: Column, level: str) -> Column:
    """Name at ``level``; when a level repeats, the later part wins."""
    return F.try_element_at(F.filter(parts, lambda x: x["level"] == level), F.lit(-1))["name"]


def display_name(parts: Column, lineage: Column) -> Column:
    """Most specific of species … kingdom, else the raw lineage."""
    return F.coalesce(*[level_value(parts, lv) for lv in DISPLAY_ORDER], lineage)


def leaf_name(lineage: Column) -> Column:
    """Last usable part at any level including strain, else the raw lineage."""
    parts = F.split(lineage, r"\|")
    names = F.transform(parts, lambda p: F.when(
        F.instr(p, "__") > 0,
        F.replace(_strip(F.substr(p, F.instr(p, "__") + 2)), F.lit("_"), F.lit(" "))))
    usable = F.filter(names, lambda n: n.isNotNull() & ~F.lower(n).isin(UNNAMED))
    return F.coalesce(F.try_element_at(usable, F.lit(-1)), lineage)


def phylum_any(lineage: Column) -> Column:
    """First ``p__`` part, unfiltered, else ``Unknown`` (scoring variant, G5)."""
    parts = F.split(lineage, r"\|")
    hits = F.filter(parts, lambda p: (F.instr(p, "__") > 0)
                    & (F.lower(_strip(F.substring_index(p, "__", 1))) == "p"))
    first = F.try_element_at(hits, F.lit(1))
    name = F.replace(_strip(F.substr(first, F.instr(first, "__") + 2)),
                     F.lit("_"), F.lit(" "))
    return F.coalesce(name, F.lit("Unknown"))


def taxonomy_columns(lineage_col: str = "lineage") -> list[Column]:
    """All dimension columns derived from one lineage column.

    The parsed parts are bound once per row (a one-element ``transform``), so
    the fifteen level lookups share one parse instead of repeating it.
    """
    lin = F.col(lineage_col)

    def build(parts: Column) -> Column:
        fields = [level_value(parts, name).alias(name) for _, name in LEVEL_CODES]
        fields.append(F.coalesce(*[level_value(parts, lv) for lv in DISPLAY_ORDER], lin)
                      .alias("display_name"))
        return F.struct(*fields)

    tax = F.element_at(F.transform(F.array(lineage_parts(lin)), build), 1)
    names = [name for _, name in LEVEL_CODES] + ["display_name"]
    return ([tax[n].alias(n) for n in names] +
            [leaf_name(lin).alias("leaf_name"), phylum_any(lin).alias("phylum_any")])
