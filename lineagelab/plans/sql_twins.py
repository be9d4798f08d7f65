"""DuckDB twins of the Spark queries (the correctness oracle).

The twins compute everything the direct, dense way (cross products, window
functions) so they check the sparse / distributed formulas of the library
rather than repeat them.
"""

from __future__ import annotations

from ..params import LEVEL_CODES
from ..sources.fixtures import (ABUNDANCE_BY_PART_SQL, ABUNDANCE_SQL, METADATA_RAW_SQL,
                                ORDER_REQUEST_LONG_SQL, POINTS_SQL, SAMPLES_SQL,
                                SEGMENT_LABELS_SQL)


def _level_case(code: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{name}'" for k, name in LEVEL_CODES)
    return f"CASE {code} {whens} ELSE {code} END"


def parts_sql(col: str = "lineage") -> str:
    code = "lower(trim(split_part(p, '__', 1)))"
    return (
        f"list_filter(list_transform(string_split({col}, '|'), lambda p: CASE WHEN strpos(p, '__') > 0 "
        f"THEN {{'level': {_level_case(code)}, "
        f"'name': replace(trim(substr(p, strpos(p, '__') + 2)), '_', ' ')}} END), "
        f"lambda x: x IS NOT NULL AND lower(x.name) NOT IN ('', 'unclassified', 'unknown'))"
    )


def level_sql(level: str, parts: str = "parts") -> str:
    return f"(list_filter({parts}, lambda x: x.level = '{level}'))[-1].name"


def taxonomy_select(parts: str = "parts", col: str = "lineage") -> str:
    lv = [f"{level_sql(name, parts)} AS \"{name}\"" for _, name in LEVEL_CODES]
    disp = "coalesce(" + ", ".join(
        level_sql(x, parts) for x in ["species", "genus", "family", "order", "class", "phylum", "kingdom"]
    ) + f", {col}) AS display_name"
    return ", ".join(lv + [disp])


def features_cte(kept: str) -> str:
    """feat(feature_idx, lineage, kingdom … strain, display_name) over the lineages of ``kept``."""
    return f"""
feat0 AS (SELECT row_number() OVER (ORDER BY lineage) - 1 AS feature_idx, lineage,
                 {parts_sql()} AS parts
          FROM (SELECT DISTINCT lineage FROM {kept})),
feat AS (SELECT CAST(feature_idx AS INTEGER) AS feature_idx, lineage, {taxonomy_select()} FROM feat0)"""


# Abundance, prevalence filter (0.01), dense CLR + population z-score.
PREP = f"""
ab AS ({ABUNDANCE_SQL}),
smp AS ({SAMPLES_SQL}),
nsmp AS (SELECT count(*) AS n FROM smp),
prev AS (SELECT lineage, count(*) FILTER (WHERE value > 0) AS n_present,
                count(*) FILTER (WHERE value > 0) / (SELECT n FROM nsmp) AS prevalence
         FROM ab GROUP BY lineage),
kept AS (SELECT lineage FROM prev WHERE prevalence >= 0.01),
{features_cte("kept")},
idx AS (SELECT a.sample_key, f.feature_idx, a.value FROM ab a JOIN feat f USING (lineage)
        WHERE a.value > 0),
cells AS (SELECT s.sample_key, f.feature_idx, coalesce(i.value, 0.0) AS x
          FROM smp s CROSS JOIN feat f
          LEFT JOIN idx i ON i.sample_key = s.sample_key AND i.feature_idx = f.feature_idx),
clr AS (SELECT sample_key, feature_idx,
               ln(x + 1e-6) - avg(ln(x + 1e-6)) OVER (PARTITION BY sample_key) AS clr
        FROM cells),
zst AS (SELECT sample_key, feature_idx, clr,
               avg(clr) OVER (PARTITION BY feature_idx) AS mu,
               stddev_pop(clr) OVER (PARTITION BY feature_idx) AS sd
        FROM clr),
z AS (SELECT sample_key, feature_idx,
             CASE WHEN sd = 0 THEN clr - mu ELSE (clr - mu) / sd END AS z
      FROM zst)"""

LABELS = f"lab AS ({SEGMENT_LABELS_SQL})"

# Shannon on the retained features, exact formula.
SHANNON = """
tot AS (SELECT sample_key, sum(value) AS t FROM idx GROUP BY 1),
sh0 AS (SELECT i.sample_key, -sum((i.value / t.t) * ln(i.value / t.t + 1e-12)) AS h, count(*) AS n_present
        FROM idx i JOIN tot t USING (sample_key) GROUP BY 1)"""

# Novelty in the z space with segment labels.
NOVELTY = """
pts AS (SELECT z.sample_key, l.cluster_id, z.feature_idx, z.z FROM z JOIN lab l USING (sample_key)),
cent AS (SELECT cluster_id, feature_idx, avg(z) AS c FROM pts WHERE cluster_id >= 0 GROUP BY 1, 2),
dist AS (SELECT p.sample_key, p.cluster_id, sqrt(sum((p.z - c.c) * (p.z - c.c))) AS d
         FROM pts p JOIN cent c USING (cluster_id, feature_idx) GROUP BY 1, 2),
rng AS (SELECT cluster_id, min(d) AS dmin, max(d) AS dmax FROM dist GROUP BY 1),
nov AS (SELECT l.sample_key, l.cluster_id,
               CASE WHEN l.cluster_id = -1 THEN 1.0
                    WHEN r.dmax > r.dmin THEN (d.d - r.dmin) / (r.dmax - r.dmin)
                    ELSE 0.0 END AS ns
        FROM lab l LEFT JOIN dist d USING (sample_key) LEFT JOIN rng r ON r.cluster_id = l.cluster_id)"""


def div_class(h: str) -> str:
    return f"CASE WHEN {h} < 1.5 THEN 'Low' WHEN {h} < 3.0 THEN 'Medium' ELSE 'High' END"


def nov_class(s: str) -> str:
    return (f"CASE WHEN {s} <= 0.33 THEN 'Common' WHEN {s} <= 0.66 THEN 'Moderately Unique' "
            f"ELSE 'Highly Unique' END")


def r6(x: str, d: int = 6) -> str:
    return f"(round({x}, {d}) + 0.0)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n"


__all__ = ["PREP", "LABELS", "SHANNON", "NOVELTY", "ABUNDANCE_SQL", "ABUNDANCE_BY_PART_SQL",
           "METADATA_RAW_SQL", "POINTS_SQL", "SAMPLES_SQL", "SEGMENT_LABELS_SQL",
           "ORDER_REQUEST_LONG_SQL", "div_class", "nov_class", "r6", "with_", "features_cte",
           "parts_sql", "taxonomy_select"]
