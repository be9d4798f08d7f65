"""Queries: metadata cleaning, prevalence, CLR / z-scores and dataset profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import rnd
from ..operators import profile as P
from ..operators.abundance import prevalence_filter, standardise
from ..operators.metadata import clean_metadata
from ..params import NULL_SENTINELS, PreprocessParams
from ..session import materialize
from ..sources import fixtures
from . import sql_twins as S
from .context import prepare
from .registry import register

_SENT = ", ".join("'" + s.replace("'", "''") + "'" for s in NULL_SENTINELS)
META_COLS = ["sampleID", "subjectID", "disease", "age", "gender", "country", "bmi", "bodysite",
             "dataset_name"]


def _clean(col: str) -> str:
    return f"CASE WHEN trim({col}) IN ({_SENT}) THEN NULL ELSE trim({col}) END"


CLEAN_SQL = f"""
SELECT sample_key, {_clean('sampleID')} AS sample_id, {_clean('subjectID')} AS subject_id,
       {_clean('disease')} AS disease, TRY_CAST({_clean('age')} AS DOUBLE) AS age,
       CASE WHEN lower({_clean('gender')}) IN ('female', 'male') THEN lower({_clean('gender')}) END AS gender,
       {_clean('country')} AS country, TRY_CAST({_clean('bmi')} AS DOUBLE) AS bmi,
       {_clean('bodysite')} AS bodysite, {_clean('dataset_name')} AS dataset
FROM raw"""


@register("clean_metadata", S.with_(f"raw AS ({S.METADATA_RAW_SQL})") + CLEAN_SQL +
          " WHERE " + _clean("sampleID") + " IS NOT NULL")
def q_clean_metadata(spark, sf_dir):
    return clean_metadata(fixtures.metadata_raw(spark, sf_dir))


@register("prevalence_filter", S.with_(
    f"ab AS ({S.ABUNDANCE_BY_PART_SQL})", "nsmp AS (SELECT count(*) AS n FROM customer)") + f"""
SELECT lineage, CAST(count(*) FILTER (WHERE value > 0) AS BIGINT) AS n_present,
       {S.r6('count(*) FILTER (WHERE value > 0) / (SELECT n FROM nsmp)')} AS prevalence
FROM ab GROUP BY lineage
HAVING count(*) FILTER (WHERE value > 0) / (SELECT n FROM nsmp) >= 0.02""")
def q_prevalence_filter(spark, sf_dir):
    ab = fixtures.abundance_by_part(spark, sf_dir)
    n = fixtures.samples(spark, sf_dir).count()
    kept = prevalence_filter(ab, n, 0.02)
    return kept.select("lineage", F.col("n_present").cast("long"), rnd("prevalence").alias("prevalence"))


@register("standardised_values", S.with_(S.PREP) +
          f"SELECT sample_key, feature_idx, {S.r6('z')} AS z FROM z")
def q_standardised(spark, sf_dir):
    prep = prepare(spark, sf_dir)
    return prep.std.vectors.select(
        "sample_key", F.posexplode("features").alias("feature_idx", "z")).select(
        "sample_key", F.col("feature_idx").cast("int"), rnd("z").alias("z"))


@register("clr_moments", S.with_(S.PREP) + f"""
SELECT feature_idx, {S.r6('avg(clr)')} AS mean, {S.r6('stddev_pop(clr)')} AS std
FROM clr GROUP BY feature_idx""")
def q_clr_moments(spark, sf_dir):
    prep = prepare(spark, sf_dir)
    return prep.std.moments.select("feature_idx", rnd("mean").alias("mean"),
                                   rnd("std").alias("std"))


# A full column near 1e6 with a spread of about 1e-3, a sparse one, and a constant one.
_SHIFTED = (("a", "1000000 + c_acctbal / 3000000.0", "true"), ("b", "1000000 + c_acctbal / 3000000.0", "c_custkey % 3 = 0"), ("c", "7.25", "true"))


@register("shifted_moments", "WITH v AS (" + " UNION ALL ".join(
    f"SELECT c_custkey AS k, 'k__Goods|g__{g}' AS lineage, CASE WHEN {keep} THEN {x} ELSE 0 END AS x FROM customer" for g, x, keep in _SHIFTED) + f""")
SELECT lineage, {S.r6('avg(x)', 3)} AS mean, {S.r6('stddev_pop(x)')} AS std,
       CASE WHEN stddev_pop(x) < 1 THEN {S.r6('stddev_pop(x) * 1e6', 1)} END AS std_millionths,
       {S.r6('CASE WHEN stddev_pop(x) = 0 THEN 0.0 ELSE (max(x) - avg(x)) / stddev_pop(x) END', 3)} AS max_z
FROM v GROUP BY lineage""")
def q_shifted_moments(spark, sf_dir):
    """Moments of columns whose spread is a billionth of their mean (D23, G7): no difference of large squares."""
    c = fixtures.table(spark, sf_dir, "customer")
    ab = None
    for g, x, keep in _SHIFTED:
        one = c.where(F.expr(keep)).select(F.col("c_custkey").alias("sample_key"), F.lit(f"k__Goods|g__{g}").alias("lineage"), F.expr(x).cast("double").alias("value"))
        ab = one if ab is None else ab.unionByName(one)
    std = standardise(ab, fixtures.samples(spark, sf_dir), PreprocessParams(min_prevalence=0.0, scaler="standard"), persist=materialize)
    top = std.vectors.select(F.posexplode("features").alias("feature_idx", "z")).groupBy("feature_idx").agg(F.max("z").alias("z"))
    return (std.moments.join(std.features.select("feature_idx", "lineage"), "feature_idx").join(top, "feature_idx")
            .select("lineage", rnd("mean", 3).alias("mean"), rnd("std").alias("std"),
                    F.when(F.col("std") < 1, rnd(F.col("std") * 1e6, 1)).alias("std_millionths"), rnd("z", 3).alias("max_z")))


def _profile_inputs(spark, sf_dir):
    prep = prepare(spark, sf_dir)
    return prep, fixtures.metadata_raw(spark, sf_dir)


@register("dataset_overview", S.with_(S.PREP, f"raw AS ({S.METADATA_RAW_SQL})") + """
SELECT CAST((SELECT n FROM nsmp) AS BIGINT) AS samples,
       CAST((SELECT count(*) FROM feat) AS BIGINT) AS features,
       CAST(9 AS BIGINT) AS metadata_columns,
       round(1.0 - (SELECT count(*) FROM idx) / ((SELECT n FROM nsmp) * (SELECT count(*) FROM feat)), 4)
           AS feature_sparsity,
       CAST(count(DISTINCT disease) AS BIGINT) AS unique_diseases,
       CAST(count(DISTINCT country) AS BIGINT) AS unique_countries
FROM raw""")
def q_dataset_overview(spark, sf_dir):
    prep, raw = _profile_inputs(spark, sf_dir)
    return P.dataset_overview(prep.indexed, prep.n_samples, prep.n_features, raw, META_COLS)


def _vc_sql(col: str, top: int) -> str:
    return S.with_(f"raw AS ({S.METADATA_RAW_SQL})") + f"""
SELECT {col} AS value, count(*) AS count FROM raw
WHERE {col} IS NOT NULL AND {col} NOT IN ({_SENT})
GROUP BY 1 ORDER BY count DESC, value ASC LIMIT {top}"""


@register("disease_counts", _vc_sql("disease", 15))
def q_disease_counts(spark, sf_dir):
    return P.value_counts(fixtures.metadata_raw(spark, sf_dir), "disease", 15)


@register("country_counts", _vc_sql("country", 12))
def q_country_counts(spark, sf_dir):
    return P.value_counts(fixtures.metadata_raw(spark, sf_dir), "country", 12)


_AGE = f"TRY_CAST(CASE WHEN age IN ({_SENT}) THEN NULL ELSE trim(age) END AS DOUBLE)"


@register("age_histogram", S.with_(
    f"raw AS ({S.METADATA_RAW_SQL})",
    f"v AS (SELECT {_AGE} AS x FROM raw WHERE {_AGE} IS NOT NULL)",
    "r AS (SELECT min(x) AS lo, max(x) AS hi, CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / 30 ELSE 1.0 END AS w FROM v)",
    "b AS (SELECT CAST(least(floor((x - lo) / w), 29) AS INTEGER) AS bin FROM v, r)") + f"""
SELECT bin, {S.r6('lo + bin * w')} AS lo, {S.r6('lo + (bin + 1) * w')} AS hi, count(*) AS count
FROM b, r GROUP BY bin, lo, w""")
def q_age_histogram(spark, sf_dir):
    return P.histogram(fixtures.metadata_raw(spark, sf_dir), "age", 30)


@register("age_summary", S.with_(f"raw AS ({S.METADATA_RAW_SQL})") + f"""
SELECT count({_AGE}) AS n, {S.r6(f'median({_AGE})')} AS median, {S.r6(f'avg({_AGE})')} AS mean,
       min({_AGE}) AS min, max({_AGE}) AS max FROM raw""")
def q_age_summary(spark, sf_dir):
    s = P.numeric_summary(fixtures.metadata_raw(spark, sf_dir), "age")
    return s.select("n", rnd("median").alias("median"), rnd("mean").alias("mean"), "min", "max")


@register("gender_shares", S.with_(
    f"raw AS ({S.METADATA_RAW_SQL})",
    "g AS (SELECT lower(trim(gender)) AS gender FROM raw WHERE lower(trim(gender)) IN ('female', 'male'))") + f"""
SELECT gender, count(*) AS count, {S.r6('count(*) / sum(count(*)) OVER ()')} AS share
FROM g GROUP BY gender""")
def q_gender_shares(spark, sf_dir):
    return P.gender_shares(fixtures.metadata_raw(spark, sf_dir))


def _missing_sql() -> str:
    parts = [f"SELECT '{c}' AS \"column\", round(100.0 * count(*) FILTER (WHERE {c} IS NULL OR {c} IN ({_SENT})) / count(*), 2) + 0.0 AS missing_pct FROM raw"
             for c in META_COLS]
    return S.with_(f"raw AS ({S.METADATA_RAW_SQL})", "u AS (" + " UNION ALL ".join(parts) + ")") + """
SELECT "column", missing_pct,
       CASE WHEN missing_pct > 30 THEN 'high' WHEN missing_pct > 10 THEN 'medium' ELSE 'low' END AS band
FROM u ORDER BY missing_pct DESC, "column" ASC"""


@register("missing_profile", _missing_sql())
def q_missing_profile(spark, sf_dir):
    return P.missing_profile(fixtures.metadata_raw(spark, sf_dir), META_COLS)


_FEAT_STATS = """
fs AS (SELECT c.feature_idx, avg(c.x) AS mean, stddev_samp(c.x) AS std FROM cells c GROUP BY 1),
lf AS (SELECT feature_idx, coalesce((list_filter(list_transform(string_split(lineage, '|'),
              lambda p: CASE WHEN strpos(p, '__') > 0 THEN replace(trim(substr(p, strpos(p, '__') + 2)), '_', ' ') END),
              lambda n: n IS NOT NULL AND lower(n) NOT IN ('', 'unclassified', 'unknown')))[-1], lineage) AS label
       FROM feat)"""


@register("top_features_by_mean", S.with_(S.PREP, _FEAT_STATS) + f"""
SELECT fs.feature_idx, lf.label, {S.r6('fs.mean')} AS mean_abundance
FROM fs JOIN lf USING (feature_idx) ORDER BY fs.mean DESC, fs.feature_idx ASC LIMIT 20""")
def q_top_mean(spark, sf_dir):
    prep = prepare(spark, sf_dir)
    return P.top_features_by_mean(prep.indexed, prep.features, prep.n_samples, 20)


@register("top_features_by_cv", S.with_(S.PREP, _FEAT_STATS) + f"""
SELECT fs.feature_idx, lf.label, {S.r6('fs.std / fs.mean')} AS cv
FROM fs JOIN lf USING (feature_idx) WHERE fs.mean <> 0
ORDER BY fs.std / fs.mean DESC, fs.feature_idx ASC LIMIT 20""")
def q_top_cv(spark, sf_dir):
    prep = prepare(spark, sf_dir)
    return P.top_features_by_cv(prep.indexed, prep.features, prep.n_samples, 20)
