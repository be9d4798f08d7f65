"""Serving tables and the read queries over them.

The tables are plain DataFrames (or Parquet tables written by
``write_serving_tables``); every query is a filter / join / order chain that
Catalyst plans with predicate pushdown and partition pruning.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import unknown_if_null
from ..params import ServingParams

_SP = ServingParams()


@dataclass
class ServingTables:
    samples: DataFrame            # id, sample_id, subject_id, disease, age, gender, country, bmi, bodysite, dataset
    fingerprints: DataFrame       # sample_pk, cluster_id, … fingerprint columns
    embeddings: DataFrame | None  # sample_pk, atlas_x, atlas_y, pca_x, pca_y, cluster_id, metadata copies
    clusters: DataFrame | None    # cluster summaries (is_noise, …)
    importances: DataFrame | None  # cluster_id, rank, feature columns
    edges: DataFrame | None = None  # source, target, weight (sample ids as keys)
    threshold: float | None = None


def build_serving_tables(meta: DataFrame, fingerprints: DataFrame, atlas: DataFrame | None = None,
                         clusters: DataFrame | None = None, importances: DataFrame | None = None,
                         edges: DataFrame | None = None, threshold: float | None = None) -> ServingTables:
    """Keyed serving tables from cleaned metadata (``sample_key`` = surrogate ``id``)."""
    samples = meta.withColumnRenamed("sample_key", "id")
    fp = fingerprints.withColumnRenamed("sample_key", "sample_pk")
    emb = atlas.withColumnRenamed("sample_key", "sample_pk") if atlas is not None else None
    return ServingTables(samples, fp, emb, clusters, importances, edges, threshold)


def write_serving_tables(t: ServingTables, path: str) -> dict[str, str]:
    """Overwrite every table in dependency order; samples sorted for row-group pruning,
    fingerprints partitioned by cluster. Nested columns stay nested (Parquet)."""
    out = {}

    def put(name, df, **kw):
        p = os.path.join(path, name)
        w = df.write.mode("overwrite")
        if kw.get("partition"):
            w = w.partitionBy(kw["partition"])
        w.parquet(p)
        out[name] = p

    put("samples", t.samples.sortWithinPartitions("disease", "country", "id"))
    put("fingerprints", t.fingerprints, partition="cluster_id")
    if t.embeddings is not None:
        put("embeddings", t.embeddings)
    if t.clusters is not None:
        put("cluster_summaries", t.clusters)
    if t.importances is not None:
        put("feature_importances", t.importances)
    if t.edges is not None:
        put("edges", t.edges)
    return out


def _contains_ci(col: str, text: str) -> F.Column:
    """Case-insensitive substring test; ``%`` and ``_`` in the text are literal."""
    return F.lower(F.col(col)).contains(text.lower())


def list_samples(t: ServingTables, page: int = 1, limit: int = _SP.default_limit,
                 disease: str | None = None, country: str | None = None,
                 gender: str | None = None, cluster: int | None = None) -> DataFrame:
    """One page of samples ordered by id, with total / page / limit / pages columns."""
    if page < 1:
        raise ValueError("page must be >= 1")
    if not 1 <= limit <= _SP.max_limit:
        raise ValueError(f"limit must be in 1..{_SP.max_limit}")
    q = t.samples
    if disease:
        q = q.where(_contains_ci("disease", disease))
    if country:
        q = q.where(_contains_ci("country", country))
    if gender:
        q = q.where(F.col("gender") == gender.lower())
    if cluster is not None:
        ids = t.fingerprints.where(F.col("cluster_id") == cluster).select(F.col("sample_pk").alias("id"))
        q = q.join(ids, "id", "left_semi")
    total = q.count()
    pages = math.ceil(total / limit) if total > 0 else 1
    rows = q.orderBy("id").offset((page - 1) * limit).limit(limit)
    return rows.select("*", F.lit(total).cast("long").alias("total"), F.lit(page).alias("page"),
                       F.lit(limit).alias("limit"), F.lit(pages).alias("pages"))


def sample_detail(t: ServingTables, sample_id: str) -> DataFrame:
    """First sample row (lowest id) for a natural id, with its fingerprint and embedding."""
    s = t.samples.where(F.col("sample_id") == sample_id).orderBy("id").limit(1)
    fp = t.fingerprints.select(F.col("sample_pk").alias("id"),
                               F.struct(*[c for c in t.fingerprints.columns if c != "sample_pk"])
                               .alias("fingerprint"))
    out = s.join(fp, "id", "left")
    if t.embeddings is not None:
        emb = t.embeddings.select(F.col("sample_pk").alias("id"),
                                  F.struct(*[c for c in t.embeddings.columns if c != "sample_pk"])
                                  .alias("embedding"))
        out = out.join(emb, "id", "left")
    return out


def list_clusters(t: ServingTables, method: str | None = None) -> DataFrame:
    """Cluster rows, real clusters first then by id, with n_clusters / n_noise_clusters."""
    c = t.clusters
    counts = c.agg(F.count_if(~F.col("is_noise")).alias("n_clusters"),
                   F.count_if(F.col("is_noise")).alias("n_noise_clusters")).first()
    return (c.orderBy(F.asc("is_noise"), F.asc("cluster_id"))
             .withColumn("n_clusters", F.lit(int(counts["n_clusters"])).cast("long"))
             .withColumn("n_noise_clusters", F.lit(int(counts["n_noise_clusters"])).cast("long"))
             .withColumn("method", F.lit(method or "unknown")))


def get_cluster(t: ServingTables, cluster_id: int) -> DataFrame:
    """One cluster row (zero rows when absent)."""
    return t.clusters.where(F.col("cluster_id") == cluster_id).limit(1)


def network(t: ServingTables, cluster: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the similarity network; with ``cluster``, nodes of that cluster
    and the edges between them (I14, C9)."""
    emb = t.embeddings
    nodes = emb.select(F.col("sample_pk").alias("id"), F.col("cluster_id").alias("cluster"),
                       F.coalesce("atlas_x", F.lit(0.0)).alias("atlas_x"),
                       F.coalesce("atlas_y", F.lit(0.0)).alias("atlas_y"),
                       unknown_if_null(F.col("disease")).alias("disease"),
                       unknown_if_null(F.col("country")).alias("country"),
                       unknown_if_null(F.col("gender")).alias("gender"))
    edges = t.edges
    if cluster is not None:
        nodes = nodes.where(F.col("cluster") == cluster)
    if cluster is not None and edges is not None:
        ids = nodes.select("id")
        edges = (edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
                      .join(ids.withColumnRenamed("id", "target"), "target", "left_semi"))
    return nodes, edges


def table_health(t: ServingTables) -> DataFrame:
    """One row: n_samples, n_clusters (non-noise summaries)."""
    n_samples = t.samples.count()
    n_clusters = 0 if t.clusters is None else t.clusters.where(~F.col("is_noise")).count()
    return t.samples.sparkSession.createDataFrame([(n_samples, n_clusters)],
                                                  "n_samples long, n_clusters long")


# ---------------------------------------------------------------------------
# Data checks (K1–K4)
# ---------------------------------------------------------------------------

def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once (K1)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_null) for each column in one pass (K2)."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "n_null")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, exempt=None) -> DataFrame:
    """Child rows whose key has no parent row (K3); ``exempt`` values are allowed."""
    c = child.where(~F.col(fk).isin(exempt)) if exempt else child
    return c.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def check_serving_tables(t: ServingTables) -> DataFrame:
    """(check, violations) counts for uniqueness, not-null and referential rules."""
    spark = t.samples.sparkSession
    rows = [
        ("samples.id unique", duplicate_keys(t.samples, ["id"]).count()),
        ("fingerprints.sample_pk unique", duplicate_keys(t.fingerprints, ["sample_pk"]).count()),
        ("fingerprints.sample_pk -> samples", orphans(t.fingerprints, "sample_pk", t.samples, "id").count()),
        ("samples.sample_id not null", t.samples.where(F.col("sample_id").isNull()).count()),
    ]
    if t.clusters is not None:
        rows.append(("cluster_summaries.cluster_id unique",
                     duplicate_keys(t.clusters, ["cluster_id"]).count()))
    if t.importances is not None and t.clusters is not None:
        rows.append(("feature_importances (cluster_id, rank) unique",
                     duplicate_keys(t.importances, ["cluster_id", "rank"]).count()))
        rows.append(("feature_importances.cluster_id -> clusters",
                     orphans(t.importances, "cluster_id", t.clusters, "cluster_id", [-99]).count()))
    return spark.createDataFrame(rows, "check string, violations long")

