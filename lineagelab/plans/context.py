"""Shared preparation of the fixture inputs: abundance → features → z-scored vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.abundance import (Standardised, feature_dimension, index_abundance,
                                   prevalence_filter, standardise)
from ..params import PreprocessParams
from ..session import materialize, sample_buckets
from ..sources import fixtures


class Prepared:
    """Inputs shared by the fixture queries.

    The abundance fact and the feature dimension are built eagerly; the
    z-scored vectors (``std``) only when a query asks for them. The fact and the vectors lie in the same
    buckets of ``sample_key``, so what is grouped or joined by sample stays where it is.
    """

    def __init__(self, abundance: DataFrame, samples: DataFrame, n_samples: int,
                 features: DataFrame, n_features: int, params: PreprocessParams):
        self.abundance = abundance      # (sample_key, lineage, value)
        self.samples = samples          # (sample_key)
        self.n_samples = n_samples
        self.features = features        # retained features, feature_idx 0..D-1
        self.n_features = n_features
        self.params = params
        # (sample_key, feature_idx, value) over retained features
        self.indexed = index_abundance(abundance, features, n_features)
        self._std: Standardised | None = None

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, which has a ``sample_key``, written once in the buckets of the abundance fact."""
        return materialize(df, name, "sample_key", sample_buckets(df.sparkSession, self.n_samples))

    @property
    def std(self) -> Standardised:
        if self._std is None:
            self._std = standardise(self.abundance, self.samples, self.params, features=self.features,
                                    persist=self.keep, n_samples=self.n_samples,
                                    n_features=self.n_features)
        return self._std

    def points(self, labels: DataFrame) -> DataFrame:
        """(sample_key, vec, cluster_id): the z-vectors with the given labels."""
        return (self.std.vectors.withColumnRenamed("features", "vec")
                    .join(labels.select("sample_key", "cluster_id"), "sample_key"))


_MEMO: dict = {}


def clear_cache() -> None:
    """Forget prepared inputs (the bench clears it before each timed query)."""
    _MEMO.clear()
    from . import q_models
    q_models.clear_cache()


def prepare(spark: SparkSession, sf_dir: str,
            params: PreprocessParams = PreprocessParams(), reuse: bool = True) -> Prepared:
    """Abundance fact → retained features (→ z-vectors on demand), written once per session.

    The fact (a three-way join and aggregation over lineitem, orders and part),
    the feature dimension and the vectors are materialised as Parquet under
    the session's checkpoint folder; with ``reuse`` the result is shared by
    the later queries of the same session and folder.
    """
    key = (id(spark), spark.sparkContext.applicationId, sf_dir, params)
    if reuse and key in _MEMO:
        return _MEMO[key]
    smp = fixtures.samples(spark, sf_dir)
    n = smp.count()
    buckets = sample_buckets(spark, n)
    ab = materialize(fixtures.abundance_long(spark, sf_dir, buckets), "abundance", "sample_key", buckets)
    kept = prevalence_filter(ab, n, params.min_prevalence)
    features = materialize(feature_dimension(kept), "features")
    d = features.count()
    if d == 0:
        raise ValueError("no feature passes the prevalence filter")
    prep = Prepared(ab, smp, n, features, d, params)
    if reuse:
        _MEMO[key] = prep
    return prep


def customer_points(spark: SparkSession, sf_dir: str, prep: Prepared | None = None) -> DataFrame:
    prep = prep or prepare(spark, sf_dir)
    return prep.points(fixtures.segment_labels(spark, sf_dir))


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.points(spark, sf_dir)
