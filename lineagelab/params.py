"""Default parameters of every operator.

Fixed values: these numbers must equal the behaviour being re-implemented,
so they are stated here once, in plain text, and imported everywhere else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (column names, sentinels, level codes, thresholds)
# ---------------------------------------------------------------------------

FEATURE_PREFIX = "k__"

CORE_META_COLS = [
    "sampleID",
    "subjectID",
    "disease",
    "age",
    "gender",
    "country",
    "bmi",
    "bodysite",
    "dataset_name",
]

REQUIRED_COLS = ["sampleID", "disease", "country", "gender"]

NULL_SENTINELS = ["nd", "na", "-", " -", "n/a", "N/A", "", "none", "None"]

# Canonical gender values; anything else becomes NULL.
GENDER_VALUES = ["female", "male"]

# Lineage level codes → level names, in order kingdom … strain.
LEVEL_CODES = [
    ("k", "kingdom"),
    ("p", "phylum"),
    ("c", "class"),
    ("o", "order"),
    ("f", "family"),
    ("g", "genus"),
    ("s", "species"),
    ("t", "strain"),
]

# Names that never count as a taxon name (compared lower-case).
UNNAMED = ["", "unclassified", "unknown"]

# Display-name preference, most specific first (strain ignored).
DISPLAY_ORDER = ["species", "genus", "family", "order", "class", "phylum", "kingdom"]


NOISE_LABEL = -1
GLOBAL_IMPORTANCE_CLUSTER = -99


@dataclass(frozen=True)
class PreprocessParams:
    min_prevalence: float = 0.01
    scaler: str = "clr"  # "clr" or "standard" (standard = skip CLR, still z-score)
    pseudocount: float = 1e-6


@dataclass(frozen=True)
class FingerprintParams:
    top_n: int = 10
    min_abundance: float = 0.001
    scoring_min_abundance: float = 1e-6
    diversity_low: float = 1.5
    diversity_high: float = 3.0
    shannon_eps: float = 1e-12
    novelty_common: float = 0.33
    novelty_moderate: float = 0.66


@dataclass(frozen=True)
class ReduceParams:
    n_components: int = 50
    atlas_neighbors: int = 30
    seed: int = 42


@dataclass(frozen=True)
class ClusterParams:
    kmeans_k: int = 8
    kmeans_n_init: int = 20
    kmeans_max_iter: int = 500
    gmm_k: int = 8
    gmm_max_iter: int = 200
    gmm_n_init: int = 5
    density_min_cluster_size: int = 30
    density_min_samples: int = 10
    seed: int = 42


@dataclass(frozen=True)
class SimilarityParams:
    n_neighbors: int = 10
    table_neighbors: int = 3
    threshold: float = 0.90
    max_nodes: int = 500
    sample_seed: int = 42
    # rows per block for the exact block-pair similarity join
    block_rows: int = 2000


@dataclass(frozen=True)
class ImportanceParams:
    n_trees: int = 200
    max_depth: int = 8
    seed: int = 42
    top_per_cluster: int = 10
    top_global: int = 50


@dataclass(frozen=True)
class ProfileParams:
    top_features: int = 20
    top_variable: int = 20
    disease_top: int = 15
    country_top: int = 12
    age_bins: int = 30
    missing_high: float = 30.0
    missing_medium: float = 10.0
    variance_targets: tuple = (0.5, 0.7, 0.9)


@dataclass(frozen=True)
class ServingParams:
    default_limit: int = 50
    max_limit: int = 500
    summary_top: int = 10


@dataclass(frozen=True)
class Params:
    preprocess: PreprocessParams = field(default_factory=PreprocessParams)
    fingerprint: FingerprintParams = field(default_factory=FingerprintParams)
    reduce: ReduceParams = field(default_factory=ReduceParams)
    cluster: ClusterParams = field(default_factory=ClusterParams)
    similarity: SimilarityParams = field(default_factory=SimilarityParams)
    importance: ImportanceParams = field(default_factory=ImportanceParams)
    profile: ProfileParams = field(default_factory=ProfileParams)
    serving: ServingParams = field(default_factory=ServingParams)


DEFAULTS = Params()
