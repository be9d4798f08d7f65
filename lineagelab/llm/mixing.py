"""Mixing sources to target weights by iterative proportional fitting (raking).

The corpus is reduced to cells (source, language, topic) with their token weight.
Raking scales the cells in turn to the target marginals of the three dimensions
until all of them hold to ``TOLERANCE``, or until the largest gap stops falling (by a tenth
in ``SWEEPS_PER_ROUND`` sweeps: targets that no weights can meet); the gap that is left is a column of the result. Target weights are
given per dimension as a table (value, share); without one they are the observed shares
raised to a power (``POWERS``), normalised: below 1 flattens. Every document of a cell then has the inclusion probability
``min(1, k * raked weight / observed weight)``, where k makes the expected tokens
``rate`` of the whole; a document is taken when the uniform number made from the
digest of its doc_id lies below.

Tokens are words of the package's definition, counted once per document.
Topics follow rules (``TOPICS`` unless others are given): the first whose mark occurs in
the text, else ``general``. A table with a column ``topic`` (in any case) keeps that instead.

DataFrame operations only. The cells are as many as the categories make them, not
as many as documents; they are joined back by key.

Edge cases: a null source, lang or topic is a category of its own; a null or empty
text has no tokens and gets its cell's probability; cells without tokens keep
the factor 1; equal doc_ids are taken or left together (a null doc_id counts as '');
an empty table gives no rows. A category that a target table does not list gets the target 0;
a listed one without tokens cannot be met and stays in ``raking_gap``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side

DIMENSIONS = ("source", "lang", "topic")
POWERS = {"source": 0.7, "lang": 0.8, "topic": 1.0}
RATE = 0.5
TOLERANCE = 1e-9
SWEEPS_PER_ROUND = 5
# Raking ends when a round leaves more than this share of the largest gap: targets that structural
# zeros make unreachable lower it like 1 / sweeps, for ever.
FALL = 0.9
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

# Topics of a text in order: name, mark that must occur in it.
TOPICS = (
    ("legal", "rights reserved"),
    ("license", "icense"),
    ("contact", "@"),
    ("web", "http"),
    ("symbols", "$$$"),
)


def topic(text: Column, rules: tuple = TOPICS) -> Column:
    """The name of the first rule (name, mark) whose mark occurs in the text, else ``general``."""
    out = F.lit("general")
    for name, mark in reversed(rules):
        out = F.when(F.contains(text, F.lit(mark)), name).otherwise(out)
    return out


def _topic_of(docs: DataFrame, text: Column, rules: tuple, prefix: str = "") -> Column:
    own = next((c for c in docs.columns if c.lower() == "topic"), None)
    return topic(text, rules) if own is None else F.col(f"{prefix}`{own}`").cast("string")


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the digest of seed and doc_id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def measured(docs: DataFrame, rules: tuple = TOPICS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens per row, as a written table (the texts are read once)."""
    return materialize(docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        _topic_of(docs, F.col("text"), rules).alias("topic"), tokens(F.col("text")).alias("n_tokens")), "measured")


def _targets(cells: DataFrame, powers: dict, targets: dict) -> DataFrame:
    """Cells with the target share of each of their three categories as t_<dimension>."""
    out = cells
    for d in DIMENSIONS:
        if d in targets:
            given = targets[d].select(F.col(targets[d].columns[0]).cast("string").alias("k"), F.col(targets[d].columns[1]).cast("double").alias("w"))
            shares = given.groupBy("k").agg(F.sum("w").alias("w"))
        else:
            shares = cells.groupBy(F.col(d).alias("k")).agg(F.sum("weight").alias("w")).withColumn("w", F.pow(F.col("w"), F.lit(float(powers[d]))))
        # the categories of one dimension: their sum is taken by aggregation, one row
        norm = shares.agg(F.sum("w").alias("all_w"))
        shares = shares.join(F.broadcast(norm)).select("k", (F.col("w") / F.col("all_w")).alias(f"t_{d}"))
        out = out.join(shares, out[d].eqNullSafe(shares["k"]), "left").drop("k").fillna(0.0, [f"t_{d}"])
    return out


def _sweep(cells: DataFrame) -> DataFrame:
    for d in DIMENSIONS:
        now = F.sum("raked").over(Window.partitionBy(d))
        cells = cells.withColumn("raked", F.when(now > 0, F.col("raked") * F.col(f"t_{d}") / now).otherwise(F.col("raked")))
    return cells


def _gap(cells: DataFrame, targets: dict) -> float:
    """Largest difference of a category's share from its target."""
    gaps = [cells.groupBy(d).agg((F.sum("raked") - F.first(f"t_{d}")).alias("g")).agg(F.max(F.abs("g")).alias("g")) for d in DIMENSIONS]
    # targets of categories that no cell has
    for d in targets:
        given = targets[d].select(F.col(targets[d].columns[0]).cast("string").alias("k"), F.col(targets[d].columns[1]).cast("double").alias("w"))
        norm = given.agg(F.sum("w").alias("all_w"))
        gaps.append(given.join(F.broadcast(norm)).join(cells.select(F.col(d).alias("c")).distinct(), F.col("k").eqNullSafe(F.col("c")), "left_anti")
                    .agg(F.max(F.col("w") / F.col("all_w")).alias("g")))
    return max((r.g or 0.0) for x in gaps for r in x.collect())  # a few numbers


def rake(cells: DataFrame, targets: dict | None = None, powers: dict | None = None) -> DataFrame:
    """``cells(source, lang, topic, weight)`` with ``raked`` (shares, sum 1) and ``raking_gap``.

    ``targets``: {dimension: table of (value, share)}, any scale; the other dimensions follow ``powers``.
    """
    powers, targets = {**POWERS, **(powers or {})}, targets or {}
    work = cells.where("weight > 0").withColumn("weight", F.col("weight").cast("double"))
    work = _targets(materialize(work, "cells"), powers, targets).withColumn("raked", F.col("weight"))
    work, gap, before = materialize(work, "cells"), float("inf"), float("inf")
    while gap > TOLERANCE:
        for _ in range(SWEEPS_PER_ROUND):
            work = _sweep(work)
        work = materialize(work, "cells")
        before, gap = gap, _gap(work, targets)
        if gap > before * FALL:                                  # no weights meet these targets, or only in the limit
            break
    return work.withColumn("raking_gap", F.lit(float(gap)))


def _scale(cells: DataFrame, rate: float) -> float:
    """k with sum(weight * min(1, k * factor)) = rate * sum(weight); the full cells grow until they settle."""
    total = cells.agg(F.sum("weight").alias("w")).first().w or 0.0
    k, full = 0.0, -1
    while True:
        at = F.col("factor") * F.lit(k) >= 1.0
        r = cells.agg(F.sum(F.when(at, F.col("weight")).otherwise(0.0)).alias("sure"),
                      F.sum(F.when(at, 0.0).otherwise(F.col("weight") * F.col("factor"))).alias("open"),
                      F.count(F.when(at, 1)).alias("n")).first()
        if r.n == full or not r.open:
            return k
        k, full = (rate * total - r.sure) / r.open, r.n


def probabilities(cells: DataFrame, rate: float = RATE, powers: dict | None = None, targets: dict | None = None) -> DataFrame:
    """Every cell with its calibrated inclusion ``probability`` (cells without tokens: ``rate``) and the ``raking_gap``."""
    cells = materialize(cells, "cells")
    raked = rake(cells, targets, powers)
    norm = raked.agg(F.sum("weight").alias("all_w"))
    factors = materialize(
        raked.join(F.broadcast(norm)).withColumn("factor", F.col("raked") * F.col("all_w") / F.col("weight")), "factors")
    first = factors.select("raking_gap").first()
    k = _scale(factors, rate)
    chosen = factors.select(*[F.col(d).alias(f"r_{d}") for d in DIMENSIONS], "raked",
                            F.least(F.lit(1.0), F.lit(k) * F.col("factor")).alias("p"))
    same = [cells[d].eqNullSafe(chosen[f"r_{d}"]) for d in DIMENSIONS]
    return cells.join(chosen, same[0] & same[1] & same[2], "left").select(
        *DIMENSIONS, "weight", "n_docs", F.coalesce("raked", F.lit(0.0)).alias("target_share"),
        F.coalesce("p", F.lit(float(rate))).alias("probability"), F.lit(round(first.raking_gap, 6) if first else 0.0).alias("raking_gap"))


def cell_probabilities(rows: DataFrame, rate: float = RATE, powers: dict | None = None, targets: dict | None = None) -> DataFrame:
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("weight"), F.count(F.lit(1)).alias("n_docs"))
    return materialize(probabilities(cells, rate, powers, targets), "probabilities")


def mix(docs: DataFrame, rate: float = RATE, powers: dict | None = None, seed: str = "mix", targets: dict | None = None,
        rules: tuple = TOPICS) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, target_share, probability, raking_gap, sampled."""
    rows = measured(docs, rules)
    # a join on a hot source is not salted: the cells are broadcast when their counted size allows it
    cells = small_side(cell_probabilities(rows, rate, powers, targets), 200)
    c = cells.select(*[F.col(d).alias(f"c_{d}") for d in DIMENSIONS], "target_share", "probability", "raking_gap")
    same = [rows[d].eqNullSafe(c[f"c_{d}"]) for d in DIMENSIONS]
    return (rows.join(c, same[0] & same[1] & same[2]).drop(*[f"c_{d}" for d in DIMENSIONS])
            .withColumn("sampled", uniform(F.col("doc_id"), seed) < F.col("probability")))


def sample(docs: DataFrame, rate: float = RATE, powers: dict | None = None, seed: str = "mix", targets: dict | None = None,
           rules: tuple = TOPICS) -> DataFrame:
    """The sampled documents, columns unchanged."""
    packed = docs.select(F.struct("*").alias("_row"))
    keyed = packed.select("_row", F.col("_row.source").cast("string").alias("source"), F.col("_row.lang").cast("string").alias("lang"),
                          _topic_of(docs, F.col("_row.text"), rules, "_row.").alias("topic"))
    cells = small_side(cell_probabilities(measured(docs, rules), rate, powers, targets), 200)
    c = cells.select(*[F.col(d).alias(f"c_{d}") for d in DIMENSIONS], "probability")
    same = [keyed[d].eqNullSafe(c[f"c_{d}"]) for d in DIMENSIONS]
    return (keyed.join(c, same[0] & same[1] & same[2]).where(uniform(F.col("_row.doc_id"), seed) < F.col("probability")).select("_row.*"))
