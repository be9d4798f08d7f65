"""URL filters: rules first, else empirical-Bayes reputation of the host.

Labelled outcomes (a label is good when quality is 1 and toxic is 0) are counted
per host. Beta-binomial priors are shrunk down the tree: suffix towards all pages,
registered domain towards its suffix, host towards its domain. The strength of each
level's prior is estimated from the data by Kleinman's moment estimator. A host is
blocked when the upper bound of its posterior good rate (mean + Z standard
deviations) lies below ``FLOOR``; hosts without labels inherit their domain.

Counts are pre-aggregated per page and host, so a host with a third of all pages costs
its map-side partial sums. The reputations go back to the pages by a join on the host,
broadcast only if their counted rows fit.

Edge cases: a null url or one without ``://`` has empty host and path, takes part as
host '' and is never blocked by a rule; pages without label only inherit; several
labels of a page are several outcomes; null labels count as not given; with no
labels at all everything is allowed; repeated pages are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, materialize, small_side

# (verdict, host, path): fits the host and its subdomains below the path; the longest wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Public suffixes of two labels; every other suffix is the last label.
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za", "com.cn", "co.in")
FLOOR = 0.5
Z = 1.645
STRENGTH = (1.0, 10_000.0)


def host_of(url: Column) -> Column:
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_PART_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_PART_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, or nulls."""
    name = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _strength(groups: DataFrame, parent: str, mean: Column) -> float:
    """Prior strength of a level: ``groups(n, x, parent)`` scatter around the parent's mean."""
    own = groups.where("n > 0").withColumn("mu", mean)
    per = own.groupBy(parent).agg(
        F.sum((F.col("x") - F.col("n") * F.col("mu")) * (F.col("x") - F.col("n") * F.col("mu"))
              / (F.col("n") * F.col("mu") * (1 - F.col("mu")))).alias("s"),
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("q"))
    r = per.agg(F.sum("s").alias("s"), F.sum(F.col("k") - 1).alias("f"), F.sum(F.col("t") - F.col("q") / F.col("t")).alias("d")).first()
    low, high = STRENGTH
    if not r.f or r.d - r.f <= 0:
        return low if r.f is None else high
    gamma = (r.s - r.f) / (r.d - r.f)                           # intra-class correlation
    return high if gamma <= 1 / (high + 1) else max(low, 1 / gamma - 1)


def _shrunk(groups: DataFrame, parents: DataFrame | None, key: str, top: float) -> tuple[DataFrame, float]:
    """Adds the posterior ``rate`` of each group around its parent's ``rate``, and the level's strength."""
    if parents is None:
        held = groups.withColumn("mu", F.lit(top)).withColumn("_all", F.lit(1))
        key = "_all"
    else:
        held = groups.join(parents.select(F.col(key).alias("_p"), F.col("rate").alias("mu")), groups[key] == F.col("_p")).drop("_p")
    held = materialize(held, "reputation")
    m = _strength(held, key, F.col("mu"))
    return held.withColumn("rate", (m * F.col("mu") + F.col("x")) / (m + F.col("n"))), m


def reputations(hosts: DataFrame) -> DataFrame:
    """``hosts(host, n, x)`` with the posterior: rate, lower, upper."""
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    hosts = materialize(hosts, "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("x").alias("x")).first()
    top = ((total.x or 0) + 1) / ((total.n or 0) + 2)            # never 0 or 1
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    suffixes, _ = _shrunk(suffixes, None, "suffix", top)
    domains, _ = _shrunk(domains, suffixes, "suffix", top)
    out, m = _shrunk(hosts, domains, "domain", top)
    a, b = m * F.col("mu") + F.col("x"), m * (1 - F.col("mu")) + F.col("n") - F.col("x")
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return out.select("host", F.col("n").alias("n_labels"), "rate",
                      F.greatest(F.lit(0.0), F.col("rate") - Z * sd).alias("lower"),
                      F.least(F.lit(1.0), F.col("rate") + Z * sd).alias("upper"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, floor: float = FLOOR) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labels, rate, lower, upper of every page.

    ``labels(doc_id, quality, toxic)`` are outcomes of the page of that id.
    """
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")) \
        .fillna({"host": "", "path": ""})
    known = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    good = (F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    outcomes = labels.where(known).groupBy(F.col("doc_id").alias("_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(good.cast("long")).alias("x"))
    hosts = (pages.join(outcomes, pages["page_id"] == outcomes["_id"], "left").groupBy("host")
             .agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.coalesce("x", F.lit(0))).alias("x")))
    known_hosts = small_side(materialize(reputations(hosts), "reputations"), 200)
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return pages.join(known_hosts, "host").select(
        "page_id", "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.when((F.col("upper") < floor) & (F.col("host") != ""), "block").otherwise("allow")).alias("verdict"),
        "n_labels", "rate", "lower", "upper")


def allowed(pages: DataFrame, labels: DataFrame, rules=RULES, floor: float = FLOOR) -> DataFrame:
    """The page_ids and urls' hosts that pass the filter."""
    return judge(pages, labels, rules, floor).where(F.col("verdict") == "allow")
