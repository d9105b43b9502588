"""URL verdicts: rules first, then empirical-Bayes reputation of the host.

*Rules.* A rule is a host and a path prefix; it fits its host and all subdomains
where the path begins with the prefix, and the longest rule that fits decides.

*Reputation.* Labelled pages are good or bad. The bad rate of a suffix is shrunk
to that of all pages, that of a registered domain to its suffix's, that of a host
to its domain's. Each level's rates are taken as draws from a beta distribution
around the parent's; how strong that prior is, is estimated from the labelled
outcomes by the method of moments. A host is blocked where the lower bound of its
bad rate's posterior, the mean less ``Z`` deviations, passes ``LIMIT``.

The suffix is the last label of a host, the registered domain the last two. All
work is DataFrame functions: three small aggregations with partial sums, so a hot
host is one row per task. The pages of hot hosts are judged where they are read,
those of the others after one join by host.

Defined cases: a null url, or one without ``://``, has an empty host and path and
is judged by the posterior of the empty host; a host without labels has its
domain's posterior, without any label the verdict is allow; null ids pass; a page
with several labels counts each of them; null labels count for nothing; repeated
rows are judged each; an empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

# Longest first.
RULES = (
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
    ("net", "/", "block"),
)
Z = 1.645
HOT = 1000
LIMIT = 0.5
# Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    rule = verdict = F.when(F.lit(False), F.lit(""))
    for name, prefix, decision in ordered:
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        rule, verdict = rule.when(fits, F.lit(name + prefix)), verdict.when(fits, F.lit(decision))
    return rule, verdict


def _strength(children: DataFrame, parent: str) -> Column:
    """The strength of the prior from which the children's rates are drawn, as a scalar.

    With rates p_i of n_i pages around the parent's mean q_i, the weighted squared
    error has expectation sum q(1-q)(1 + (n_i - 1) r), r = 1 / (m + 1).
    """
    spread = F.col(parent) * (1 - F.col(parent))
    error = F.pow(F.col("bad") / F.col("n") - F.col(parent), 2) * F.col("n")
    sums = children.agg(F.sum(error).alias("e"), F.sum(spread).alias("s"), F.sum(spread * (F.col("n") - 1)).alias("t"))
    r = (F.col("e") - F.col("s")) / F.col("t")
    m = F.when((F.col("t") > 0) & (r > 0), 1 / r - 1).otherwise(F.lit(STRONGEST))
    bounded = F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), F.coalesce(m, F.lit(STRONGEST))))
    return sums.select(bounded.alias("m")).scalar()


def _shrunk(children: DataFrame, parent: str, name: str) -> DataFrame:
    """``children`` with ``name``, the posterior mean, and ``weight``, its pages and prior."""
    return children.withColumn("m", _strength(children, parent)).select(
        "*", ((F.col("bad") + F.col("m") * F.col(parent)) / (F.col("n") + F.col("m"))).alias(name), (F.col("n") + F.col("m")).alias("weight")
    ).drop("m", parent)


def posteriors(outcomes: DataFrame, z: float = Z) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posteriors of hosts, domains, suffixes and of everything, from (host, bad) rows.

    Each has its key, ``mean`` and ``bound``.
    """
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    hosts = outcomes.filter("bad is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("bigint")).alias("bad"))
    hosts = hosts.withColumn("domain", _labels(F.col("host"), 2)).withColumn("suffix", _labels(F.col("host"), 1))
    # Every level is worked out from the counts of hosts, which are written once.
    hosts = written(hosts, "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    all_ = suffixes.agg(*sums).select((F.coalesce("n", F.lit(0)) + 2.0).alias("weight"), ((F.coalesce("bad", F.lit(0)) + 1.0) / (F.coalesce("n", F.lit(0)) + 2.0)).alias("mean_all"))
    suffixes = _shrunk(suffixes.withColumn("mean_all", all_.select("mean_all").scalar()), "mean_all", "mean_suffix")
    domains = _shrunk(domains.join(suffixes.select("suffix", "mean_suffix"), "suffix"), "mean_suffix", "mean_domain")
    hosts = _shrunk(hosts.join(domains.select("domain", "mean_domain"), "domain"), "mean_domain", "mean_host")

    def bounded(df: DataFrame, key: list[str], mean: str) -> DataFrame:
        p = F.col(mean)
        low = p - z * F.sqrt(p * (1 - p) / (F.col("weight") + 1))
        return df.select(*key, p.alias("mean"), low.alias("bound"))

    return (
        bounded(hosts, ["host"], "mean_host"), bounded(domains, ["domain"], "mean_domain"),
        bounded(suffixes, ["suffix"], "mean_suffix"), bounded(all_, [], "mean_all"),
    )


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, posterior_mean, posterior_bound) of every page.

    outcomes: (page_id, bad) of labelled pages.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    labelled = urls.select("page_id", "host").join(outcomes.select("page_id", "bad"), "page_id")
    of_host, of_domain, of_suffix, of_all = posteriors(labelled)
    known = urls.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    known = known.withColumn("domain", _labels(F.col("host"), 2)).withColumn("suffix", _labels(F.col("host"), 1))

    def named(df: DataFrame, level: str) -> DataFrame:
        return df.withColumnsRenamed({"mean": f"mean_{level}", "bound": f"bound_{level}"})

    known = (
        known.join(named(of_host, "host"), "host", "left")
        .join(named(of_domain, "domain"), "domain", "left")
        .join(named(of_suffix, "suffix"), "suffix", "left")
        .withColumns({f"{x}_all": of_all.select(x).scalar() for x in ("mean", "bound")})
    )
    level = ("host", "domain", "suffix", "all")
    known = known.select("host", "n_pages", *[F.coalesce(*[f"{x}_{y}" for y in level]).alias(f"posterior_{x}") for x in ("mean", "bound")])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_rate = F.when(F.col("posterior_bound") > limit, "block").otherwise("allow")
    # Hosts with more than a share of 1 / HOT of all pages are fewer than HOT, so
    # they can be broadcast; the pages of the others spread over the join's tasks.
    known = written(known, "judged")
    hot = F.col("n_pages") * HOT > known.agg(F.sum("n_pages")).scalar()
    often, rare = F.broadcast(known.filter(hot)), known.filter(~hot)
    rows = urls.join(often, "host").unionByName(urls.join(often.select("host"), "host", "left_anti").join(rare, "host"))
    return rows.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_rate).alias("verdict"), "posterior_mean", "posterior_bound"
    )
