"""URL filter: fixed rules, and empirical-Bayes reputation of hosts where no rule fits.

A host's share of bad pages is shrunk towards its registered domain's, that
towards its suffix's, and that towards the share of all labelled pages. On
each level the beta prior's mean is the posterior mean of the level above and
its strength comes from the moments of the beta-binomial distribution. A host
is blocked when the lower posterior bound of its share of bad pages is above
``max_bad``: few or no labels never block a host that its relatives do not.

Only DataFrame functions; the driver sees three sums per level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Scheme, host and path of a url.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Rules of the query: (action, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Suffixes of two labels under which domains are registered (fixed values).
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp",
              "co.kr", "com.br", "com.cn", "com.mx", "com.ar", "com.tr", "co.in", "co.za", "com.sg")
#: Block above this share of bad pages, at this many standard deviations below the mean.
MAX_BAD = 0.5
DEVIATIONS = 1.645
LEAST_RHO = 1e-4
#: Pages that stand for what is known before any label: few are bad.
PRIOR_BAD, PRIOR_GOOD = 1.0, 9.0


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    labels = F.split(host, r"\.")
    two = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)))
    return F.when(two.isin(*TWO_LABELS), two).otherwise(F.element_at(labels, -1))


def registered_of(host: Column) -> Column:
    """The suffix and one label before it."""
    labels = F.split(host, r"\.")
    keep = F.size(F.split(suffix_of(host), r"\.")) + 1
    return F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - keep + 1, F.lit(1)), keep))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its action) of the longest rule that fits, null if none does."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        action = F.when(fits, F.lit(verdict)).otherwise(action)
    return name, action


def _posterior(level: DataFrame, mean: Column, strength: float) -> DataFrame:
    a = strength * mean + F.col("bad")
    b = strength * (1 - mean) + F.col("n") - F.col("bad")
    return level.withColumn("mean", a / (a + b)).withColumn(
        "deviation", F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))


def _strength(level: DataFrame, mean: Column) -> float:
    """Prior strength from E[n (rate - mean)^2] = mean (1 - mean) (1 + (n - 1) rho)."""
    spread = F.col("n") * (F.col("bad") / F.col("n") - mean) * (F.col("bad") / F.col("n") - mean) / (mean * (1 - mean))
    s, groups, total = level.where("n > 0").agg(F.sum(spread), F.count("*"), F.sum("n")).first()
    rho = (s - groups) / (total - groups) if groups and total > groups else 0.0
    rho = min(max(rho, LEAST_RHO), 1 - LEAST_RHO)
    return (1 - rho) / rho


def reputation(outcomes: DataFrame) -> DataFrame:
    """Posterior of every host: ``host``, ``n``, ``bad``, ``mean``, ``deviation``.

    ``outcomes`` has ``host`` and ``bad`` (1, 0, or null for a page without
    label); hosts with unlabelled pages only get their domain's prior. Without
    any label the mean is that of ``PRIOR_BAD`` and ``PRIOR_GOOD``.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = written(hosts.withColumns({"domain": registered_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total, bad = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    everywhere = F.lit((bad + PRIOR_BAD) / (total + PRIOR_BAD + PRIOR_GOOD))

    suffixes = _posterior(suffixes, everywhere, _strength(suffixes, everywhere))
    above = suffixes.select("suffix", F.col("mean").alias("above"))
    domains = domains.join(above, "suffix")
    domains = _posterior(domains, F.col("above"), _strength(domains, F.col("above")))
    above = domains.select("domain", F.col("mean").alias("above"))
    hosts = hosts.join(above, "domain")
    return _posterior(hosts, F.col("above"), _strength(hosts, F.col("above"))).select(
        "host", "n", "bad", "mean", "deviation")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
          max_bad: float = MAX_BAD, deviations: float = DEVIATIONS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict on every page.

    Returns ``page_id``, ``host``, ``path``, ``rule`` (of the longest rule
    that fits, or null), ``verdict`` (``allow`` or ``block``), ``bad_rate``
    and ``bound`` (posterior mean and lower bound of the host's share of bad
    pages, to six digits). One row out per row in. A null url or one without
    ``://`` has an empty host and path, which is judged as a host like any
    other. The last number of a path is the document that the page shows;
    ``labels`` (doc_id, quality, toxic) judge those, bad being quality 0 or
    toxic 1 in any of a document's rows. Without labels all is allowed that no
    rule blocks. Null ids and repeated rows pass through; other columns are
    ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # Digits that fit a long; leading zeros do not name a document.
    shown = F.regexp_extract("path", r"/([1-9][0-9]{0,17}|0)(?:\.[a-z]+)?/?$", 1)
    judged = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("shown"))
              .agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1)
                         .when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)).alias("bad")))
    outcomes = rows.select("host", shown.alias("shown")).join(judged, "shown", "left").select("host", "bad")
    table = written(reputation(outcomes), "reputation")
    bound = F.col("mean") - deviations * F.col("deviation")
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    return rows.join(table, "host").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(action, F.when(bound > max_bad, "block").otherwise("allow")).alias("verdict"),
        F.round("mean", 6).alias("bad_rate"), F.round(bound, 6).alias("bound"))
