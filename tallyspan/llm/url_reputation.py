"""URL filter: written rules first, then an empirical-Bayes reputation of hosts.

Labelled outcomes of pages are counted by host. A host's bad rate is shrunk towards that of its registered domain, the domain's
towards that of its public suffix, the suffix's towards that of all pages, each time through a beta-binomial prior whose strength
the spread of the counted rates at that level decides. A host is blocked when the lower bound of its posterior bad rate is above a limit,
so a few bad pages of a small host don't block it, while the same share of many pages does.

Column functions and grouped sums only: counts combine before their shuffle, and the tables joined back hold one row per host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyspan.llm.common import fold_ascii, settle

#: Public suffixes of two labels under which names are registered; any other suffix is the last label.
DOUBLE_SUFFIXES = (
    "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.sg", "com.tr",
    "com.tw", "edu.au", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.nz", "org.uk",
)
#: Rules of the registered query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@dataclass(frozen=True)
class Reputation:
    """`limit`: bad rate above which a host is blocked; `z`: standard deviations below the posterior mean where the bound lies."""

    limit: float = 0.3
    z: float = 1.645
    least_strength: float = 2.0
    most_strength: float = 1000.0


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(fold_ascii(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rules(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; of equally long ones the first in order of their text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _site(host: Column) -> Column:
    """The host without user and port, as registration sees it."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def suffix_of(host: Column) -> Column:
    two = F.substring_index(_site(host), ".", -2)
    return F.when(two.isin(*DOUBLE_SUFFIXES), two).otherwise(F.substring_index(_site(host), ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(_site(host), ".", -2)
    return F.when(two.isin(*DOUBLE_SUFFIXES), F.substring_index(_site(host), ".", -3)).otherwise(two)


def _strength(groups: DataFrame, settings: Reputation) -> Column:
    """Strength of one level's prior by the method of moments, as a one-row subquery; `groups` has counts n, k and the parent's rate p."""
    seen = groups.filter("n > 0")
    total, many = F.sum("n"), F.count("*")
    noise = F.try_divide(F.sum(F.col("p") * (1 - F.col("p"))), many)
    spread = F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("p"), 2))
    between = F.try_divide(spread - (many - 1) * noise, total - F.try_divide(F.sum(F.col("n") * F.col("n")), total))
    found = seen.agg(noise.alias("noise"), between.alias("between")).select(
        F.when(F.col("between") > 0, F.col("noise") / F.col("between") - 1).otherwise(settings.most_strength).alias("m"))
    return found.select(F.greatest(F.lit(settings.least_strength), F.least(F.lit(settings.most_strength), F.col("m")))).scalar()


def _posterior(groups: DataFrame, settings: Reputation) -> DataFrame:
    m = _strength(groups, settings)
    return groups.withColumn("m", m).withColumn("rate", (F.col("k") + F.col("m") * F.col("p")) / (F.col("n") + F.col("m")))


def host_reputation(pages: DataFrame, outcomes: DataFrame, settings: Reputation | None = None) -> DataFrame:
    """Posterior bad rate of every host: rows (host, n, k, rate, bound) for pages (page_id, host) and outcomes (page_id, bad)."""
    settings = settings or Reputation()
    per_page = outcomes.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    joined = pages.join(per_page, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = settle(joined.select("*", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")), "hosts")

    rate = hosts.agg(F.coalesce(F.try_divide(F.sum("k"), F.sum("n")), F.lit(0.0))).scalar()
    sums = (F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = settle(_posterior(hosts.groupBy("suffix").agg(*sums).withColumn("p", rate), settings), "suffixes")
    parents = suffixes.select("suffix", F.col("rate").alias("p"))
    domains = settle(_posterior(hosts.groupBy("suffix", "domain").agg(*sums).join(parents, "suffix"), settings), "domains")
    parents = domains.select("suffix", "domain", F.col("rate").alias("p"))
    found = _posterior(hosts.join(parents, ["suffix", "domain"]), settings)
    error = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("m") + 1))
    return found.select("host", "n", "k", "rate", (F.col("rate") - settings.z * error).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, settings: Reputation | None = None) -> DataFrame:
    """Every page's host, path, rule and verdict: rows (page_id, host, path, rule, verdict, bad_rate, bound), one per row of `pages`.

    `rules` are pairs of verdict and text, host before the first `/` and path from there; a rule fits its host and all subdomains where
    the page's path starts with the rule's. The longest decides; without one the reputation of the host does. Null urls and urls without
    `://` have an empty host, which is a host like any other. Several outcomes of a page count once, bad if one is bad; outcomes of
    unknown pages and null ones count nothing; without any outcome every host is allowed. Rows with a null page_id are judged
    too. Repeated rows stay repeated; other columns are ignored; an empty table gives an empty table.
    """
    settings = settings or Reputation()
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    bounds = settle(host_reputation(parts.select("page_id", "host"), outcomes, settings), "reputation")
    rule, ruled = _rules(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("bound") > settings.limit, F.lit("block")).otherwise(F.lit("allow"))
    return parts.join(bounds, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, judged).alias("verdict"),
        F.round("rate", 9).alias("bad_rate"), F.round("bound", 9).alias("bound"),
    )
