"""Operator 10, URL filters: hand rules first, then empirical-Bayes host reputation.

Pages with a labelled outcome are counted per host, registered domain and suffix.  Each level is a
beta-binomial population: its spread gives the strength of the prior, its parent the mean, so a host with few
labels takes most of its rate from its domain, a domain from its suffix and a suffix from the whole.  A host
is blocked when the lower posterior bound of its bad rate passes a threshold.

Counts are pre-aggregated before every shuffle, so a host with a third of all pages costs one row per task;
the prior strengths are three aggregated numbers.  Host verdicts go back to pages by an ordinary join
whose large partitions Spark can split.

Defined cases: a null url or one without ``://`` has host and path '' (it counts as a host of its own); a page
without label adds nothing; a null or unknown host takes the verdict of the prior; repeated rows are judged
one by one; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ascii_lower, written

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: Second-level labels under which registered domains have three parts.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]

#: The rules of the registered query: verdict and host/path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def registered_domain(host: Column) -> Column:
    """Last two labels, or three under a two-letter suffix with a common second level."""
    second = F.element_at(F.split(F.substring_index(host, ".", -2), r"\."), 1)
    three = (F.length(suffix_of(host)) == 2) & second.isin(SECOND_LEVEL)
    return F.when(three, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, or null; ``rules`` is a short list given by the caller."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, slash, start = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def html_outcome(html: Column) -> Column:
    """Label of a page by its own content: 1 bad, 0 good, null undecided.

    Bad: a symbol for every fourth word of the visible text at least.  Good: twenty words or more with at most
    one symbol in fifty.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " "), "&amp;", "&")
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|!]"))
    return F.when((words > 0) & (symbols * 4 >= words), 1).when((words >= 20) & (symbols * 50 <= words), 0)


def _strength(level: DataFrame) -> float:
    """How many observations the prior of this level is worth, by the method of moments.

    With n labels and k bad ones per member and the parent's rate m: the excess of sum((k - n m)^2) over its
    binomial expectation measures the spread between members.
    """
    v = F.col("m") * (1 - F.col("m"))
    n, k = F.col("n"), F.col("k")
    scaled = lambda x: F.sum(F.round(x, 6).cast("decimal(38,6)"))  # noqa: E731  exact sums do not depend on their order
    q, e, d = (float(x or 0) for x in level.agg(
        scaled((k - n * F.col("m")) * (k - n * F.col("m"))), scaled(n * v), scaled(n * (n - 1) * v)).first())
    rho = min(max((q - e) / d if d > 0 else 0.0, 0.001), 0.5)
    return (1 - rho) / rho


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """Posterior bad rate and lower bound per host from ``outcomes`` (host string, bad 0/1 or null)."""
    hosts = outcomes.groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k"))
    hosts = hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    hosts = written(hosts, "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = (x or 0 for x in hosts.agg(F.sum("n"), F.sum("k")).first())

    def shrink(level: DataFrame) -> DataFrame:
        strength = _strength(level)
        return level.withColumn("a", F.col("k") + strength * F.col("m")).withColumn(
            "b", F.col("n") - F.col("k") + strength * (1 - F.col("m")))

    mean = F.col("a") / (F.col("a") + F.col("b"))
    # A mild prior keeps the rate of the whole inside (0, 1) when nothing is labelled.
    s = shrink(suffixes.withColumn("m", F.lit((k + 0.5) / (n + 1.0)))).select("suffix", mean.alias("m"))
    d = shrink(domains.join(s, "suffix")).select("domain", mean.alias("m"))
    h = shrink(hosts.join(d, "domain"))
    sd = F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    return h.select("host", F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"), mean.alias("bad_rate"),
                    (mean - z * sd).alias("bad_bound"))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]] = RULES, threshold: float = 0.3, z: float = 1.645,
                 outcome: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    The labelled outcomes are the verdicts of the rules where one fits and ``outcome`` (0/1/null, by default
    ``html_outcome``) elsewhere.
    """
    content = html_outcome(F.col("html")) if outcome is None else outcome
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), content.alias("bad"))
    p = p.withColumn("_r", longest_rule(F.col("host"), F.col("path"), rules))
    ruled = F.when(F.col("_r.verdict") == "block", 1).when(F.col("_r.verdict") == "allow", 0)
    rep = host_reputation(p.select("host", F.coalesce(ruled, "bad").alias("bad")), z).select("host", "bad_bound")
    judged = p.drop("bad").join(rep, "host", "left")
    method = F.when(F.col("bad_bound") > threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("_r.rule").alias("rule"),
                         F.coalesce(F.col("_r.verdict"), method).alias("verdict"))
