"""URL filters: rules first, then empirical-Bayes host reputation.

A page is a bad outcome if its label says quality 0 (several labels: the least).
The shares of bad pages are shrunk level by level with beta-binomial priors: a
suffix towards the rate of all labelled pages, a registered domain towards its
suffix, a host towards its domain.  A suffix is one of ``SUFFIXES``, else the last
label; a registered domain is a suffix and the label before it.  Ports and final
dots do not matter to either, and an IP address is a domain as a whole.  The
strength of each level's prior is estimated from all groups of that level by the
method of moments, within ``STRENGTH``.  A page without a fitting rule is blocked
if the lower bound of its host's posterior (mean less ``Z`` standard deviations)
is above ``BAD_RATE``.

Scale: outcomes are counted per host, partially before the shuffle, so a hot host
is one row per task; priors are joins of the small group tables; pages meet their
host's verdict in one equi-join, whose hot keys the planner splits.  The driver
gets three prior strengths.

Edge cases: a null url or one without ``://`` has empty host and path and no rule;
hosts of one label are their own domain; a host without a labelled page has its
domain's mean, and without any label nothing is blocked; null ids have no label;
repeated pages are judged, and count, as often as they come.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BAD_RATE = 0.5
Z = 1.645
#: Least and greatest strength of a prior, in pages; the least is also that of the overall rate.
STRENGTH = (2.0, 1000.0)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


# Public suffixes of two labels under which names are registered.
SUFFIXES = (
    "co.at", "or.at", "com.au", "net.au", "org.au", "edu.au", "gov.au", "com.br", "net.br", "org.br", "gov.br",
    "com.cn", "net.cn", "org.cn", "edu.cn", "gov.cn", "com.co", "com.eg", "com.es", "com.hk", "org.hk", "co.hu",
    "co.id", "or.id", "go.id", "ac.id", "co.il", "org.il", "ac.il", "co.in", "net.in", "org.in", "ac.in", "gov.in",
    "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp", "co.ke", "co.kr", "or.kr", "ac.kr", "go.kr", "com.mx", "org.mx",
    "gob.mx", "com.my", "com.ng", "co.nz", "net.nz", "org.nz", "ac.nz", "govt.nz", "com.pe", "com.ph", "com.pk",
    "com.pl", "net.pl", "org.pl", "com.pt", "com.sa", "com.sg", "edu.sg", "co.th", "ac.th", "com.tr", "org.tr",
    "edu.tr", "com.tw", "org.tw", "edu.tw", "com.ua", "co.uk", "org.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk",
    "ac.uk", "gov.uk", "nhs.uk", "sch.uk", "com.ve", "com.vn", "co.za", "org.za", "ac.za", "gov.za",
    "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app",
    "wordpress.com",
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    known = url.isNotNull()
    return (
        F.when(known, F.translate(host, _UPPER, _LOWER)).otherwise(F.lit("")),
        F.when(known, path).otherwise(F.lit("")),
    )


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does."""
    name: Column = F.lit(None).cast("string")
    verdict: Column = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def site(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; an address is its own domain, under the empty suffix."""
    name = F.regexp_replace(host, r"\.*(:[0-9]*)?$", "")
    address = name.rlike(r"^[0-9]+(\.[0-9]+){3}$") | name.startswith("[")
    two = F.substring_index(name, ".", -2)
    wide = two.isin(*SUFFIXES)
    domain = F.when(address, name).when(wide, F.substring_index(name, ".", -3)).otherwise(two)
    suffix = F.when(address, F.lit("")).when(wide, two).otherwise(F.substring_index(name, ".", -1))
    return domain, suffix


def strength(groups: DataFrame) -> Column:
    """Method of moments over the groups with outcomes: the beta prior's strength a + b, an aggregate."""
    n, bad, k = F.sum("n"), F.sum("bad"), F.count_if(F.col("n") > 0)
    rate = F.try_divide(bad, n)
    squares = F.sum(F.try_divide(F.col("bad") * F.col("bad"), F.col("n")))
    spread = F.try_divide(squares, n) - rate * rate
    extra = spread - F.try_divide(rate * (1 - rate) * k, n)  # beyond what binomial draws alone would spread
    least, most = F.lit(STRENGTH[0]), F.lit(STRENGTH[1])
    moments = F.greatest(least, F.least(most, F.try_divide(rate * (1 - rate) - extra, extra)))
    return F.when(extra > 0, moments).otherwise(most)


def reputations(outcomes: DataFrame) -> DataFrame:
    """Per host its posterior: host, n, bad, a, b, bound.

    ``outcomes`` has a row per page: host, and bad (0 or 1, null without a label).
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    domain, suffix = site(F.col("host"))
    hosts = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    k = [g.agg(strength(g)).first()[0] for g in (hosts, domains, suffixes)]
    total = suffixes.agg(*sums).first()
    least = STRENGTH[0]
    rate = ((total["bad"] or 0) + BAD_RATE * least) / ((total["n"] or 0) + least)

    def shrunk(df: DataFrame, prior: Column, strength_: float) -> DataFrame:
        a, b = F.col("bad") + prior * strength_, F.col("n") - F.col("bad") + (1 - prior) * strength_
        return df.withColumn("a", a).withColumn("b", b)

    def beneath(df: DataFrame, key: str, above: DataFrame) -> DataFrame:
        """The groups beside the posterior mean of the group above them."""
        up = above.select(F.col(key).alias("up"), (F.col("a") / (F.col("a") + F.col("b"))).alias("prior"))
        return df.join(up, F.col(key) == F.col("up")).drop("up")

    suffix = shrunk(suffixes, F.lit(rate), k[2])
    domain = shrunk(beneath(domains, "suffix", suffix), F.col("prior"), k[1])
    host = shrunk(beneath(hosts, "domain", domain), F.col("prior"), k[0])
    return host.select("host", "n", "bad", "a", "b", lower_bound(F.col("a"), F.col("b")).alias("bound"))


def lower_bound(a: Column, b: Column) -> Column:
    mean = a / (a + b)
    return mean - Z * F.sqrt(mean * (1 - mean) / (a + b + 1))


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """Per page: its id, host, path, rule, verdict and, where no rule fits, the posterior's bound.

    ``labels`` (doc_id, quality) label the pages whose id they name.
    """
    host, path = url_parts(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    bad = labels.groupBy("doc_id").agg(F.min("quality").alias("q"))
    outcomes = parsed.join(bad, F.col("page_id") == F.col("doc_id"), "left").select(
        "host", F.when(F.col("q") == 0, 1).when(F.col("q") == 1, 0).alias("bad")
    )
    known = reputations(outcomes).select(F.col("host").alias("known"), "bound")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("bound") > BAD_RATE, F.lit("block")).otherwise(F.lit("allow"))
    return parsed.join(known, F.col("host") == F.col("known"), "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "bound"
    )
