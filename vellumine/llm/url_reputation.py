"""URL filter: stated rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad = toxic or of low quality) are counted by host, registered domain and suffix.
Each level's counts are shrunk through a beta-binomial prior centred on the level above: the suffix on the
whole, the domain on its suffix, the host on its domain. A prior's strength is fitted by moments over the
level's groups, within stated bounds. A host is bad where the lower bound of its beta posterior, the quantile
that its rate exceeds with the chance ``sure``, lies above a limit. The limit follows the whole's bad rate:
its odds are ``lift`` times the whole's. The bound is above the limit exactly where the posterior's mass above
the limit is more than ``sure``, and that mass is computed, by the continued fraction of the incomplete beta.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, written

#: (verdict, rule): host, then a path that the url's path has to start with.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Suffixes of two labels that this filter treats as one. Any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.kr", "co.in", "co.za", "com.br", "com.mx", "com.cn", "com.tr")
LIFT = 1.5
SURE = 0.9
STRENGTH = (2.0, 200.0)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no '://'."""
    has = url.isNotNull() & (F.instr(url, "://") > 0)
    rest = F.when(has, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    after = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), after


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):  # later ones are longer and win
        name, start = text.split("/", 1)[0].lower(), "/" + text.split("/", 1)[1]
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    last2 = F.substring_index(bare, ".", -2)
    return F.when(last2.isin(*TWO_LABEL_SUFFIXES), last2).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and one label more."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    last2 = F.substring_index(bare, ".", -2)
    return F.when(last2.isin(*TWO_LABEL_SUFFIXES), F.substring_index(bare, ".", -3)).otherwise(last2)


def strength(groups: DataFrame, bounds: tuple[float, float] = STRENGTH) -> Column | DataFrame:
    """One row: the beta-binomial strength of a level, by moments. groups: n, bad, centre."""
    spread = F.sum(F.pow(F.col("bad") - F.col("n") * F.col("centre"), 2))
    binomial = F.sum(F.col("n") * F.col("centre") * (1 - F.col("centre")))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) * F.col("centre") * (1 - F.col("centre")))
    # rho is the correlation of two pages of a group; the strength a + b is 1 / rho - 1.
    rho = F.greatest(F.lit(1e-9), F.try_divide(spread - binomial, pairs))
    return groups.agg(F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), F.coalesce(1 / rho - 1, F.lit(bounds[1])))).alias("strength"))


def shrunk(groups: DataFrame) -> DataFrame:
    """groups: any columns, n, bad, centre. Adds the posterior's a and b."""
    return groups.crossJoin(F.broadcast(strength(groups))).withColumns({
        "a": F.col("strength") * F.col("centre") + F.col("bad"),
        "b": F.col("strength") * (1 - F.col("centre")) + F.col("n") - F.col("bad"),
    }).drop("strength")


def log_gamma(z: Column) -> Column:
    """By Stirling's series eight steps up."""
    y = z + 8
    product = z
    for k in range(1, 8):
        product = product * (z + k)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(product)


def mass_above(limit: Column, a: Column, b: Column) -> Column:
    """How much of a beta distribution of a and b lies above limit (between 0 and 1)."""
    turned = limit > (a + 1) / (a + b + 2)  # the fraction converges fast on the short side
    x, p, q = F.when(turned, 1 - limit).otherwise(limit), F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b)

    def term(t: Column, m: Column) -> Column:
        k = F.floor(m / 2)
        even = k * (q - k) * x / ((p + 2 * k - 1) * (p + 2 * k))
        odd = -(p + k) * (p + q + k) * x / ((p + 2 * k) * (p + 2 * k + 1))
        return 1 + F.when(m % 2 == 0, even).otherwise(odd) / t

    terms = F.sequence((F.lit(50) + F.floor(4 * F.sqrt(a + b))).cast("int"), F.lit(1), F.lit(-1))
    fraction = F.aggregate(terms, F.lit(1.0), term)
    below = F.exp(p * F.log(x) + q * F.log(1 - x) + log_gamma(p + q) - log_gamma(p) - log_gamma(q)) / (p * fraction)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(turned, below).otherwise(1 - below)))


def level(groups: DataFrame) -> DataFrame:
    """groups: any columns, n, bad, centre; the posterior, as a table."""
    groups = written(groups, "reputation-groups")
    out = written(shrunk(groups), "reputation-level")
    discard(groups)
    return out


def reputations(pages: DataFrame, outcomes: DataFrame, lift: float = LIFT) -> DataFrame:
    """pages: page_id, host; outcomes: page_id, bad (0 or 1). host, domain, suffix, n, bad, mean, bad_chance."""
    seen = F.max(F.col("bad"))
    labelled = outcomes.groupBy("page_id").agg(seen.cast("double").alias("was_bad")).where("page_id is not null and was_bad is not null")
    counts = pages.join(labelled, "page_id", "left").groupBy("host").agg(F.count("was_bad").alias("n"), F.coalesce(F.sum("was_bad"), F.lit(0.0)).alias("bad"))
    hosts = written(counts.withColumns({"suffix": suffix_of(F.col("host")), "domain": domain_of(F.col("host"))}), "host-counts")
    # Each level is written once: the strength, the rates and the level below all read it.
    whole = written(hosts.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("centre")).select(F.coalesce("centre", F.lit(0.5)).alias("centre")), "whole-rate")
    suffixes = level(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).crossJoin(F.broadcast(whole)))
    above = suffixes.select("suffix", (F.col("a") / (F.col("a") + F.col("b"))).alias("centre"))
    domains = level(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(above, "suffix"))
    above = domains.select("domain", "suffix", (F.col("a") / (F.col("a") + F.col("b"))).alias("centre"))
    final = level(hosts.join(above, ["domain", "suffix"]))
    base = F.col("whole")
    final = final.crossJoin(F.broadcast(whole.select(F.col("centre").alias("whole")))).withColumn("limit", lift * base / (1 - base + lift * base))
    return final.select("host", "domain", "suffix", "n", "bad", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"), mass_above(F.col("limit"), F.col("a"), F.col("b")).alias("bad_chance"))


def url_filter(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, lift: float = LIFT, sure: float = SURE) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, bad_chance: one row per row of pages.

    labels: doc_id, quality, toxic. The page that a label is about is the one whose page_id is its doc_id; nothing
    else ties the two tables. Rows of null id or outcome count as unlabelled. A page of several labels is bad if any
    says so. Null urls and urls without '://' have an empty host, judged as one. An empty table gives no rows.
    Ties between rules cannot arise: of two rules of one length at most one fits unless they are equal.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad"))
    known = written(reputations(rows, outcomes, lift).select("host", "mean", "bad_chance"), "host-reputation")
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    judged = rows.join(known, "host", "left")
    own = F.when(F.col("bad_chance") > sure, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("mean").alias("bad_rate"), "bad_chance")
