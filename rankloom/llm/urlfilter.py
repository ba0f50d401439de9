"""URL filter: host and path rules first, else the host's empirical-Bayes reputation. DataFrame functions only.

Labelled page outcomes (bad or not) are counted by host. A beta-binomial prior passes from suffix to registered domain
to host: each level's mean is shrunk towards the level above with a weight (prior sample size) estimated from the
spread between its units by the method of moments. A host is blocked where the lower bound of its posterior bad rate
exceeds the threshold; hosts without outcomes of their own have their domain's or suffix's mean and a wide posterior.

A url that is null or has no `://` has the empty host and path; it is judged like any host, as that of all such pages.
Pages of a null id are judged, without outcomes. Labels that are null count for nothing; a page labelled more than once
has as many outcomes; repeated page rows are judged one by one. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Standard deviations below the posterior mean, the bad rate that this bound may reach, bounds of the prior sample size, its value where the data give none.
Z, THRESHOLD, WEIGHTS, WEIGHT = 1.28, 0.2, (1.0, 1000.0), 10.0


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def weight_of(units: DataFrame) -> Column:
    """The prior sample size that the spread of units' rates (columns n, bad) speaks for, as a scalar subquery."""
    n, x = F.col("n").cast("double"), F.col("bad").cast("double")
    sums = units.where("n > 0").agg(F.count("*").cast("double").alias("k"), F.sum(n).alias("N"), F.sum(n * n).alias("NN"), F.sum(x).alias("X"), F.sum(x * x / n).alias("S"))
    v = F.col("X") / F.col("N") * (1 - F.col("X") / F.col("N"))
    free = v * (F.col("N") - F.col("NN") / F.col("N") - (F.col("k") - 1))
    rho = (F.col("S") - F.col("X") * F.col("X") / F.col("N") - v * (F.col("k") - 1)) / free
    low, high = 1 / (1 + WEIGHTS[1]), 1 / (1 + WEIGHTS[0])
    rho = F.least(F.greatest(rho, F.lit(low)), F.lit(high))
    return sums.select(F.when((F.col("N") > 0) & (F.col("k") > 1) & (v > 0) & (free > 0), 1 / rho - 1).otherwise(F.lit(WEIGHT)).alias("w")).scalar()


def reputation(hosts: DataFrame) -> DataFrame:
    """hosts (host, n outcomes, bad) with bad_rate (posterior mean) and bad_bound (its lower bound)."""
    labels = F.split("host", r"\.")
    hosts = hosts.select("host", "n", "bad", F.array_join(F.slice(F.concat(F.array(F.lit(""), F.lit("")), labels), -2, 2), ".").alias("domain"), F.element_at(labels, -1).alias("suffix"))
    total = lambda rows, *keys: rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = total(hosts, "domain", "suffix")
    suffixes = total(domains, "suffix")
    shrunk = lambda up, w: (F.col("bad") + w * up) / (F.col("n") + w)
    top = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m")).scalar()
    s = suffixes.select("suffix", shrunk(top, weight_of(suffixes)).alias("up"))
    d = domains.join(s, "suffix").select("domain", shrunk(F.col("up"), weight_of(domains)).alias("up"))
    w = weight_of(hosts)
    h = hosts.join(d, "domain").select("host", (F.col("bad") + w * F.col("up")).alias("a"), (F.col("n") - F.col("bad") + w * (1 - F.col("up"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    mean, spread = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return h.select("host", mean.alias("bad_rate"), (mean - Z * spread).alias("bad_bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """pages (page_id, url) and outcomes (page_id, bad 0/1) to page_id, host, path, rule, verdict, bad_bound."""
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    counts = outcomes.where("bad is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = cut(own.join(counts, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))  # read for each prior
    fits = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_bound") > threshold, "block").otherwise("allow")
    return own.join(reputation(hosts), "host").withColumn("_rule", fits).select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), method).alias("verdict"), "bad_bound")


def weight_sql(units: str) -> str:
    """weight_of() in SQL, for the oracle."""
    return f"""(select case when tn > 0 and k > 1 and v > 0 and free > 0 then 1 / least(greatest((ss - tx * tx / tn - v * (k - 1)) / free, {1 / (1 + WEIGHTS[1])!r}), {1 / (1 + WEIGHTS[0])!r}) - 1 else {WEIGHT} end
  from (select *, v * (tn - nn / tn - (k - 1)) as free from (select *, tx / tn * (1 - tx / tn) as v from (
    select count(*)::double as k, sum(n)::double as tn, sum(n::double * n) as nn, sum(bad)::double as tx, sum(bad::double * bad / n) as ss from {units} where n > 0))))"""


def oracle() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda pick: "case " + " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{pick(v, h, p)}'" for v, h, p in rules)
    return f"""
with own as (select page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') as host, coalesce(regexp_extract(url, '{URL}', 2), '') as path from pages),
counts as (select doc_id as page_id, count(*) as n_, sum(1 - quality) as bad_ from labels where quality is not null group by doc_id),
hosts as (select host, coalesce(sum(n_), 0) as n, coalesce(sum(bad_), 0) as bad, array_to_string(list_concat(['', ''], string_split(host, '.'))[-2:], '.') as domain, string_split(host, '.')[-1] as suffix
  from own left join counts using (page_id) group by host),
domains as (select domain, suffix, sum(n) as n, sum(bad) as bad from hosts group by domain, suffix),
suffixes as (select suffix, sum(n) as n, sum(bad) as bad from domains group by suffix),
wh as (select {weight_sql("hosts")} as w), wd as (select {weight_sql("domains")} as w), ws as (select {weight_sql("suffixes")} as w),
top as (select (sum(bad) + 1) / (sum(n) + 2)::double as m from suffixes),
s as (select suffix, (bad + (select w from ws) * (select m from top)) / (n + (select w from ws)) as up from suffixes),
d as (select domain, (bad + (select w from wd) * up) / (n + (select w from wd)) as up from domains join s using (suffix)),
h as (select host, bad + (select w from wh) * up as a, n - bad + (select w from wh) * (1 - up) as b from hosts join d using (domain)),
r as (select host, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bound from h)
select page_id, host, path, {case(lambda v, h, p: h + p)} end as rule, {case(lambda v, h, p: v)} when bound > {THRESHOLD} then 'block' else 'allow' end as verdict
from own join r using (host)"""
