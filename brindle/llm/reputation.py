"""Empirical-Bayes host reputation: beta-binomial shrinkage from host to registered domain to suffix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, join_skewed, plain, written

HOST_PATTERN = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
ADDRESS_PATTERN = r"^([0-9]+([.][0-9]+){3}|\[.*)$"
#: The number in a page's path that names a document: the whole run of digits, with no letter after it.
DOC_PATTERN = r"://[^/]+/[a-z]+/([0-9]+)(?:[^0-9A-Za-z_]|$)"

_SECOND_LEVEL = {
    "uk": "co org ac gov ltd plc me net sch nhs police", "au": "com net org edu gov asn id", "jp": "co ne or ac ad go gr lg ed", "nz": "co net org ac govt geek gen school",
    "br": "com net org gov edu", "cn": "com net org gov edu ac", "in": "co net org gen firm ind ac edu gov res", "kr": "co ne or re pe go ac", "mx": "com org gob edu net",
    "tr": "com org net gov edu", "za": "co org net gov ac web", "ar": "com gob org net edu int", "sg": "com net org edu gov", "hk": "com net org edu gov", "tw": "com net org edu gov",
    "my": "com net org edu gov", "ph": "com net org edu gov", "id": "co or ac go web sch net", "il": "co org ac gov net", "th": "co or ac go in net", "pl": "com net org edu gov",
    "ua": "com net org gov edu", "vn": "com net org edu gov", "ng": "com net org edu gov", "ke": "co or ac go ne", "eg": "com net org edu gov", "sa": "com net org edu gov",
    "pe": "com net org edu gob", "co": "com net org edu gov", "ve": "com net org edu gob", "ec": "com net org edu gob", "uy": "com net org edu gub", "gr": "com net org edu gov",
    "pt": "com org edu gov", "es": "com org nom gob edu", "it": "gov edu", "fr": "com gouv", "at": "co or ac gv", "hu": "co org", "ae": "co net org ac gov", "pk": "com net org edu gov",
}
_HOSTED = "github.io gitlab.io blogspot.com herokuapp.com netlify.app vercel.app pages.dev workers.dev web.app firebaseapp.com azurewebsites.net cloudfront.net wordpress.com".split()
#: Public suffix rules in the notation of the public list (*.x any label before x, !y.x an exception to that). A common part of
#: it only; ``suffix_rules`` reads the whole list from a file.
SUFFIX_RULES = (*(f"{s}.{c}" for c, names in _SECOND_LEVEL.items() for s in names.split()), *_HOSTED, "*.ck", "!www.ck", "*.bd", "*.np", "*.kh")
_MOST_RULES = 100_000


def suffix_rules(spark: SparkSession, path: str) -> list[str]:
    """The rules of a public suffix list: a rule a line, ``//`` comments. A list of more than 100,000 is refused."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+")[0].alias("r")).where("r <> '' and not startswith(r, '//')").limit(_MOST_RULES + 1).collect()
    if len(rows) > _MOST_RULES:
        raise ValueError(f"more than {_MOST_RULES} rules")
    return [r["r"].lower() for r in rows]


def host_of(url: Column) -> Column:
    """The host of a URL, lower-case, without dots at its end; "" where there is none."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, HOST_PATTERN, 1), F.lit(""))), r"[.]+$", "")


def with_domains(hosts: DataFrame, rules: Sequence[str] = SUFFIX_RULES) -> DataFrame:
    """``hosts`` (host, ...), a row a host, with suffix and domain: the longest rule that fits, exceptions first, else the last
    label; and one label more. An address, and a host with no more labels than its suffix, is its own domain."""
    if len(rules) > _MOST_RULES:
        raise ValueError(f"more than {_MOST_RULES} rules")
    table = [(r[2:], 1, 0) if r.startswith("*.") else (r[1:], -1, 1000) if r.startswith("!") else (r, 0, 0) for r in rules]
    known = F.broadcast(hosts.sparkSession.createDataFrame(table, "tail string, more int, first int"))  # checked above
    labels = hosts.where(~F.col("host").rlike(ADDRESS_PATTERN)).select("host", F.split("host", "[.]", -1).alias("l")).select("host", F.size("l").alias("size"), F.explode(F.sequence(F.lit(1), F.size("l"))).alias("k"))
    fits = labels.withColumn("tail", F.expr("substring_index(host, '.', -k)")).join(known, "tail").withColumn("k", F.col("k") + F.col("more")).where("k >= 1 and k <= size")
    best = fits.groupBy("host").agg(F.pmod(F.max(F.col("k") + F.col("first")), F.lit(1000)).alias("k"))
    out = hosts.join(best, "host", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    address = F.col("host").rlike(ADDRESS_PATTERN)
    out = out.withColumn("suffix", F.when(address, F.col("host")).otherwise(F.expr("substring_index(host, '.', -k)")))
    domain = F.expr("substring_index(host, '.', -(k + 1))")
    return out.withColumn("domain", F.when(address | domain.startswith("."), F.col("host")).otherwise(domain)).drop("k")


def _strength(groups: DataFrame) -> DataFrame:
    """One row: the prior's strength s by the method of moments over (n, bad, mu), s = (1 - rho) / rho with the overdispersion
    rho kept within [0.001, 0.99]. Where no group has two outcomes nothing is known of it, and it is 0.5."""
    free = F.col("mu") * (1 - F.col("mu"))
    over = F.sum((F.col("bad") - F.col("n") * F.col("mu")) ** 2 - F.col("n") * free) / F.nullif(F.sum(F.col("n") * (F.col("n") - 1) * free), F.lit(0.0))
    rho = F.greatest(F.lit(0.001), F.least(F.lit(0.99), F.coalesce(over, F.lit(0.5))))
    return groups.agg(rho.alias("rho")).select(((1 - F.col("rho")) / F.col("rho")).alias("s"))


def _posterior(groups: DataFrame) -> DataFrame:
    """``groups`` (n, bad, and mu and v, the mean and variance of what they are shrunk to) with their own mean and variance: that of
    the beta posterior, and what the parent's variance leaves of itself."""
    g = groups.crossJoin(F.broadcast(_strength(groups)))  # one row
    total = F.col("n") + F.col("s")
    mean, pull = (F.col("bad") + F.col("s") * F.col("mu")) / total, F.col("s") / total
    return g.withColumns({"mean": mean, "var": mean * (1 - mean) / (total + 1) + pull * pull * F.col("v")}).drop("s", "mu", "v")


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645, rules: Sequence[str] = SUFFIX_RULES, scratch: Scratch | None = None) -> DataFrame:
    """(host, domain, suffix, pages, n, bad, mean, lower, upper, overall) of every host of ``pages`` (url), from ``outcomes``
    (url, bad 0/1).

    The posterior of the rate of bad pages of all outcomes, from a uniform prior, is what suffixes are shrunk to, a suffix's
    posterior what its domains are, a domain's what its hosts are; each level's prior strength is fitted by moments over all
    its groups. A parent's variance is carried on, in the share of the parent's pull. ``lower`` and ``upper`` are ``z`` posterior
    standard deviations from the posterior mean, within [0, 1]. Hosts without outcomes have their domain's mean and the width of
    its prior. Null outcomes don't count; without any outcome every mean is 0.5. ``overall`` is the mean of all. The result reads
    tables of ``scratch``."""
    scratch = scratch or Scratch(pages.sparkSession)
    hosts = with_domains(pages.select(host_of(F.col("url")).alias("host")).groupBy("host").agg(F.count("*").alias("pages")), rules)
    seen = outcomes.where("bad is not null").select(host_of(F.col("url")).alias("host"), F.col("bad").cast("double").alias("bad")).groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").alias("bad"))
    h = scratch.written(hosts.join(seen, "host", "left").fillna(0.0, ["n", "bad"]), "hosts")
    total = lambda df, count, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias(count))
    d = total(h, "hosts", "domain", "suffix")
    x = total(d, "domains", "suffix")
    top = x.agg(((F.coalesce(F.sum("bad"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).alias("mu"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"))
    top = top.select("mu", (F.col("mu") * (1 - F.col("mu")) / (F.col("n") + 3)).alias("v"))
    up = lambda df, key, count: df.select(key, F.col("mean").alias("mu"), F.col("var").alias("v"), count)
    x = scratch.written(_posterior(x.crossJoin(F.broadcast(top))), "suffixes")
    d = scratch.written(_posterior(join_skewed(d, up(x, "suffix", "domains"), ["suffix"], "domains")), "domains")
    h = _posterior(join_skewed(h, up(d, "domain", "hosts"), ["domain"], "hosts"))
    sd = F.sqrt("var")
    h = h.select("host", "domain", "suffix", "pages", F.col("n").cast("bigint").alias("n"), F.col("bad").cast("bigint").alias("bad"), "mean", F.greatest(F.lit(0.0), F.col("mean") - z * sd).alias("lower"), F.least(F.lit(1.0), F.col("mean") + z * sd).alias("upper"))
    return h.crossJoin(F.broadcast(top.select(F.col("mu").alias("overall"))))


def filtered_pages(pages: DataFrame, outcomes: DataFrame, highest: float = 0.5, z: float = 1.645, rules: Sequence[str] = SUFFIX_RULES) -> DataFrame:
    """(page_id, host, domain, suffix, n, bad, mean, lower, kept) of every page. A page goes only where even the lower bound of
    its host's rate of bad pages exceeds both ``highest`` and the overall rate: doubt keeps it, and so does being no worse than
    all pages are. A null or malformed URL has the host "", which is one host like any other. Repeated rows give repeated rows;
    null ids are carried; extra columns are ignored; an empty table of pages gives no rows, an empty table of outcomes keeps all."""
    pages = plain(pages, "page_id", "url")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"))
    with Scratch(pages.sparkSession) as scratch:
        rep = host_reputation(pages, outcomes, z, rules, scratch).withColumn("kept", F.col("lower") <= F.greatest(F.lit(float(highest)), "overall"))
        rep = written(rep, "reputation")
    found = join_skewed(rows, rep, ["host"], "pages")
    return found.select("page_id", "host", "domain", "suffix", "n", "bad", F.round("mean", 6).alias("mean"), F.round("lower", 6).alias("lower"), "kept")


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): a page whose path names a labelled document is bad if that document is of low quality or toxic. A number that
    is no BIGINT names none. Pages with a null URL have no outcome; of several labels of a document the worst counts, labels
    with neither column set don't."""
    doc = F.regexp_extract("url", DOC_PATTERN, 1).try_cast("bigint")
    pages, labels = plain(pages, "url"), plain(labels, "doc_id", "quality", "toxic")
    lab = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0).alias("bad")).where("bad is not null")
    lab = lab.groupBy("doc_id").agg(F.max("bad").alias("bad"))
    return pages.select(F.col("url"), doc.alias("doc_id")).join(lab, "doc_id").select("url", "bad")
