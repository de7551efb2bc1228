"""URL filtering by rules, and by trust and distrust spread over the links between hosts.

A url that a rule fits has that rule's verdict, the longest rule winning. For all others hosts are judged: links in the
pages give weighted edges between hosts; personalised PageRank spreads trust along them from the hosts whose pages
allow rules fit, and, along the reversed edges, distrust from the hosts whose pages block rules fit (who links to bad
hosts is suspect). Each host's distrust is held against its trust and against its share of all pages; where a multiple
of that share may be out of reach (a host with many pages, or block rules that fit most pages), odds are held instead.
Everything is DataFrame work: ranks meet edges in joins, and each step is cut by checkpoint().

Defined results: a null url, or one without `://`, has an empty host and path, which no rule fits and no link
reaches, and is allowed; pages may be null or empty; repeated rows each get a row; tables without pages give no
rows; other columns pass through, and output columns replace columns of their name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import shared_dir

#: Rules used where none are given: verdict, host, path. op6_url_filter gives those of its contract.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Blocked hosts that are broadcast at most; parts into which a host's pages are dealt beyond that.
FEW_HOSTS, SALTS = 20_000, 64
#: Ranks that differ by less than this part of themselves are equal.
SAME = 1e-6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"


def host(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ? or #."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def ruled(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits the columns host and path, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def spread(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float, most: int) -> DataFrame:
    """host, rank: personalised PageRank over edges (src, dst, n) from seeds (host, s), whose s sums to one.

    What reaches a host without edges goes back to the seeds. Ends when no host's rank changes by more than this part of
    itself, however many hosts there are, or after `most` steps, by when damping ** most is left.
    """
    total = edges.groupBy("src").agg(F.sum("n").alias("total"))
    flow = edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("w")).checkpoint()
    sources = flow.select(F.col("src").alias("host")).distinct().checkpoint()
    ranks = seeds.select("host", F.col("s").alias("rank")).checkpoint()
    for _ in range(most):
        moved = ranks.join(flow, F.col("host") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("in"))
        lost = ranks.join(sources, "host", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        new = seeds.select("host", ((1 - damping + damping * lost) * F.col("s")).alias("rank")).unionByName(moved.select(F.col("dst").alias("host"), (damping * F.col("in")).alias("rank")))
        new = new.groupBy("host").agg(F.sum("rank").alias("rank")).checkpoint()
        both = new.select("host", F.col("rank").alias("d")).unionByName(ranks.select("host", (-F.col("rank")).alias("d"))).groupBy("host").agg((F.abs(F.sum("d")) / F.max(F.abs("d"))).alias("d"))
        change = both.agg(F.coalesce(F.max("d"), F.lit(0.0))).first()[0]
        ranks = new
        if change < tolerance:
            break
    return ranks


def suspect(distrust: Column, trust: Column, share: Column, clean: Column, excess: float, many: Column) -> Column:
    """Whether a host is blocked, by parts of its ranks, so that it doesn't matter how many hosts they are shared among.

    share: its share of all pages; clean: of those that no block rule fits; many: whether block rules fit most pages.
    """
    plain = distrust >= excess * share * (1 - SAME)
    odds = ((excess * share > 0.5) | many) & (distrust * (1 - clean) >= excess * clean * (1 - distrust) * (1 - SAME))
    return (distrust > trust * (1 + SAME)) & (plain | odds)


def judge(df: DataFrame, url: str = "url", html: str = "html", rules: list[tuple[str, str, str]] = RULES, damping: float = 0.85, excess: float = 2.0, tolerance: float = 1e-6, most: int = 60) -> DataFrame:
    """df with host, path, rule and verdict (allow or block). A host is blocked if its distrust is above its trust and
    is at least `excess` times its share of all pages with a host. Where that is over a half, or block rules fit more than
    one in `excess` pages, it is also blocked if the odds of its distrust are at least `excess` times those of its share of
    the pages that no block rule fits."""
    shared_dir(df.sparkSession)
    rule, verdict = ruled(rules)
    made = {"host", "path", "rule", "verdict"}
    # own names while the output's names may still be the input's
    pages = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), F.pmod(F.xxhash64(F.col(url), F.col(html)), F.lit(SALTS)).alias("_salt")).withColumns({"rule": rule, "_ruled": verdict})
    source = df.select(F.col(url).alias("_url"), F.col(html).alias("_html")).select(host(F.col("_url")).alias("src"), F.explode(F.transform(F.regexp_extract_all("_html", F.lit(LINK), F.lit(1)), lambda x: F.when(x.startswith("//"), F.concat(F.lit("x:"), x)).otherwise(x))).alias("link"))
    edges = source.select("src", host(F.col("link")).alias("dst")).filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n")).checkpoint()
    hosts = pages.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("_ruled") == "allow").alias("good"), F.count_if(F.col("_ruled") == "block").alias("bad")).checkpoint()
    n, good, bad = (float(x or 0) for x in hosts.agg(F.sum("n"), F.sum("good"), F.sum("bad")).first())
    ways = {"trust": (edges, "good", good), "distrust": (edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), "bad", bad)}
    ranks = [spread(e, hosts.filter(F.col(c) > 0).select("host", (F.col(c) / total).alias("s")), damping, tolerance, most).withColumnRenamed("rank", name) for name, (e, c, total) in ways.items() if total]
    ranked = reduce(lambda a, b: a.join(b, "host", "left"), ranks, hosts)
    trust, distrust = (F.coalesce(F.col(x), F.lit(0.0)) if x in ranked.columns else F.lit(0.0) for x in ways)
    share = F.col("n") / (n or 1.0)
    clean = (F.col("n") - F.col("bad")) / ((n - bad) or 1.0)
    # the blocked hosts are counted: few are broadcast, many are dealt with salt, so that a host with many pages spreads over tasks
    blocked = ranked.filter(suspect(distrust, trust, share, clean, excess, F.lit(excess * bad > n))).select("host", F.lit(True).alias("_bad")).checkpoint()
    if blocked.count() <= FEW_HOSTS:
        met = pages.join(F.broadcast(blocked), "host", "left")
    else:
        salted = blocked.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = pages.join(salted, ["host", "_salt"], "left")
    out = met.withColumn("verdict", F.coalesce("_ruled", F.when(F.col("_bad"), "block"), F.lit("allow")))
    return out.select(*[c for c in df.columns if c not in made], "host", "path", "rule", "verdict")
