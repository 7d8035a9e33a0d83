"""URL filtering: rules first, link-graph propagation for all other pages.

Native DataFrame operations only.  Rules of (host, path) judge the pages they fit; the
longest fitting rule wins.  Pages that no rule fits get the verdict of their host: trust
spreads by personalised PageRank from the hosts of allowed pages along host edges, distrust
spreads the same way from the hosts of blocked pages along reversed edges, and a host is
blocked where trust makes up less than ``THRESHOLD`` of both.  Host edges are the links in
the pages, and a host and its parent domain vouch for each other.

Scale: pages are reduced to counts per host and per edge before anything is shuffled, so a
host with a third of all pages sends one row a task.  Ranks are a table of hosts, joined to
edges each round and never collected; a hub's edges are split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailspark.llm.common import lower_ascii, settle, table

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING = 0.85
ROUNDS = 9
THRESHOLD = 0.5
_SETTLE = 3
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits (block wins among equal lengths)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _judged(pages: DataFrame, rules) -> DataFrame:
    named = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    return named.select("page_id", "html", "host", "path", rule.alias("rule"), verdict.alias("ruled"))


def host_edges(judged: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, and a host and its parent domain both ways."""
    targets = judged.filter("host <> ''").select("host", F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("to"))
    links = targets.select(F.col("host").alias("src"), lower_ascii(F.col("to")).alias("dst")).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = judged.select("host").distinct().union(links.select("dst")).filter("host <> ''")
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = hosts.select(F.explode(F.filter(F.arrays_zip(F.slice(chain, 1, F.size(chain) - 1).alias("a"), F.slice(chain, 2, F.size(chain)).alias("b")), lambda x: x["b"].isNotNull())).alias("p"))
    parents = pairs.select(F.col("p.a").alias("src"), F.col("p.b").alias("dst")).distinct()
    both = parents.union(parents.select("dst", "src")).withColumn("weight", F.lit(1.0))
    return links.union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` of personalised PageRank from seeds (host, trust, distrust).

    Seed weights are scaled to a sum of 1 each.  Rank that a host without edges would pass on is lost.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("out")).withColumnRenamed("src", "s")
    into = edges.groupBy("dst").agg(F.sum("weight").alias("into")).withColumnRenamed("dst", "d")
    shares = edges.join(out, edges["src"] == out["s"]).join(into, edges["dst"] == into["d"]).select("src", "dst", (F.col("weight") / F.col("out")).alias("t"), (F.col("weight") / F.col("into")).alias("r"))
    flow = settle(
        shares.select(F.col("src").alias("giver"), F.col("dst").alias("taker"), "t", F.lit(0.0).alias("d"))
        .union(shares.select(F.col("dst"), F.col("src"), F.lit(0.0), F.col("r")))
        .groupBy("giver", "taker").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
    )
    total = seeds.agg(F.sum("trust"), F.sum("distrust")).first()
    scale = [float(x) if x else 1.0 for x in total]
    start = settle(seeds.select("host", (F.col("trust") / scale[0]).alias("trust"), (F.col("distrust") / scale[1]).alias("distrust")))
    ranks = start
    for k in range(1, rounds + 1):
        given = flow.join(ranks, flow["giver"] == ranks["host"]).select(F.col("taker").alias("host"), (F.col("trust") * F.col("t") * damping).alias("trust"), (F.col("distrust") * F.col("d") * damping).alias("distrust"))
        fresh = start.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
        ranks = given.union(fresh).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if k % _SETTLE == 0 or k == rounds:
            ranks = settle(ranks)
    return ranks


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of the host, one row per page row.

    Null urls and urls without ``://`` have empty host and path, fit no rule and are allowed, as
    are hosts that neither trust nor distrust reaches.  Null html has no links.  Columns other
    than page_id, url and html are ignored; an empty table gives no rows.
    """
    judged = _judged(pages, rules)
    seeds = judged.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").cast("double").alias("trust"), F.count_if(F.col("ruled") == "block").cast("double").alias("distrust"))
    ranks = propagate(settle(host_edges(judged)), settle(seeds))
    known = ranks.select(F.col("host").alias("of_host"), "trust", "distrust")
    both = F.col("trust") + F.col("distrust")
    by_host = F.when((both > 0) & (F.col("trust") < threshold * both), "block").otherwise("allow")
    slim = _judged(pages.select("page_id", "url", F.lit(None).cast("string").alias("html")), rules).drop("html")
    return slim.join(known, F.col("host") == F.col("of_host"), "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), "trust", "distrust")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
