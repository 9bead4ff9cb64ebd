"""Operator 4 [native]: url rules, then trust and distrust spread over the links between hosts.

Pages that a rule allows are trusted seeds of their hosts, pages that a rule blocks are blocked seeds. Personalised PageRank runs from
the trusted seeds along the links, and from the blocked seeds against them (who links to a blocked host shares the distrust). A host
whose distrust is more than ``THRESHOLD`` of both is blocked where no rule decides; a host that neither reaches is allowed.

Links are counted once per pair of hosts before anything is joined, so a hub has one row for each partner, and sums combine before
the shuffle. After each ``STEPS_A_TABLE`` iterations the ranks are written, which cuts the lineage.

A host whose distrust is just ``THRESHOLD`` of both is allowed. An empty table gives no rows; without seeds, or links, nothing spreads.
Null urls and urls without ``://`` have an empty host and path; rules never fit an empty host, and it takes no part in the
graph. Null html has no links. Repeated rows each give a row and a seed. Only the columns asked for are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import ascii_lower, written

#: The rules, as host and path: verdict.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
DAMPING, ITERATIONS, STEPS_A_TABLE, THRESHOLD = 0.85, 20, 5, 0.5
LINK = r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url.cast("string"), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url.cast("string"), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """src, dst, w: links between different hosts; w is the share of the source's links. pages: host and html."""
    links = pages.filter("host != ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("url"))
    absolute = F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), F.col("url"))).otherwise(F.col("url"))
    pairs = links.select("src", host_of(absolute).alias("dst")).filter("dst != '' and dst != src").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return pairs


def propagate(edges: DataFrame, seeds: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """host, rank: personalised PageRank. edges: src, dst, n; seeds: host, weight. Mass at hosts without links is lost, which keeps ranks below the seeds' mass and spares a global sum each time."""
    total = seeds.agg(F.sum("weight")).first()[0]
    start = seeds.filter("weight > 0").select("host", (F.col("weight") / F.lit(float(total or 1))).alias("rank"))
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    flow = written(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("w")), "links")
    if flow.isEmpty():
        return start.withColumn("rank", F.col("rank") * (1 - damping))
    rank = start
    for step in range(1, iterations + 1):
        moved = flow.join(rank, F.col("src") == F.col("host")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("w") * damping).alias("rank")).withColumnRenamed("dst", "host")
        rank = moved.unionByName(start.withColumn("rank", F.col("rank") * (1 - damping))).groupBy("host").agg(F.sum("rank").alias("rank"))
        if step % STEPS_A_TABLE == 0:
            rank = written(rank, "ranks")
    return rank


def host_scores(edges: DataFrame, trusted: DataFrame, blocked: DataFrame) -> DataFrame:
    """host, trust, distrust."""
    trust = propagate(edges, trusted).withColumnRenamed("rank", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(back, blocked).withColumnRenamed("rank", "distrust")
    return trust.join(distrust, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, *, rules: dict[str, str] = RULES, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The columns in keep, host, path, rule, verdict, and the host's trust and distrust (0 where none)."""
    own = pages.select(F.struct(*keep).alias("own"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).cast("string").alias("html"))
    verdict = F.lit(None).cast("string")
    for rule, v in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(v)).otherwise(verdict)
    parsed = own.drop("html").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("ruled", verdict)
    seeds = written(parsed.filter("ruled is not null").groupBy("host", "ruled").agg(F.count("*").alias("weight")), "seeds")
    edges = written(host_edges(own.select("host", "html")), "edges")
    scores = written(host_scores(edges, seeds.filter("ruled = 'allow'"), seeds.filter("ruled = 'block'")), "scores")
    joined = parsed.join(scores, "host", "left")
    bad = F.coalesce(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), F.lit(False))
    return joined.select("own.*", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
