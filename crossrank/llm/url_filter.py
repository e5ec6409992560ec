"""URL filters: explicit host and path rules, then trust propagated over the link graph.

``parse`` splits a url; ``match_rules`` finds the longest fitting rule: every suffix of the host
is looked up among the rules by an equality join, so the number of rules does not multiply the
pages.  ``converge`` runs personalised PageRank over host edges: trust flows along the links from
hosts with pages that rules allow, distrust against them from hosts with pages that rules block.
A host under rules of both kinds is a seed on both sides, by the share of its pages (``seeds``).  Scores are
iterated until no host gains more than a tolerance.  ``judge`` gives each page its rule's verdict,
else its host's: blocked when distrust is more than ``share`` of what the host received, however little that is.

Edges are distinct host pairs with the number of links as weight, so a popular host is one row per
neighbour, and the mass a host receives is summed before it is shuffled.  Every round is written
to the shared folder.

Defined results: a null url or one without ``://`` has an empty host and path and fits no rule;
null html has no links; repeated rows are judged alike and their links count each; links to the own
host do not count; a host that nothing reaches is allowed; pages of any length are read whole; an
empty table gives no rows.  Only page_id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossrank.llm.common import lower_ascii
from crossrank.staging import stage

# The rules of the query (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
DAMPING = 0.85
# The largest gain of a host in the last round, far below the six places given out,
# and the rounds between two looks at it.
TOLERANCE = 1e-9
STEP = 4


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def parse(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, PARTS, 1)), F.regexp_extract(url, PARTS, 2)


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url) -> page_id, host, path, rule, verdict (null where no rule fits).

    The best rule of a page is found per distinct host and path, which hash evenly.
    """
    host, path = parse(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    hosts = rows.select("host").distinct().withColumn("suffix", F.explode(suffixes))
    # Staged with its size known: pages are shuffled by host only if there are very many hosts.
    fitting = stage(
        hosts.join(rules, F.col("suffix") == F.col("rule_host"))
        .groupBy(F.col("host").alias("h"))
        .agg(F.sort_array(F.collect_set(F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"),
            "rule_host", "rule_path", "rule_verdict")), asc=False).alias("rules")),
        "host_rules",
    )
    best = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), 0)
    return rows.join(fitting, F.col("host") == F.col("h"), "left").select(
        "page_id", "host", "path", best.alias("best")
    ).select(
        "page_id", "host", "path",
        F.concat("best.rule_host", "best.rule_path").alias("rule"),
        F.col("best.rule_verdict").alias("verdict"),
    )


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts."""
    host, _ = parse(F.col("url"))
    links = pages.select(host.alias("src"), F.explode(
        F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("to"))
    return (
        links.select("src", lower_ascii(F.col("to")).alias("dst"))
        .where((F.col("src") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst").agg(F.count("*").alias("n"))
    )


def seeds(matched: DataFrame) -> DataFrame:
    """Every host with ruled pages: trust by its share of allowed ones, distrust by that of blocked ones."""
    sides = matched.where(F.col("verdict").isNotNull()).groupBy("host").agg(
        F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked")
    )
    return sides.selectExpr(
        "host", "stack(2, 'trust', allowed / (allowed + blocked), 'distrust', blocked / (allowed + blocked)) AS (kind, seed)"
    ).where("seed > 0").select("kind", "host", "seed")


def link_shares(edges: DataFrame) -> DataFrame:
    """way, a, b, share: trust goes from a to b along links, distrust against them."""
    ways = edges.select(F.lit("trust").alias("way"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").unionByName(
        edges.select(F.lit("distrust").alias("way"), F.col("dst").alias("a"), F.col("src").alias("b"), "n")
    )
    sent = ways.groupBy("way", "a").agg(F.sum("n").alias("all")).withColumnsRenamed({"way": "w", "a": "from"})
    return stage(
        ways.join(sent, (F.col("way") == F.col("w")) & (F.col("a") == F.col("from"))).select(
            "way", "a", "b", (F.col("n") / F.col("all")).alias("share")
        ),
        "link_shares",
    )


def converge(edges: DataFrame, seed: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(kind, host, seed) -> (kind, host, score).

    score = (1 - damping) * seed + damping * the shares of the neighbours' scores, at its fixed
    point.  Trust follows links, distrust goes back along them.  ``gain`` is what the last round added to a host.  The sum of gains falls by ``damping`` a round
    at least, so the rounds end; ``STEP`` of them are written at once.
    """
    shares = link_shares(edges)
    base = seed.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    scores = stage(base.withColumn("gain", F.col("score")), "trust_seeds")
    start = scores.withColumn("gain", F.lit(0.0))
    linked = not shares.isEmpty()
    while linked and not scores.where(F.col("gain") > tolerance).isEmpty():
        for _ in range(STEP):
            moved = scores.join(
                shares, (F.col("kind") == F.col("way")) & (F.col("host") == F.col("a"))
            ).select("kind", F.col("b").alias("host"), *[(F.col(c) * F.col("share") * damping).alias(c) for c in ("score", "gain")])
            scores = start.unionByName(moved).groupBy("kind", "host").agg(
                F.sum("score").alias("score"), F.sum("gain").alias("gain")
            )
        scores = stage(scores, "trust_scores")
    return scores.select("kind", "host", "score")


def judge(pages: DataFrame, rules: DataFrame, share: float = 0.5, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust."""
    matched = stage(match_rules(pages, rules), "url_rules")
    scores = converge(host_edges(pages), seeds(matched), tolerance)
    per_host = stage(scores.groupBy(F.col("host").alias("h")).agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"),
    ), "host_trust")
    trust = F.coalesce("trust", F.lit(0.0))
    distrust = F.coalesce("distrust", F.lit(0.0))
    blocked = distrust > share * (trust + distrust)
    return matched.join(per_host, F.col("host") == F.col("h"), "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.round(trust, 6).alias("trust"), F.round(distrust, 6).alias("distrust"),
    )
