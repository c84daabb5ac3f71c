"""URL rules, and link-graph propagation for what no rule decides (native DataFrame operations).

A rule is (host, path, verdict). It fits a url whose host is the rule's or a subdomain and
whose path starts with the rule's; the longest rule (host and path together, then host) wins.
A few rules are held in the plan, a table of them is joined by the domains of each host.

Hosts get two scores over the graph of links between hosts: personalised PageRank from
trusted seeds along links, and from blocked seeds against them (who links to bad hosts is
suspect). A host's seed weight is the share of its pages that a rule allows or blocks. A host
is blocked when distrust is more than ``threshold`` of trust and distrust together; a host
that neither reaches is allowed. Rank of hosts without links is not dealt out again.

Edges are counted per pair of hosts before the shuffle, so pages of one large host become few
rows; every iteration is one join and one aggregation over host edges, and the ranks are
checkpointed, so neither lineage nor the driver holds them. Rounds go on until one moves less
than ``TOLERANCE`` of the seeds' weight. Links of one host are one partition of the join, which
adaptive execution splits.

Cases: a null url, or one without ``://``, has an empty host and path, no rule and no score,
and is allowed; null html has no links; repeated rows are judged each; an empty table gives
an empty result; columns other than id, url and html are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, sized_join

DAMPING, THRESHOLD = 0.85, 0.5
#: Rounds end when a round moves less than this part of the seeds' weight; the damping factor bounds their number (more is an error).
TOLERANCE, MAX_ROUNDS = 1e-4, 100
#: Rules held in the plan; more are joined.
RULES_IN_PLAN = 200
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)\bhref\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The winning rule as struct(rule, verdict), or null. ``rules`` is configuration, held in the plan."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """src, dst, n: links between different hosts, counted."""
    links = pages.select(F.col(host).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(_LINK), F.lit(1))).alias("url"))
    url = F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), "url")).otherwise(F.col("url"))
    return links.select("src", host_of(url).alias("dst")).filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def join_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (host, path, ...) with fit, as ``match_rule`` gives it, for any number of rules (host, path, verdict).

    Each different (host, path) meets the rules of its host and of the domains above it by an
    equi-join; the longest that fits is chosen, and rows take it from there.
    """
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    places = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    met = places.withColumn("rule_host", F.explode(domains)).join(rules, "rule_host").filter("startswith(path, rule_path)")
    name = F.concat("rule_host", "rule_path")
    order = F.struct(F.length(name), F.length("rule_host"), F.struct("rule_host", "rule_path", "verdict"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct(name.alias("rule"), "verdict"), order).alias("fit"))
    return sized_join(rows, materialise(best, "url-fits"), ["host", "path"], "left")


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Ranks (kind, host, rank) from seeds (kind, host, weight); 'trust' follows links, 'distrust' goes against them."""
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    both = materialise(both.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("total")).alias("share")), "url-edges")
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    seeds = materialise(seeds.join(F.broadcast(total), "kind").select("kind", "host", (F.lit(1 - damping) * F.col("weight") / F.col("total")).alias("rank")), "url-seeds")  # total: two rows
    ranks, before = seeds, None
    whole = lambda r: r.agg(F.sum("rank")).first()[0] or 0.0
    given = whole(seeds)
    for _ in range(MAX_ROUNDS):
        moved = ranks.join(both, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.lit(damping) * F.col("rank") * F.col("share")).alias("rank"))
        ranks = seeds.unionByName(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank")).checkpoint()
        before, now = given if before is None else now, whole(ranks)
        if now - before <= tolerance * given:  # ranks only grow
            return ranks
    raise RuntimeError(f"ranks did not settle in {MAX_ROUNDS} rounds")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row.

    ``rules``: (host, path, verdict) as a list, or a table of them; long ones are joined.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    if isinstance(rules, list) and len(rules) <= RULES_IN_PLAN:
        rows = rows.withColumn("fit", match_rule(F.col("host"), F.col("path"), rules))
    else:
        table = pages.sparkSession.createDataFrame(rules, "host string, path string, verdict string") if isinstance(rules, list) else rules
        rows = join_rules(rows, table)
    share = lambda v: F.sum(F.when(F.col("fit.verdict") == v, 1).otherwise(0)) / F.count("*")
    hosts = rows.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    seeds = hosts.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "weight")).filter("weight > 0")
    ranks = propagate(host_edges(rows), seeds.select("kind", "host", "weight"))
    scores = reduce(lambda d, k: d.withColumn(k, F.coalesce(k, F.lit(0.0))), ("trust", "distrust"), ranks.groupBy("host").pivot("kind", ["trust", "distrust"]).agg(F.sum("rank")))
    scores = materialise(scores, "url-scores")
    out = sized_join(rows, scores, ["host"], "left")
    zero = lambda k: F.coalesce(k, F.lit(0.0))
    bad = zero("distrust") > threshold * (zero("trust") + zero("distrust"))
    return out.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), F.when(bad, "block").otherwise("allow")).alias("verdict"), zero("trust").alias("trust"), zero("distrust").alias("distrust")
    )
