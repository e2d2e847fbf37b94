"""URL filters: rules by host and path, and trust spread over the graph of hosts.

Rules judge the urls that they fit, the longest first. For the rest, personalised PageRanks run over
host edges in Spark: trust follows links from the hosts that rules allow, distrust runs against them
from the hosts that rules block. A third rank starts from all hosts alike and runs as distrust does: what
a host's place in the graph gives it by itself. A host is blocked if its distrust is more than `margin`
times its trust and at least `FLOOR` of that, so that a trickle from far away blocks nobody, while all
that hangs on a blocked host alone is blocked with it, however much that is. Host edges are the links
of pages to other hosts and, at a lower weight, the tie between a host and the domain above it, in both
directions: who runs a domain runs its subdomains. A host is a seed by the share of its urls that rules
speak of, and what a block of some paths leaves alone counts for it. Pages are read once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkintel.llm.rows import join_skewed
from sparkintel.llm.staging import Staged

#: (verdict, host, path): fixed values.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING, STEPS, TOLERANCE = 0.85, 30, 1e-4
DOMAIN_WEIGHT = 0.5
MARGIN, FLOOR = 2.0, 0.1
#: Steps between written ranks.
STRIDE = 3
_UPPER, _UNDER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UNDER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null; of equals the first."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)) for _, h, p in ordered]

    def first(values: list[str]) -> Column:
        return reduce(lambda chain, x: chain.when(x[0], F.lit(x[1])), zip(fits, values, strict=True), F.when(F.lit(False), F.lit("")))

    return first([h + p for _, h, p in ordered]), first([v for v, _, _ in ordered])


_LINK = r"(?is)\b(?:href|src|action)\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"


def link_targets(html: Column) -> Column:
    """Hosts that a page's links name, as often as they do."""
    absolute = lambda to: F.when(F.startswith(to, F.lit("//")), F.concat(F.lit("http:"), to)).otherwise(to)
    return F.transform(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1)), lambda to: url_host(absolute(to)))


def host_edges(pages: DataFrame, staged: Staged, domain_weight: float = DOMAIN_WEIGHT) -> DataFrame:
    """src, dst, weight: links of pages (host, targets) to other hosts, and ties to parent domains.

    Links are summed for each pair before they are shuffled, and written once.
    """
    links = pages.select(F.col("host").alias("src"), F.explode("targets").alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    linked = staged.write(links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    hosts = pages.select("host").union(linked.select("dst")).where("host <> ''").distinct()
    parts = F.split("host", r"\.")
    chain = hosts.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))).alias("low")).distinct()
    ties = staged.write(chain.select("low", F.regexp_replace("low", r"^[^.]*\.", "").alias("high")).where("low <> high AND high LIKE '%.%'"))
    both = ties.select(F.col("low").alias("src"), F.col("high").alias("dst")).union(ties.select("high", "low")).withColumn("weight", F.lit(domain_weight))
    return linked.union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def personal_ranks(edges: DataFrame, seeds: DataFrame, staged: Staged, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """kind, host, rank: for each kind, PageRank that restarts at its seeds (kind, host, share of 1).

    edges: kind, src, dst, weight. Rank that reaches a host without edges returns to the seeds, which
    only scales the whole: so it is let go, and ranks are scaled to 1 at the end. Contributions are
    summed for each target before they are shuffled, so that a host of very many links is no single task.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("all"))
    shares = staged.write(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (damping * F.col("weight") / F.col("all")).alias("part")))
    restart = seeds.select("kind", "host", ((1 - damping) * F.col("share")).alias("rank"))
    ranks = was = restart
    for step in range(1, steps + 1):
        moved = shares.join(ranks, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("part")).alias("rank"))
        ranks = moved.union(restart).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if step % STRIDE == 0 or step == steps:
            ranks = staged.write(ranks)
            change = ranks.join(was.withColumnRenamed("rank", "was"), ["kind", "host"], "left").groupBy("kind").agg(F.sum(F.abs(F.col("rank") - F.coalesce("was", F.lit(0.0)))).alias("c")).agg(F.max("c")).first()[0]
            if (change or 0.0) < TOLERANCE:
                break
            was = ranks
    whole = ranks.groupBy("kind").agg(F.sum("rank").alias("whole"))
    return ranks.join(whole, "kind").select("kind", "host", (F.col("rank") / F.col("whole")).alias("rank"))


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: list[tuple[str, str, str]] = RULES, margin: float = MARGIN, floor: float = FLOOR
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, trust, distrust.

    A url that is null or has no `://` has an empty host and path, no rule and no trust; it is allowed,
    as are hosts that neither rank reaches. Null html has no links. Repeated rows are judged alike and
    count as links of their own. An empty table gives an empty result.
    """
    staged = Staged(pages.sparkSession, "url-filters")
    base = pages.select(pages[id_col].alias("id"), url_host(pages[url_col]).alias("host"), url_path(pages[url_col]).alias("path"), link_targets(pages[html_col]).alias("targets"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = staged.write(base.select("id", "host", "path", rule.alias("rule"), verdict.alias("told"), "targets"))
    edges = staged.write(host_edges(judged.select("host", "targets"), staged))
    of_host = judged.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("urls"), F.count_if(F.col("told") == "allow").alias("allowed"), F.count_if(F.col("told") == "block").alias("blocked"))
    told = staged.write(of_host.where("allowed + blocked > 0"))

    # A host is a seed as far as rules speak of its urls: what a block of one path leaves alone speaks for it.
    good = F.when(F.col("blocked") > 0, F.col("urls") - F.col("blocked")).otherwise(F.col("allowed"))
    vote = lambda kind, n: F.struct(F.lit(kind).alias("kind"), (n * n / F.col("urls")).alias("n"))
    votes = told.select(F.explode(F.array(vote("trust", good), vote("distrust", F.col("blocked")))).alias("vote"), "host")
    votes = votes.select("vote.kind", "host", "vote.n").where("n > 0")
    everywhere = edges.select(F.col("src").alias("host")).union(edges.select("dst")).union(told.select("host")).distinct().select(F.lit("place").alias("kind"), "host", F.lit(1.0).alias("n"))
    votes = votes.union(everywhere)
    whole = votes.groupBy("kind").agg(F.sum("n").alias("whole"))  # three rows
    seeds = staged.write(votes.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("n") / F.col("whole")).alias("share")))
    against = edges.select(F.explode(F.array(F.lit("distrust"), F.lit("place"))).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    ranks = personal_ranks(edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(against), seeds, staged)
    scores = staged.write(ranks.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust", "place")]))
    found = join_skewed(judged.drop("targets"), scores, "host")
    bad = F.coalesce((F.col("distrust") > margin * F.col("trust")) & (F.col("distrust") >= floor * F.col("place")), F.lit(False))
    return found.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("told", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )
