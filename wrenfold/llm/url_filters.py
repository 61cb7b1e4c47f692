"""URL filters: path rules, and trust and distrust spread over the links between hosts.

Rules judge a url by its host (or a parent domain) and the start of its path; of the rules that fit, the longest
wins. Urls that no rule fits get the verdict of their host. For it, two scores spread over the host graph:
personalised PageRank from the hosts whose urls rules allow, along links, and from the hosts whose urls rules
block, against links (who links to the blocked is distrusted). A seed counts by its share of the ruled urls of its
kind, so each kind has a mass of one, which hosts without links give back to its seeds; a host
whose share of distrust, distrust / (trust + distrust), exceeds the threshold is blocked.

Defined cases: a url that is null or has no `://` has empty host and path, which no rule fits, and is allowed; a
null html has no links; a host that neither score reaches is allowed; repeated rows each get their verdict, and
count as often as seeds; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenfold.llm.common import removed, written

#: (verdict, host, path)
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_SMALL = "".join(map(chr, range(ord("a"), ord("z") + 1)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _SMALL.upper(), _SMALL)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """A struct of the rule's text and verdict; both null where no rule fits."""
    longest_first = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, where, start in reversed(longest_first):
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(where + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct links between hosts, (src, dst, n): links of a page with a host lead from its own; `//` may lack a scheme."""
    links = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    pairs = pages.select(host_and_path(F.col(url_col))[0].alias("src"), F.explode(links).alias("to"))
    pairs = pairs.select("src", host_and_path(F.concat(F.when(F.startswith("to", F.lit("//")), ":").otherwise(""), "to"))[0].alias("dst"))
    return pairs.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


#: Rounds go on until no score changes between two writings by more than this share of it.
TOLERANCE = 1e-6


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 16, cut_every: int = 4, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank of several kinds at once: (kind, host, score), the scores of a kind summing to one.

    edges: (kind, src, dst, w), w summing to one over a src; seeds: (kind, host, seed), seed summing to one over a
    kind. A round keeps 1 - damping of the seeds and moves damping of every score along its host's edges. What lies
    at hosts without edges goes back to the seeds, by their shares: as they are what every round starts from, that
    is the same as making the scores of a kind sum to one in the end. After every `cut_every` rounds the scores are
    written, and from `rounds` on they are compared with those written before; the rounds end when no score has
    changed by more than the tolerance, as a share of the score; a host that is reached for the first time has changed
    by all of it. So far hosts, whose scores are small, are as exact as near ones, and no host that links lead to is missed.
    """
    kept = written(seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score")), "seed-shares")
    state = kept
    moves = edges.withColumnRenamed("src", "host")
    k, change = 0, 0.0 if moves.isEmpty() else None  # without links every round gives the same
    while change is None or change > tolerance:
        before = state
        for _ in range(cut_every):
            moved = state.join(moves, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("w") * damping).alias("score"))
            state = moved.unionByName(kept).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        state = written(state, "host-scores")
        k += cut_every
        if k >= rounds:
            both = state.unionByName(before.withColumn("score", -F.col("score"))).groupBy("kind", "host")
            change = both.agg(F.try_divide(F.abs(F.sum("score")), F.max("score")).alias("change")).agg(F.max("change")).first()[0] or 0.0
        if before is not kept:
            removed(before)
    totals = state.groupBy("kind").agg(F.sum("score").alias("total"))  # a row a kind
    return state.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("score") / F.col("total")).alias("score"))


def judge(
    pages: DataFrame,
    url_col: str = "url",
    html_col: str = "html",
    rules: tuple[tuple[str, str, str], ...] = RULES,
    threshold: float = 0.75,
    damping: float = 0.85,
    rounds: int = 16,
) -> DataFrame:
    """The input's columns but html, and host, path, rule, verdict, trust, distrust."""
    host, path = host_and_path(F.col(url_col))
    keep = [c for c in pages.columns if c not in (html_col, "host", "path", "rule", "verdict", "trust", "distrust", "by_rule")]
    judged = pages.select(*keep, host.alias("host"), path.alias("path")).withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules))

    edges = written(host_edges(pages, url_col, html_col), "host-edges")
    both = edges.withColumn("kind", F.lit("trust")).unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.lit("distrust").alias("kind"))
    )
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    both = written(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("w")), "host-moves")

    ruled = written(judged.where("by_rule is not null").groupBy(
        F.when(F.col("by_rule.verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host"
    ).agg(F.count(F.lit(1)).alias("n")), "host-seeds")
    totals = ruled.groupBy("kind").agg(F.sum("n").alias("total"))  # two rows
    seeds = ruled.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("seed"))

    scores = spread(both, seeds, damping, rounds).groupBy("host").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")]
    )
    blocked = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    by_host = F.when(F.coalesce(blocked, F.lit(False)), "block").otherwise("allow")
    return judged.join(scores, "host", "left").select(
        *keep,
        "host",
        "path",
        F.col("by_rule.rule").alias("rule"),
        F.coalesce(F.col("by_rule.verdict"), by_host).alias("verdict"),
        "trust",
        "distrust",
    )
