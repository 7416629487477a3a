"""URL filters: host and path rules, and link-graph propagation for what no rule decides.

A rule ``host/path`` fits its host and all its subdomains if the url's path
starts with the rule's; of several that fit the longest wins. Hosts that an
allow rule covers are trusted seeds, hosts that a block rule covers whole are
blocked seeds. Over the edges between hosts that the pages' links make,
personalised PageRank carries trust forward from the trusted seeds, and the
same on reversed edges carries distrust from blocked hosts back to those that
link to them. A host is blocked if its distrust is more than ``RATIO`` times
its trust; hosts that neither reaches are allowed.

Links are counted by host pair before anything is joined, so a host with a
third of all pages is a few rows. Each hop writes the mass that is still on its
way to the shared folder, until less than ``TOLERANCE`` of it is left; so the
scores are those of the fixpoint, however long the chains are. Mass at a host
without a way on returns to the seeds. That scales all scores of a kind alike
(x = (I - dA)^-1 v up to a factor), so it is done at the end, by dividing by
their sum.

A url that is null or has no ``://`` has an empty host and path, fits no rule
and is allowed; rows that repeat a ``page_id`` each keep their row; null or
empty html has no links, nor has a comment; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import salted_join
from corvida.session import Stage

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING, RATIO = 0.85, 1.0
#: Mass on its way at which propagation ends, and the relative difference below which two scores are equal.
TOLERANCE, ROUNDING = 1e-9, 1e-9
#: Hops between two looks at the mass that is left.
_HOPS = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A link's address; quotes are optional.
HREF = "(?i)href *= *[\"']?([^\"' >]+)"
COMMENT = "(?s)<!--.*?-->"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _covers(rule: str, host: Column) -> Column:
    name = rule.partition("/")[0]
    return (host == name) | host.endswith(f".{name}")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    # later conditions are tried first
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        out = F.when(_covers(rule, host) & path.startswith("/" + rule.partition("/")[2]), rule).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between different hosts; an address without a host stays on its page's."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.regexp_replace("html", COMMENT, ""), F.lit(HREF), F.lit(1))).alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    links = links.where(F.col("to").contains("//")).select("src", host_of(to).alias("dst"))
    return links.where("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_scores(edges: DataFrame, hosts: DataFrame, rules=RULES, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, trust, distrust`` of the hosts that either reaches; each sums to 1 if it has seeds."""
    stage = Stage(edges.sparkSession, "urlfilter")
    edges = stage.write(edges)
    any_of = lambda wanted: reduce(lambda a, b: a | b, [_covers(r, F.col("host")) for r in wanted], F.lit(False))
    seeded = [any_of([r for r, v in rules if v == "allow"]), any_of([r for r, v in rules if v == "block" and r.partition("/")[2] == ""])]
    nodes = hosts.select("host").union(edges.select("dst")).distinct()
    nodes = stage.write(nodes.select("host", F.explode(F.filter(F.array(*(F.when(s, F.lit(k)) for k, s in enumerate(seeded))), lambda k: k.isNotNull())).alias("kind")))
    share = F.broadcast(nodes.groupBy("kind").agg((1 / F.count("*")).alias("mass")))  # two rows at most
    front = stage.write(nodes.join(share, "kind").select("kind", "host", "mass"))
    outs, ins = edges.groupBy("src").agg(F.sum("n").alias("all")), edges.groupBy("dst").agg(F.sum("n").alias("all"))
    part = (damping * F.col("n") / F.col("all")).alias("share")
    ahead = edges.join(outs, "src").select(F.lit(0).alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), part)
    back = edges.join(ins, "dst").select(F.lit(1).alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), part)
    moves = stage.write(ahead.unionAll(back))
    seen = [front]
    added = lambda: reduce(DataFrame.unionAll, seen).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
    while (front.agg(F.sum("mass")).first()[0] or 0.0) > tolerance:
        for _ in range(_HOPS):
            front = stage.write(front.join(moves, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("mass") * F.col("share")).alias("mass")))
            seen.append(front)
        if len(seen) > 2 * _HOPS:
            total = stage.write(added())
            stage.drop(*seen[:-1])
            seen = [total]
    total = added()
    sums = F.broadcast(total.groupBy("kind").agg(F.sum("mass").alias("all")))  # two rows at most
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass") / F.col("all"))), F.lit(0.0))
    return total.join(sums, "kind").groupBy("host").agg(of(0).alias("trust"), of(1).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, ratio: float = RATIO) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``."""
    verdicts = F.create_map(*(F.lit(x) for rule in rules for x in rule))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scores = host_scores(host_edges(pages), rows.select("host").distinct(), rules)
    bad = scores.where(F.col("distrust") > ratio * (1 + ROUNDING) * F.col("trust")).select("host").withColumn("bad", F.lit(True))
    # a host may hold a third of all pages
    rows = salted_join(rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)), bad, "host", "page_id")
    own = F.when(F.col("bad"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.element_at(verdicts, F.col("rule"))).otherwise(own).alias("verdict"))
