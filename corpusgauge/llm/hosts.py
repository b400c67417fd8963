"""URL verdicts from rules and from trust that flows along host links.

Hosts are the nodes of a graph; a link from a page of one host to another is an
edge. Hosts that the rules allow are trusted seeds, and trust flows along the
links (personalised PageRank). Hosts that the rules block are blocked seeds, and
distrust flows against the links: who links to a blocked host is suspect. A
third run from all hosts, in both directions, gives each host's mass without
any seed. Trust and distrust are a host's seeded masses in terms of its own; a
host is blocked where distrust outweighs trust by a threshold of their sum, and
is near to or above what an average host would get.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.session import settle

#: (host, path, verdict): fits the host and its subdomains where the path starts so.
Rule = tuple[str, str, str]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ranks are integers in parts of this, so that sums don't depend on their order.
UNIT = 10**15


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lowered; path: then up to ``?``, ``#`` or the end. Both are empty for a null
    and without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def page_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """Host edges ``src, dst, weight``: absolute links in the pages, counted,
    and a host's tie to each domain above it in both directions, as a domain and
    its subdomains are under one hand."""
    links = pages.filter(F.col(host) != "").select(F.col(host).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?([a-z][a-z0-9+.-]*://[^"'\s>]*)"""), 1)).alias("url"))
    linked = links.select("src", host_and_path(F.col("url"))[0].alias("dst")).filter("dst != '' and src != dst")
    hosts = pages.filter(F.col(host) != "").select(F.col(host).alias("src")).distinct()
    up = hosts.withColumn("part", F.split("src", r"\.")).filter(F.size("part") > 2)
    up = up.select("src", F.explode(F.transform(F.sequence(F.lit(2), F.size("part") - 1), lambda i: F.concat_ws(".", F.slice("part", i, F.size("part"))))).alias("dst"))
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return linked.unionByName(up).unionByName(down).groupBy("src", "dst").agg(F.count("*").alias("weight"))


def flow(edges: DataFrame, start: DataFrame, mass: list[str], damping_percent: int = 85, residual: float = 5e-3, max_rounds: int = 60) -> DataFrame:
    """Personalised PageRank of several masses at once, along ``edges``.

    ``start``: host and one starting mass each, in integer parts of ``UNIT``.
    Rounds go on until a step moves less than ``residual`` of a mass. The mass of
    a host without outgoing edges is lost; scaling the result to 1 is the same as
    giving it back to the start.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("_all"))
    shares = settle(edges.join(out, "src"))
    rank, before = start, start
    for k in range(max_rounds):
        moved = rank.join(shares, rank["host"] == shares["src"]).select(
            F.col("dst").alias("host"), *[F.floor(F.col(m) * (damping_percent / 100) * (F.col("weight") / F.col("_all"))).cast("long").alias(m) for m in mass])
        based = start.select("host", *[F.floor(F.col(m) * ((100 - damping_percent) / 100)).cast("long").alias(m) for m in mass])
        rank = moved.unionByName(based).groupBy("host").agg(*[F.sum(m).alias(m) for m in mass])
        if k % 4 == 2:
            rank = before = settle(rank)
        elif k % 4 == 3:
            rank = settle(rank)
            old = before.select(F.col("host").alias("_host"), *[F.col(m).alias(f"_{m}") for m in mass])
            both = rank.join(old, F.col("host") == F.col("_host"), "full").fillna(0, [*mass, *[f"_{m}" for m in mass]])
            moves = both.agg(*[F.sum(F.abs(F.col(m) - F.col(f"_{m}"))).alias(m) for m in mass]).first()
            if all((moves[m] or 0) <= residual * UNIT for m in mass):
                break
    return rank


def host_verdicts(hosts: DataFrame, edges: DataFrame, threshold: float = 0.2, least: float = 0.85) -> DataFrame:
    """``host, trust, distrust, verdict`` for all hosts.

    ``hosts``: host, n_allowed, n_blocked, n_pages. ``trust`` is a host's share
    of the trust in terms of its share of the unseeded mass, 1 for a host that
    the seeds favour as much as any other; ``distrust`` likewise, against the
    links. A host is blocked where their difference is above ``threshold`` of
    their sum and its distrust above ``least``. A host that no seed reaches is
    allowed.
    """
    ends = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    nodes = ends.join(hosts, "host", "full_outer").fillna(0)
    totals = nodes.agg(*[F.greatest(F.sum(c), F.lit(1)).alias(f"_{c}") for c in ("n_allowed", "n_blocked", "n_pages")])
    row = totals.collect()[0]
    part = lambda c: F.floor(F.col(c) / row[f"_{c}"] * UNIT).cast("long")
    # both directions in one run: hosts marked > along the links, < against them
    mark = lambda way, c: F.concat(F.lit(way), F.col(c))
    start = settle(nodes.select(mark(">", "host").alias("host"), part("n_allowed").alias("seeded"), part("n_pages").alias("any"))
                   .unionByName(nodes.select(mark("<", "host").alias("host"), part("n_blocked").alias("seeded"), part("n_pages").alias("any"))))
    ways = edges.select(mark(">", "src").alias("src"), mark(">", "dst").alias("dst"), "weight").unionByName(edges.select(mark("<", "dst").alias("src"), mark("<", "src").alias("dst"), "weight"))
    rank = settle(flow(ways, start, ["seeded", "any"])).withColumns({"_way": F.substring("host", 1, 1), "_host": F.substring("host", 2, 2**31 - 1)})
    sums = {r["_way"]: r for r in rank.groupBy("_way").agg(F.sum("seeded").alias("seeded"), F.sum("any").alias("any")).collect()}  # two rows

    def shares(way: str, seeded: str, own: str) -> DataFrame:
        of = lambda m: F.col(m) / (max(sums[way][m], 1) if way in sums else 1)
        return rank.filter(F.col("_way") == way).select(F.col("_host").alias("host"), of("seeded").alias(seeded), of("any").alias(own))

    both = nodes.select("host").join(shares(">", "good", "any"), "host", "left").join(shares("<", "bad", "any_back"), "host", "left").fillna(0.0)
    trust = F.coalesce(F.try_divide("good", "any"), F.lit(0.0))
    distrust = F.coalesce(F.try_divide("bad", "any_back"), F.lit(0.0))
    out = both.select("host", trust.alias("trust"), distrust.alias("distrust"))
    outweighs = F.col("distrust") - F.col("trust") > threshold * (F.col("distrust") + F.col("trust"))
    return out.withColumn("verdict", F.when(outweighs & (F.col("distrust") > least), "block").otherwise("allow"))


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url: str = "url", html: str = "html", threshold: float = 0.2, least: float = 0.85) -> DataFrame:
    """Each page's ``host, path, rule, verdict`` and its host's trust and distrust.

    A rule decides where one fits, else the host's verdict. A null url has an
    empty host and path, fits no rule and is allowed; repeated rows are judged
    one by one; an empty table gives an empty result; columns named like a
    result are dropped with all others but the id. Html is read once for the
    edges; a page of any length gives its links, equal links add up.
    """
    host, path = host_and_path(F.col(url))
    parsed = pages.withColumns({"host": host, "path": path})
    parsed = parsed.withColumn("_hit", longest_rule(F.col("host"), F.col("path"), rules))
    judged = parsed.select(id_col, "host", "path", "_hit")
    counts = judged.filter("host != ''").groupBy("host").agg(
        F.count_if(F.col("_hit.verdict") == "allow").alias("n_allowed"), F.count_if(F.col("_hit.verdict") == "block").alias("n_blocked"), F.count("*").alias("n_pages"))
    edges = settle(page_edges(parsed, "host", html))
    by_host = host_verdicts(counts, edges, threshold, least)
    joined = judged.join(by_host.withColumnRenamed("verdict", "_method"), "host", "left")
    return joined.select(id_col, "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", "_method", F.lit("allow")).alias("verdict"), "trust", "distrust")
