"""URL filters: host and path rules, and trust and distrust that spread over the links between hosts.

A url that a rule fits is judged by the longest such rule.  For the others the host counts: trust is the
personalised PageRank from hosts that rules allow, over links; distrust is the same from hosts that rules
block, over reversed links (who links to bad hosts is bad).  A host is a seed where rules allow, or block, at
least ``SEED_SHARE`` of its pages, with that share as its weight.  Hosts without links to follow give their
rank back to the seeds; rounds go on until ranks move by less than ``TOLERANCE`` of all seed weight.  Ranks
add up to the weight of the seeds, so a seed that no link touches keeps its weight.  A host is blocked where
its distrust is over ``RATIO`` times its trust and over ``LEAST``.

Null urls and urls without ``://`` have an empty host and path; no rule fits them, they are no seeds, and
they are allowed.  Null html has no links; html of any length is read whole.  Repeated rows are judged each
(and weigh as often in the seeds and links).  Empty tables give an empty result.  Columns of the pages named
like the result's are replaced, all others stay.  Everything is built from DataFrame functions; joins by
host are dealt out by ``SALTS`` hashes of the other side as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
DAMPING, RATIO, SEED_SHARE, LEAST = 0.85, 2.0, 0.5, 0.05
#: Ranks have settled; and after so many rounds at the latest (0.85 ** 57 is below the tolerance).
TOLERANCE, ROUNDS = 1e-4, 100
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url):
    """The host of a url, empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host, path, rules=RULES):
    """The longest rule that fits (as a struct of rule and verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = rule.index("/") if "/" in rule else len(rule)
        on = rule[:at]
        fits = ((host == on) | F.endswith(host, F.lit(f".{on}"))) & F.startswith(path, F.lit(rule[at:])) & (host != "")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame, html: str = "html", host: str = "host") -> DataFrame:
    """(src, dst, n) of links between different hosts."""
    links = pages.where(F.col(host) != "").select(F.col(host).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), 1)).alias("link"))
    links = links.where(F.startswith(F.col("link"), F.lit("//")) | (F.instr("link", "://") > 0))
    whole = F.when(F.startswith(F.col("link"), F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return links.select("src", host_of(whole).alias("dst")).where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_scores(hosts: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from seeds (host, allowed, blocked: weights) and links (src, dst, n)."""
    seeds = hosts.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("allowed").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("blocked").alias("seed")))).alias("x")).select("host", "x.kind", "x.seed")
    seeds = written(seeds.where("seed > 0"), "seeds")
    links = written(links, "links")
    ranks = seeds.select("kind", "host", F.col("seed").alias("rank"))
    if not links.isEmpty():
        ahead = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
        flows = ahead.unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))
        salted = flows.withColumn("salt", F.pmod(F.xxhash64("to"), F.lit(SALTS)))
        every_salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")).alias("salt")
        total = flows.groupBy("kind", "host").agg(F.sum("n").alias("all")).select("*", every_salt)
        flows = written(salted.join(total, ["kind", "host", "salt"]).select("kind", "host", "to", "salt", (F.col("n") / F.col("all")).alias("share")), "flows")
        # of each kind the weight of all seeds, and each seed's part of it: two rows that are broadcast
        weights = seeds.groupBy("kind").agg(F.sum("seed").alias("weight"))
        weight = sum(r.weight for r in weights.collect())
        base = seeds.join(F.broadcast(weights), "kind").select("kind", "host", "seed", "weight")
        for _ in range(rounds):
            moved = ranks.select("*", every_salt).join(flows, ["kind", "host", "salt"]).select("kind", F.col("to").alias("host"), (damping * F.col("rank") * F.col("share")).alias("part"))
            moved = written(moved.groupBy("kind", "host").agg(F.sum("part").alias("part")), "moved")
            followed = moved.groupBy("kind").agg(F.sum("part").alias("followed"))
            # what no link carried on, damped or not, is the seeds' again
            back = base.join(F.broadcast(followed), "kind", "left").select("kind", "host", (F.col("seed") * (1 - F.coalesce("followed", F.lit(0.0)) / F.col("weight"))).alias("part"))
            both = moved.unionByName(back).withColumn("before", F.lit(0.0)).unionByName(ranks.select("kind", "host", F.lit(0.0).alias("part"), F.col("rank").alias("before")))
            ranks = written(both.groupBy("kind", "host").agg(F.sum("part").alias("rank"), F.sum("before").alias("before")), "ranks")
            change = ranks.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] or 0.0
            ranks = ranks.drop("before")
            if change <= tolerance * weight:
                break
    pick = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    return ranks.groupBy("host").agg(pick("trust"), pick("distrust"))


def judged(pages: DataFrame, url: str = "url", html: str = "html", rules=RULES, ratio: float = RATIO, seed_share: float = SEED_SHARE, least: float = LEAST) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block)."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    text = F.col(f"`{url}`").cast("string")
    rows = pages.withColumns({"_host": host_of(text), "_path": path_of(text)}).withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules))
    share = lambda verdict: F.avg(F.when(F.col("_rule.verdict") == verdict, 1.0).otherwise(0.0))
    hosts = rows.where("_host <> ''").groupBy(F.col("_host").alias("host")).agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    hosts = hosts.select("host", *[F.when(F.col(c) >= seed_share, F.col(c)).otherwise(0.0).alias(c) for c in ("allowed", "blocked")])
    scores = host_scores(hosts, host_links(rows, html, "_host"))
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")).alias("_salt")
    bad = scores.where((F.col("distrust") > ratio * F.col("trust")) & (F.col("distrust") > least)).select(F.col("host").alias("_host"), F.lit(True).alias("_bad"), every_salt)
    out = rows.withColumn("_salt", F.pmod(F.xxhash64("_path"), F.lit(SALTS))).join(bad, ["_host", "_salt"], "left")
    verdict = F.coalesce("_rule.verdict", F.when(F.col("_bad"), "block").otherwise("allow"))
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))


def op3_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    rule = "CASE " + " ".join(
        f"WHEN (host = '{r[: r.index('/')]}' OR host LIKE '%.{r[: r.index('/')]}') AND starts_with(path, '{r[r.index('/') :]}') THEN '{r}'" for r, _ in sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    ) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES) + " END"
    lower = f"translate(coalesce(regexp_extract({{0}}, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
    return f"""
WITH RECURSIVE p AS (SELECT page_id, html, {lower.format("url")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS MATERIALIZED (SELECT *, {verdict} AS v FROM (SELECT *, {rule} AS rule FROM p)),
h AS (SELECT host, avg(CASE WHEN v = 'allow' THEN 1.0 ELSE 0.0 END) AS allowed, avg(CASE WHEN v = 'block' THEN 1.0 ELSE 0.0 END) AS blocked FROM j WHERE host <> '' GROUP BY host),
s AS MATERIALIZED (SELECT host, kind, seed, sum(seed) OVER (PARTITION BY kind) AS weight FROM (SELECT host, 'trust' AS kind, allowed AS seed FROM h UNION ALL SELECT host, 'distrust', blocked FROM h) WHERE seed >= {SEED_SHARE}),
a AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS link FROM j WHERE host <> ''),
b AS (SELECT src, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS link FROM a WHERE starts_with(link, '//') OR contains(link, '://')),
l AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT src, {lower.format("link")} AS dst FROM b) WHERE dst <> '' AND src <> dst GROUP BY src, dst),
f AS MATERIALIZED (SELECT 'trust' AS kind, src AS host, dst AS dest, n / sum(n) OVER (PARTITION BY src) AS share FROM l UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM l),
r(k, kind, host, rank) AS (
  SELECT 0, kind, host, CAST(seed AS DOUBLE) FROM s
  UNION ALL
  SELECT k, kind, host, sum(part) FROM (
    SELECT r.k + 1 AS k, r.kind, f.dest AS host, {DAMPING} * r.rank * f.share AS part FROM r JOIN f USING (kind, host) WHERE r.k < {ROUNDS}
    UNION ALL
    SELECT m.k + 1, s.kind, s.host, s.seed * (1 - coalesce(m.followed, 0) / s.weight) FROM s JOIN (SELECT r.k, r.kind, sum({DAMPING} * r.rank * f.share) AS followed FROM r LEFT JOIN f USING (kind, host) WHERE r.k < {ROUNDS} GROUP BY 1, 2) m USING (kind)
  ) GROUP BY k, kind, host),
t AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS distrust FROM r WHERE k = {ROUNDS} GROUP BY host)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.v, CASE WHEN t.distrust > {RATIO} * t.trust AND t.distrust > {LEAST} THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN t USING (host)
"""


ORACLE_OP3 = _oracle()
