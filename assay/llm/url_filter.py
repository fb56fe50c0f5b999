"""URL verdicts: rules first, then trust and distrust propagated over the host graph.

A rule names a host and a path prefix. It fits that host and its subdomains; of the rules
that fit a URL the longest decides. What no rule decides is judged by its host:

* the host graph has an edge for each pair of hosts joined by links of the pages, weighted
  by their number (links within a host say nothing and are left out);
* a host's seed of trust (distrust) is the share of its known URLs, pages and link targets,
  that the rules allow (block);
* trust is a personalised PageRank from the trusted seeds along the links; distrust is one
  from the blocked seeds against them, so that hosts linking to blocked ones inherit it;
* a host is blocked if its distrust exceeds its trust and is at least ``LEAST`` of what a
  host has that is blocked throughout and has no links.

Both ranks run as one set of rows: an edge table holds each edge once in either direction
with the share of its origin's rank that it carries, a round is one join and one sum with
map-side combine, written to the shared folder. Rounds end after ``ROUNDS`` or when no rank
changes. Rules are a list written by hand: at most ``MOST_RULES``, compiled into the plan
as a map looked up for each suffix of the host, so URLs are not joined with rules.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule and
is allowed; an empty path fits no rule whose path is ``/``; html that is null or holds no
absolute link gives no edges; repeated rows are judged each (and weigh as often); two rules
that are equally long go by the longer host, then block before allow; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm import common

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
MOST_RULES = 1_000
DAMPING = 0.85
ROUNDS = 20
LEAST = 0.5
HREF = r"""(?i)\shref\s*=\s*["']?\s*(https?://[^"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return common.lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``, empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: give them as a table and join")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for rule, verdict in sorted(set(rules)):
        at = rule.index("/")
        by_host.setdefault(rule[:at].lower(), []).append((rule[at:], verdict))
    if not by_host:
        return F.lit(None).cast("struct<rule string, verdict string>")
    # longest first; of equal ones the longer host, then block
    table = F.create_map(*[x for h, paths in by_host.items() for x in (F.lit(h), F.array(*[
        F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(len(h)).alias("host_size"), F.lit(v == "block").alias("blocks"),
                 F.lit(h + p).alias("rule"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for p, v in paths]))])
    parts = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = F.flatten(F.transform(suffixes, lambda s: F.filter(
        F.coalesce(F.try_element_at(table, s), F.array()), lambda r: F.startswith(path, r["path"]))))
    best = F.array_max(fits)
    return F.when(host != "", F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict"))))


def judged(urls: DataFrame, url: Column, rules=RULES) -> DataFrame:
    """``urls`` with host, path and the rule that decides (``rule``, ``verdict``: null where none does)."""
    rows = urls.withColumn("host", F.coalesce(host_of(url), F.lit(""))).withColumn("path", F.coalesce(path_of(url), F.lit("")))
    return rows.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).select(
        "*", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("verdict")).drop("_r")


def host_links(pages: DataFrame, rules=RULES) -> DataFrame:
    """(src, dst, n, blocked, allowed): links between pages' hosts and their targets' hosts, and how many the rules decide."""
    found = pages.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("src"),
                         F.explode(F.regexp_extract_all(F.col("html"), F.lit(HREF), F.lit(1))).alias("target"))
    known = judged(found, F.col("target"), rules).filter("src <> '' and host <> ''")
    return known.groupBy("src", F.col("host").alias("dst")).agg(*_counts())


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked"),
            F.count_if(F.col("verdict") == "allow").alias("allowed")]


def propagated(hosts: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of ``hosts`` (host, trust, distrust: the seeds) over ``links`` (src, dst, n)."""
    def shares(kind: str, origin: str, to: str) -> DataFrame:
        total = links.groupBy(origin).agg(F.sum("n").alias("_all"))
        return links.join(total, origin).select(F.lit(kind).alias("kind"), F.col(origin).alias("host"), F.col(to).alias("to"),
                                                (F.col("n") / F.col("_all") * damping).alias("share"))

    edges = common.materialize(shares("trust", "src", "dst").unionByName(shares("distrust", "dst", "src")), "host-edges")
    seeds = common.materialize(
        hosts.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "seed"))
        .select("kind", "host", (F.col("seed") * (1 - damping)).alias("seed")), "host-seeds")
    ranks = seeds.select("kind", "host", F.col("seed").alias("rank"))
    for _ in range(rounds):
        flow = ranks.join(edges, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("rank") * F.col("share")).alias("part"))
        got = flow.groupBy("kind", "host").agg(F.sum("part").alias("part"))
        new = common.materialize(
            seeds.join(got, ["kind", "host"], "left").join(ranks, ["kind", "host"])
            .select("kind", "host", (F.col("seed") + F.coalesce("part", F.lit(0.0))).alias("rank"), F.col("rank").alias("_old")), "host-ranks")
        ranks = new.select("kind", "host", "rank")
        if not new.filter("rank <> _old").head(1):
            break
    return ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))).alias("trust"),
                                     F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))).alias("distrust"))


def host_ranks(pages: DataFrame, rules=RULES) -> DataFrame:
    """(host, trust, distrust) of every host of a page or link target."""
    links = common.materialize(host_links(pages.select("url", "html"), rules), "host-links")
    own = judged(pages.select("url"), F.col("url"), rules).filter("host <> ''").groupBy("host").agg(*_counts())
    known = (own.unionByName(links.select(F.col("dst").alias("host"), "n", "blocked", "allowed"))
             .groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "blocked", "allowed")]))
    seeds = known.select("host", (F.col("allowed") / F.col("n")).alias("trust"), (F.col("blocked") / F.col("n")).alias("distrust"))
    between = links.filter("src <> dst").select("src", "dst", "n")
    return propagated(seeds, between)


def verdicts(pages: DataFrame, rules=RULES, least: float = LEAST) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust (null without a host)."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    ranks = common.materialize(host_ranks(pages, rules), "hosts")
    rows = judged(pages.select("page_id", "url"), F.col("url"), rules)
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= least * (1 - DAMPING) - 1e-9)
    return rows.join(ranks, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(bad, F.lit("block")).otherwise("allow")).alias("verdict"),
        F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


def op13(pages: DataFrame) -> DataFrame:
    return verdicts(pages)


def _rounds_sql() -> str:
    """The rounds as one chain of table expressions, one a round."""
    step = """r{i} as materialized (
  select s.kind, s.host, s.seed + coalesce(p.part, 0) as rank
  from s left join (select e.kind, e.to_host as host, sum(r.rank * e.share) as part
                    from r{j} r join e on e.kind = r.kind and e.host = r.host group by all) p
    on p.kind = s.kind and p.host = s.host)"""
    return ",\n".join(step.format(i=i, j=i - 1) for i in range(1, ROUNDS + 1))


OP13_SQL = rf"""
with rules(rule, rule_host, rule_path, rule_verdict) as (values
  {', '.join(f"('{r}', '{r[:r.index('/')]}', '{r[r.index('/'):]}', '{v}')" for r, v in RULES)}),
targets as (
  select url as page_url, unnest(regexp_extract_all(html, '(?i)\shref\s*=\s*["'']?\s*(https?://[^"''\s<>]+)', 1)) as url from pages),
known as (
  select 'page' as kind, page_id, url, url as page_url from pages
  union all select 'link', null, url, page_url from targets),
cut as (
  select *, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest,
         case when strpos(page_url, '://') > 0 then substr(page_url, strpos(page_url, '://') + 3) else '' end as page_rest
  from known),
parts as (
  select kind, page_id,
         translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path,
         translate(coalesce(regexp_extract(page_rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as src
  from cut),
u as materialized (
  select p.*, (select arg_max(rule, length(rule)) from rules
               where (p.host = rule_host or ends_with(p.host, '.' || rule_host)) and starts_with(p.path, rule_path)) as rule
  from parts p),
j as materialized (select u.*, rule_verdict from u left join rules using (rule)),
h as (
  select host, count(*) as n, count(*) filter (where rule_verdict = 'block') as blocked,
         count(*) filter (where rule_verdict = 'allow') as allowed
  from j where host <> '' and (kind = 'page' or src <> '') group by host),
s as materialized (
  select 'trust' as kind, host, 0.15::double * allowed / n as seed from h
  union all select 'distrust', host, 0.15::double * blocked / n from h),
l as materialized (select src, host as dst, count(*) as n from j where kind = 'link' and src <> '' and host <> '' and src <> host group by all),
e as materialized (
  select 'trust' as kind, src as host, dst as to_host, 0.85::double * n / sum(n) over (partition by src) as share from l
  union all select 'distrust', dst, src, 0.85::double * n / sum(n) over (partition by dst) from l),
r0 as (select kind, host, seed as rank from s),
{_rounds_sql()},
f as (
  select host, sum(rank) filter (where kind = 'trust') as trust, sum(rank) filter (where kind = 'distrust') as distrust
  from r{ROUNDS} group by host)
select page_id, host, path, rule,
       coalesce(rule_verdict, case when distrust > trust and distrust >= {LEAST} * 0.15::double - 1e-9 then 'block' else 'allow' end) as verdict,
       round(trust, 9) as trust, round(distrust, 9) as distrust
from j left join f using (host) where kind = 'page'
"""
