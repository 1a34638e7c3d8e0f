"""URL filter: rules of hosts and paths, and link-graph propagation for the rest.

Every url is judged by the longest rule that fits it. Urls without a rule are
judged by their host: trust spreads from hosts whose pages the rules allow along
links (who trusted hosts link to is trusted), distrust from hosts whose pages the
rules block against them (who links to blocked hosts is distrusted). Both are
personalised PageRanks over host edges. A host is blocked where distrust makes
up more than ``threshold`` hundredths of what the same walk from all hosts with a
page under a rule brings there, and a larger part than trust does of its own walk.

A host is a seed by the share of its pages that have such a rule, so a rule for
one path of a host weighs as little as that path does. Hosts without any page
under a rule start no walk: they are judged by what reaches them alone.

Ranks are whole numbers of ``UNIT``; what an edge carries is rounded down. Sums
then don't depend on the order of the rows, and a walk ends when nothing is left
to carry or after ``rounds`` steps (what is left then is ``damping ** rounds`` of
all). One frontier holds both walks; each step is one join and one partial
aggregate, written to the shared folder.

DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

ALLOW, BLOCK = "allow", "block"
#: Rules by default: verdict and host with path.
RULES = ((BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/"))
#: Rules become one CASE; more than that belong into a table of their own.
MAX_RULES = 200
#: Whole numbers that a host hands out as its own rank: 10**8 leaves room for 10**9 hosts in a long.
UNIT = 10 ** 8
#: Share of a rank that goes on along links, in hundredths.
DAMPING = 85
ROUNDS = 24
#: A host is blocked by a larger share of distrust than this, in hundredths.
THRESHOLD = 50
#: The pages of one host are dealt to this many tasks when they get its verdict.
SALTS = 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_REST = r"(?s)^.*?://(.*)$"
_HOST = r"(?s)^([^/?#]*)"
_PATH = r"(?s)^[^/?#]*([^?#]*)"
#: Left out before links are looked for: comments, scripts and styles.
_SILENT = r"(?is)<!--.*?-->|<script\b.*?</script|<style\b.*?</style"
#: Hosts of links with a host of their own (the rest stay on the page's host).
_LINK = r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(F.regexp_extract(url, _REST, 1), _HOST, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(F.regexp_extract(url, _REST, 1), _PATH, 1), F.lit(""))


def _cut(rule: str) -> tuple[str, str]:
    at = rule.find("/")
    return (rule, "") if at < 0 else (rule[:at], rule[at:])


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict. A rule fits its
    host and all of its subdomains if the path starts with the rule's; of rules
    of one length the one with the longer host counts, then the one that blocks."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule, verdict = F, F
    for v, r in sorted(rules, key=lambda x: (-len(x[1]), -len(_cut(x[1])[0]), x[0] != BLOCK, x[1])):
        h, p = _cut(r)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = rule.when(fits, F.lit(r)), verdict.when(fits, F.lit(v))
    empty = F.lit(None).cast("string")
    return (rule.otherwise(empty), verdict.otherwise(empty)) if rules else (empty, empty)


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst``: distinct links between different hosts, from whole pages. Pages
    without a host and links to one's own host give none."""
    links = pages.select(host_of(F.col(url_col)).alias("src"),
                         F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), _SILENT, " ").alias("x"))
    found = links.select("src", F.explode(F.array_distinct(F.regexp_extract_all("x", F.lit(_LINK), F.lit(1)))).alias("dst"))
    return found.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> '' and dst <> '' and src <> dst").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, damping: int = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``host, trust, trust_of, distrust, distrust_of``: ranks of the walks from
    the seeds and of the same walks from all hosts with a page under a rule.

    ``seeds``: host, n (pages), n_allow, n_block; ``edges``: src, dst. Other hosts
    hand out nothing of their own but pass on what they get. Walks go along links (trust) and against them (distrust);
    what a host without a way on gets stays there."""
    both = edges.select(F.lit(True).alias("along"), "src", "dst").unionByName(
        edges.select(F.lit(False).alias("along"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    ways = both.groupBy("along", "src").agg(F.count(F.lit(1)).alias("ways"))
    own = UNIT * (100 - damping) // 100
    share = lambda c: F.expr(f"{own}L * {c} div n")
    start = F.explode(F.array(F.struct(F.lit(True).alias("along"), share("n_allow").alias("part")),
                              F.struct(F.lit(False).alias("along"), share("n_block").alias("part"))))
    frontier = materialize(seeds.where("n_allow + n_block > 0").select("host", start.alias("s")).select(
        "s.along", "host", "s.part", F.lit(own).cast("long").alias("total")), "walk0")
    steps = [frontier]
    ways = materialize(ways, "ways")
    both = materialize(both, "edges")
    for step in range(1, rounds + 1):
        give = frontier.join(ways.withColumnRenamed("src", "host"), ["along", "host"]).select(
            "along", F.col("host").alias("src"), *[F.expr(f"{c} * {damping} div (100 * ways)").alias(c) for c in ("part", "total")])
        frontier = materialize(
            both.join(give.where("total > 0"), ["along", "src"]).groupBy("along", F.col("dst").alias("host"))
                .agg(F.sum("part").alias("part"), F.sum("total").alias("total")), f"walk{step}")
        if frontier.isEmpty():
            break
        steps.append(frontier)
    got = lambda c, along: F.coalesce(F.sum(F.when(F.col("along") == along, F.col(c))), F.lit(0))
    return reduce(DataFrame.unionByName, steps).groupBy("host").agg(
        got("part", True).alias("trust"), got("total", True).alias("trust_of"),
        got("part", False).alias("distrust"), got("total", False).alias("distrust_of"))


def distrusted(threshold: int = THRESHOLD) -> Column:
    """Whether a host's ranks block it: exact, in products of whole numbers."""
    t, t_of, d, d_of = (F.col(c).cast("decimal(19, 0)") for c in ("trust", "trust_of", "distrust", "distrust_of"))
    return (100 * d > threshold * d_of) & (d * F.greatest(t_of, F.lit(1)) > t * d_of)


def judge(pages: DataFrame, url_col: str = "url", html_col: str = "html", rules=RULES, damping: int = DAMPING,
          rounds: int = ROUNDS, threshold: int = THRESHOLD) -> DataFrame:
    """``pages`` without the html, with ``host``, ``path``, ``rule`` and ``verdict``
    (``allow`` or ``block``): the rule's, else that of the host's ranks.

    Without ``://`` (or a url) host and path are empty, and so is the rule; such
    pages are allowed, as is every host that no walk reaches. A null html has no
    links. Repeated rows are pages of their own; they count towards a host's
    shares. Columns of ``pages`` with the names of the four new ones are
    replaced; others stay. An empty table gives an empty result.
    """
    made = {"host", "path", "rule", "verdict", "page_host", "salt"}
    keep = [c for c in pages.columns if c.lower() not in made and c != html_col]
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    base = (pages.select(*[F.col(f"`{c}`") for c in keep], F.col(url_col).alias("page_host"))
                 .withColumn("host", host_of(F.col("page_host"))).withColumn("path", path_of(F.col("page_host"))).drop("page_host"))
    urls = base.withColumn("rule", rule).withColumn("verdict", verdict)
    seeds = (urls.where("host <> ''").groupBy("host")
                 .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == ALLOW).alias("n_allow"),
                      F.count_if(F.col("verdict") == BLOCK).alias("n_block")))
    edges = materialize(host_edges(pages, url_col, html_col), "links")
    ranks = propagate(seeds, edges, damping, rounds)
    blocked = ranks.where(distrusted(threshold)).select("host", F.lit(BLOCK).alias("by_links"),
                                                        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    return (urls.withColumn("salt", salt).join(blocked, ["host", "salt"], "left")
                .select(*[F.col(f"`{c}`") for c in keep], "host", "path", "rule",
                        F.coalesce("verdict", "by_links", F.lit(ALLOW)).alias("verdict")))


def _sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL of the registered query: the walks as one recursive table."""
    case = lambda x: ("CASE " + " ".join(
        f"WHEN (host = '{_cut(r)[0]}' OR ends_with(host, '.{_cut(r)[0]}')) AND starts_with(path, '{_cut(r)[1]}') THEN '{x(v, r)}'"
        for v, r in sorted(RULES, key=lambda y: -len(y[1]))) + " END")
    quoted = lambda s: s.replace("'", "''")
    own = UNIT * (100 - DAMPING) // 100
    host = lambda x: f"translate(regexp_extract({x}, '{_HOST}', 1), '{_UPPER}', '{_LOWER}')"
    return f"""
WITH RECURSIVE r AS (SELECT page_id, coalesce(regexp_extract(url, '{_REST}', 1), '') AS rest, coalesce(html, '') AS html FROM pages),
u AS (SELECT page_id, {host('rest')} AS host, regexp_extract(rest, '{_PATH}', 1) AS path, html FROM r),
v AS (SELECT page_id, host, path, {case(lambda v, r: r)} AS rule, {case(lambda v, r: v)} AS verdict FROM u),
s AS (SELECT host, count(*) AS n, count_if(verdict = 'allow') AS a, count_if(verdict = 'block') AS b FROM v WHERE host <> '' GROUP BY host HAVING count(verdict) > 0),
l AS (SELECT host AS src, translate(unnest(regexp_extract_all(regexp_replace(html, '{_SILENT}', ' ', 'g'), '{quoted(_LINK)}', 1)),
                                    '{_UPPER}', '{_LOWER}') AS dst FROM u),
d AS (SELECT DISTINCT src, dst FROM l WHERE src <> '' AND dst <> '' AND src <> dst),
e AS (SELECT true AS along, src, dst FROM d UNION ALL SELECT false, dst, src FROM d),
w AS (SELECT e.*, count(*) OVER (PARTITION BY along, src) AS ways FROM e),
walk AS (SELECT 0 AS step, true AS along, host, {own} * a // n AS part, CAST({own} AS BIGINT) AS total FROM s
         UNION ALL SELECT 0, false, host, {own} * b // n, CAST({own} AS BIGINT) FROM s
         UNION ALL
         (SELECT walk.step + 1, walk.along, w.dst, CAST(sum(walk.part * {DAMPING} // (100 * w.ways)) AS BIGINT),
                 CAST(sum(walk.total * {DAMPING} // (100 * w.ways)) AS BIGINT)
          FROM walk JOIN w ON w.along = walk.along AND w.src = walk.host
          WHERE walk.step < {rounds} AND walk.total * {DAMPING} // (100 * w.ways) > 0 GROUP BY 1, 2, 3)),
k AS (SELECT host, CAST(coalesce(sum(part) FILTER (along), 0) AS HUGEINT) AS t, CAST(coalesce(sum(total) FILTER (along), 0) AS HUGEINT) AS t_of,
             CAST(coalesce(sum(part) FILTER (NOT along), 0) AS HUGEINT) AS d, CAST(coalesce(sum(total) FILTER (NOT along), 0) AS HUGEINT) AS d_of
      FROM walk GROUP BY host),
x AS (SELECT host FROM k WHERE 100 * d > {THRESHOLD} * d_of AND d * greatest(t_of, 1) > t * d_of)
SELECT v.page_id, v.host, v.path, v.rule, coalesce(v.verdict, CASE WHEN x.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN x ON x.host = v.host
"""


SQL = _sql()
