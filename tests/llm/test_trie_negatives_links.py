"""Prefix trie, hard negatives and the url filter: brute-force versions, edge cases, SQL twins."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import SF001, SF01
from pyspark.sql import functions as F

TURNS = "conv_id long, turn int, role string, text string"
VECTORS = "vec_id long, embedding array<float>, label int"
PAGES = "page_id long, url string, html string"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def same(a, b):
    key = lambda r: repr(sorted(r.items()))
    assert sorted(a, key=key) == sorted(b, key=key)


def clash(df, names):
    for c in names:
        df = df.withColumn(c, F.lit("x"))
    return df


# --- 11 prefix trie -----------------------------------------------------------------------------

def sequences(turns, build):
    own = collections.defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    if not build:
        return own
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + v[h:]
    return out


def brute_trie(seqs):
    if not seqs:
        return []
    members = collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = sorted(c for c in m if len(seqs[c]) == len(p))
        out.append({"conv_id": min(m), "depth": len(p), "parent_conv_id": min(members[p[:-1]]) if p else None, "n_convs": len(m),
                    "n_children": children[p], "n_leaves": leaves[p], "saved_tokens": saved[p],
                    "ends_sha256": hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()})
    return out


def dialogues(seed, n, longest):
    rng, out = random.Random(seed), []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 5, 8, longest])):
            out.append((c * 37 - 40, t, rng.choice(["user", "user", "assistant"]), rng.choice(["a", "b", "bb", "çé", ""])))
    return out


@pytest.mark.parametrize("build", [False, True])
def test_trie_matches_brute_force(spark, build):
    from itcflow.llm.prefix_trie import plain, prefix_trie, rebuilt
    turns = dialogues(3, 120, 21) + [(100, 0, "user", "a")]
    df = clash(spark.createDataFrame(turns, TURNS), ["conv", "depth", "h1", "name", "len", "w"])
    same(rows(prefix_trie(df, sequences=rebuilt if build else plain)), brute_trie(sequences(turns, build)))


def test_trie_edges(spark, monkeypatch):
    from itcflow.llm import prefix_trie as P
    monkeypatch.setattr(P, "CHUNK_IDS", 3)  # digests over several runs of ids
    turns = [(i, 0, "user", "common") for i in range(5000, 5020)] + [(i, 1, None, "z" * 20_000) for i in range(5000, 5003)]
    turns += [(None, 0, "user", "gone"), (1, None, None, None), (1, 0, "", ""), (1, 0, "", ""), (-250, 7, "user", "é"),
              (2, 3, "b", "later"), (2, 3, "a", "sooner"), (2, None, "c", "first")]
    for build in (P.plain, P.rebuilt):
        same(rows(P.prefix_trie(spark.createDataFrame(turns, TURNS), sequences=build)), brute_trie(sequences(turns, build is P.rebuilt)))
    # 8103 has h = 3 and two turns, there is no 8100: a conversation without turns, a member of the root alone
    short = next(c for c in range(8101, 8200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    turns = [(short, 0, "user", "x"), (short, 1, "user", "y")]
    out = rows(P.prefix_trie(spark.createDataFrame(turns, TURNS), sequences=P.rebuilt))
    same(out, brute_trie({short: []}))
    assert P.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert P.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS), sequences=P.rebuilt).count() == 0


def test_trie_of_one_long_and_many_equal_dialogues(spark):
    from itcflow.llm.prefix_trie import prefix_trie
    turns = [(1, t, "user", str(t % 7)) for t in range(300)] + [(c, t, "user", str(t % 7)) for c in range(10, 210) for t in range(4)]
    same(rows(prefix_trie(spark.createDataFrame(turns, TURNS))), brute_trie(sequences(turns, False)))


# --- 12 hard negatives --------------------------------------------------------------------------

def brute_negatives(data, anchor, positives=5, negatives=5, low=80, high=100):
    ok = [(n, i, y, [int(np.floor(256 * float(x))) for x in v]) for n, (i, v, y) in enumerate(data)
          if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    out = []
    for n, i, y, v in ok:
        if not anchor(i):
            continue
        s = [(sum(a * b for a, b in zip(v, w, strict=True)), j, m, z) for m, j, z, w in ok if m != n and len(w) == len(v)]
        for p in sorted((r for r in s if r[3] == y), key=order)[:positives]:
            fits = [r for r in s if r[3] != y and low * p[0] <= 100 * r[0] <= high * p[0]]
            for k, r in enumerate(sorted(fits, key=order)[:negatives]):
                out.append({"anchor_id": i, "positive_id": p[1], "rank": k + 1, "negative_id": r[1],
                            "positive_score": p[0], "negative_score": r[0]})
    return out


def vectors(seed, n, dim):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.round(rng.normal(0, 1, dim) + 0.4, 2).astype(np.float32)], int(rng.integers(0, 4))) for i in range(n)]


def test_strassen_is_exact():
    from itcflow.llm.strassen_negatives import strassen
    rng = np.random.default_rng(1)
    for r, n, c in [(1, 1, 1), (0, 8, 3), (3, 0, 4), (33, 64, 100), (64, 17, 9), (200, 300, 150), (2, 500, 2)]:
        a, b = rng.integers(-10 ** 6, 10 ** 6, (r, n)), rng.integers(-10 ** 6, 10 ** 6, (n, c))
        for leaf in (1, 8):
            assert (strassen(a, b, leaf) == a @ b).all(), (r, n, c)
    # sums inside wrap around, the product doesn't
    a = np.full((16, 16), 2 ** 61, np.int64)
    b = np.zeros((16, 16), np.int64)
    b[0] = 3
    assert (strassen(a, b, 1) == 3 * 2 ** 61).all()
    big = np.array([[10 ** 30, 1], [2, -10 ** 25]], object)
    assert (strassen(big, big, 1) == big @ big).all()


def test_negatives_match_brute_force(spark, monkeypatch):
    from itcflow.llm import strassen_negatives as S
    monkeypatch.setattr(S, "ANCHOR_ROWS", 7)  # many tiles
    monkeypatch.setattr(S, "CANDIDATE_ROWS", 40)
    data = vectors(2, 220, 9) + [(500 + i, v[:5], y) for i, v, y in vectors(3, 30, 5)]
    df = clash(spark.createDataFrame(data, VECTORS), ["row", "score", "id", "block", "v", "part"])
    got = rows(S.mine(df, F.col("vec_id") % 10 == 0, F.col("label")))
    want = brute_negatives(data, lambda i: i % 10 == 0)
    assert len(want) > 100
    same(got, want)


def test_negatives_edges(spark):
    from itcflow.llm.strassen_negatives import mine
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 1.0], 2), (3, [1.0, 1.0], 2), (4, [0.9, 1.0], 2), (5, [0.1, 0.1], 2),
            (6, None, 1), (7, [1.0, None], 1), (8, [1.0, nan], 2), (9, [inf, 1.0], 2), (11, [1.0, 1.0], None), (10, [], 1), (12, [], 2),
            (13, [], 1), (20, [-1.0, 0.0], 3), (21, [1.0, 0.0], 3), (22, [1.0, 1.0], 4), (2, [1.0, 1.0], 2), (0, [1.0, 1.0], 1)]
    df = spark.createDataFrame(data, VECTORS)
    got = rows(mine(df, F.col("vec_id") % 10 == 0, F.col("label")))
    # repeated rows stand for themselves; which of two equal ones comes first doesn't show
    same(got, brute_negatives(data, lambda i: i % 10 == 0))
    assert not [r for r in got if r["anchor_id"] == 20]  # its one positive scores below zero
    null_id = rows(mine(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), (None, [1.0], 2), (3, [1.0], 2)], VECTORS),
                        F.col("vec_id") == 0, F.col("label")))
    assert [r["negative_id"] for r in sorted(null_id, key=lambda r: r["rank"])] == [3, None]
    huge = [(0, [3e15, 1.0], 1), (1, [3e15, 1.0], 1), (2, [3e15, 0.5], 2), (3, [2e15, 1.0], 2)]
    got = rows(mine(spark.createDataFrame(huge, VECTORS), F.col("vec_id") == 0, F.col("label")))
    assert [(r["negative_id"], r["negative_score"]) for r in got] == [(2, 2 ** 63 - 1)]
    assert mine(spark.createDataFrame([], VECTORS), F.col("vec_id") == 0, F.col("label")).count() == 0


# --- 13 url filter ------------------------------------------------------------------------------

def test_hosts_paths_and_rules(spark):
    from itcflow.llm.link_graph import judge
    urls = {"https://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
            "http://example.net/english": ("example.net", "/english", "net/", "block"),
            "http://NET/": ("net", "/", "net/", "block"), "http://a.net": ("a.net", "", None, "allow"), "http://a.net?x=/": ("a.net", "", None, "allow"),
            "x://planet/a": ("planet", "/a", None, "allow"), "http://b.example.com/de/": ("b.example.com", "/de/", "example.com/de/", "block"),
            "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"), "http://c.org/fr/?u=://d.net/": ("c.org", "/fr/", "org/fr/", "allow"),
            "http://c.org/de": ("c.org", "/de", None, "allow"), "://e.org/fr/1#://": ("e.org", "/fr/1", "org/fr/", "allow"),
            "no host": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"), "a://": ("", "", None, "allow"),
            "http://ÄÖ.org/Fr/\nx y?": ("ÄÖ.org", "/Fr/\nx y", None, "allow"), "http://u@h.net:80/p": ("u@h.net:80", "/p", None, "allow")}
    df = clash(spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES), ["host", "Salt", "path", "n", "verdict", "total"])
    out = judge(df)
    assert out.columns == ["page_id", "url", "n", "total", "host", "path", "rule", "verdict"]
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(out)}
    assert got == urls
    assert judge(spark.createDataFrame([], PAGES)).count() == 0
    everything = rows(judge(df, rules=()))
    assert {r["verdict"] for r in everything} == {"allow"} and len(everything) == len(urls)


def brute_links(data, rules=(("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))):
    """Walks by exact whole numbers, over plain Python dictionaries."""
    import re
    pages = []
    for i, url, html in data:
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(r), r, v) for v, r in rules for h, p in [(r.split("/")[0], "/" + r.split("/", 1)[1])]
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        links = re.sub(r"(?is)<!--.*?-->|<script\b.*?</script|<style\b.*?</style", " ", html or "")
        links = {x.lower() for x in re.findall(r"""(?i)<a\s[^>]*?href=["']?(?:[a-z]+:)?//([^/?#"'\s>]*)""", links)}
        pages.append((i, host, path, *(max(fits)[1:] if fits else (None, None)), links))
    n, ruled, edges = collections.Counter(), collections.defaultdict(collections.Counter), set()
    for _, host, _, _, verdict, links in pages:
        if host:
            n[host] += 1
            ruled[verdict][host] += 1
            edges |= {(host, x) for x in links if x and x != host}

    def walk(edges, seeds):
        out = collections.defaultdict(set)
        for a, b in edges:
            out[a].add(b)
        now = {h: 15 * 10 ** 6 * k // n[h] for h, k in seeds.items() if ruled["allow"][h] + ruled["block"][h]}
        total = collections.Counter(now)
        for _ in range(24):
            step = collections.Counter()
            for a, x in now.items():
                for b in out[a]:
                    step[b] += x * 85 // (100 * len(out[a]))
            now = step
            total.update(now)
        return total
    back = {(b, a) for a, b in edges}
    t, t_of, d, d_of = walk(edges, ruled["allow"]), walk(edges, n), walk(back, ruled["block"]), walk(back, n)
    bad = {h for h in d if 100 * d[h] > 50 * d_of[h] and d[h] * max(1, t_of[h]) > t[h] * d_of[h]}
    return [{"page_id": i, "host": h, "path": p, "rule": r, "verdict": v or ("block" if h in bad else "allow")} for i, h, p, r, v, _ in pages]


def web(seed=4, n=240):
    rng, out = random.Random(seed), []
    a = lambda h, k: f'<p><A class=x href="{rng.choice(["http:", "HTTPS:", ""])}//{h}/x{k}?y">{k}</a>'
    good, bad = [f"g{i}.org" for i in range(8)], [f"s{i}.net" for i in range(3)]
    mixed = [f"m{i}.info" for i in range(12)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:
            h, path, to = rng.choice(good), rng.choice(["/fr/", "/en/"]), good + mixed[:6]
        elif kind < 0.5:
            h, path, to = rng.choice(bad), "/x", bad + mixed
        elif kind < 0.75:
            h, path, to = rng.choice(mixed[:6]), "/a", good + mixed[:6]
        else:
            h, path, to = rng.choice(mixed[6:]), "/b", bad
        html = f"<!-- {a('s0.net', 1)} --><script>'{a('s1.net', 2)}'</script>" + "".join(a(rng.choice(to).upper(), k) for k in range(3)) + '<a href="/home">'
        out.append((i, f"http://{h}{path}/{i}", html))
    return out


def test_links_spread_trust_and_distrust(spark, duck):
    from itcflow.llm.link_graph import SQL, judge
    data = web()
    df = spark.createDataFrame(data, PAGES)
    got = rows(judge(df).select("page_id", "host", "path", "rule", "verdict"))
    same(got, brute_links(data))
    by_host = {r["host"]: r["verdict"] for r in got}
    assert {by_host[f"m{i}.info"] for i in range(6, 12)} == {"block"}  # link only to blocked hosts
    assert {by_host[f"m{i}.info"] for i in range(6)} == {"allow"}  # linked to by blocked ones, link to good ones
    con = duck(SF001)
    con.execute("DROP VIEW pages")
    con.register("pages", df.toPandas())
    found = con.execute(SQL)
    names = [c[0] for c in found.description]
    same(got, [dict(zip(names, r, strict=True)) for r in found.fetchall()])


def test_walks_end_and_keep_to_their_seeds(spark):
    from itcflow.llm.link_graph import propagate
    seeds = spark.createDataFrame([("a", 1, 1, 0), ("b", 2, 0, 1), ("c", 1, 0, 0)], "host string, n long, n_allow long, n_block long")
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    out = {r["host"]: r for r in rows(propagate(seeds, loop))}
    assert all(r["trust"] <= r["trust_of"] and r["distrust"] <= r["distrust_of"] for r in out.values())
    assert out["c"]["distrust"] == 0 < out["c"]["trust"] and out["a"]["distrust"] > 0
    none = {r["host"]: r for r in rows(propagate(seeds, loop.limit(0)))}
    assert none["b"]["distrust"] == 7_500_000 and none["b"]["distrust_of"] // 2 == none["a"]["trust"] // 2
    assert none["a"]["trust"] == 15_000_000 and "c" not in none


# --- queries ------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["op11_veb_trie", "op12_strassen_negatives", "op13_link_graph"])
def test_query_equals_sql(spark, duck, name):
    from itcflow.llm.queries import LLM_QUERIES, LLM_SQL
    got = rows(LLM_QUERIES[name](spark, SF01))
    found = duck(SF01).execute(LLM_SQL[name])
    names = [c[0] for c in found.description]
    same(got, [dict(zip(names, r, strict=True)) for r in found.fetchall()])
    assert got
