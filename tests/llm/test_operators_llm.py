"""The first ten operators on small tables: edge cases, brute-force versions, SQL twins."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF001, SF01
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def docs(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)
    if extra:  # names that the operators use themselves
        for c in ("size", "target", "copies", "c", "key", "_text", "_id", "n_words", "lang_pred", "score", "class_id", "row", "id", "r"):
            df = df.withColumn(c, F.lit("x"))
    return df


def prose(seed, n, words=400):
    rng = random.Random(seed)
    return [rng.choice(VOC) for _ in range(n)]


VOC = [f"{a}{b}{c}" for a in ("ta", "re", "mi", "so") for b in ("lu", "ka", "ne", "po", "di") for c in ("", "n", "sta", "rim", "vo")]

EDGE = [(1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, "One.", "b"), (5, "One.", "b"), (5, "One.", "b"), (None, "x y", "b"),
        (None, None, None), (6, "é" * 50_000, "c"), (7, " ".join(VOC * 400), "c"), (8, "\n".join(VOC * 100), "c"), (9, "!!! 123", "c")]


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# --- 10 near duplicates -------------------------------------------------------------------------

def shingles(text):
    w = (text or "").lower().encode().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(items, threshold=0.8):
    up = list(range(len(items)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    sh = [shingles(t) for _, t in items]
    for i in range(len(items)):
        for j in range(i):
            if sh[i] and sh[j] and len(sh[i] & sh[j]) >= threshold * len(sh[i] | sh[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    low = {}
    for i, (k, _) in enumerate(items):
        r = find(i)
        low[r] = min(low.get(r, k), k)
    return {k: low[find(i)] for i, (k, _) in enumerate(items)}


def test_near_duplicates_match_brute_force(spark):
    from itcflow.llm.near_dups import near_duplicate_classes
    rng, items = random.Random(5), []
    for g in range(25):
        base = prose(g, rng.choice([3, 8, 60, 200]))
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = "zz%d" % rng.randrange(9999)
            items.append((len(items), " ".join(w)))
    items.append((900, items[0][1].upper().replace(" ", "\n")))
    got = near_duplicate_classes(docs(spark, [(i, t, "a") for i, t in items], extra=True))
    assert got.columns == ["doc_id", "class_id"]
    assert {r["doc_id"]: r["class_id"] for r in rows(got)} == brute_classes(items)


def test_near_duplicates_on_a_sample_of_the_table(spark):
    from itcflow.llm.near_dups import near_duplicate_classes
    table = spark.read.parquet(f"{SF001}/documents.parquet")
    want = brute_classes([(r["doc_id"], r["text"]) for r in table.collect()])
    assert {r["doc_id"]: r["class_id"] for r in rows(near_duplicate_classes(table))} == want


def test_dense_bucket_is_cut_into_blocks(spark, monkeypatch):
    from itcflow.llm import near_dups
    monkeypatch.setattr(near_dups, "BLOCK_ROWS", 8)
    base = prose(1, 120)
    items = [(i, " ".join(base[:60] + [f"q{i}"] + base[60:])) for i in range(60)]
    got = {r["doc_id"]: r["class_id"] for r in rows(near_dups.near_duplicate_classes(docs(spark, [(i, t, "a") for i, t in items])))}
    assert set(got.values()) == {0} and len(got) == 60


def test_similar_pairs_dense_equals_plain():
    from itcflow.llm.near_dups import similar_pairs
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype("<u4")) for _ in range(40)]

    def sim(i, j):
        b = len(np.intersect1d(sets[i], sets[j]))
        return b >= 0.5 * (len(sets[i]) + len(sets[j]) - b)
    assert set(similar_pairs(sets, 0.5, 0)) == {(i, j) for i in range(40) for j in range(i + 1, 40) if sim(i, j)}
    assert set(similar_pairs(sets, 0.5, 15)) == {(i, j) for i in range(15) for j in range(15, 40) if sim(i, j)}


def test_weighted_signature_estimates_weighted_jaccard():
    from itcflow.llm import dartminhash as D
    rng = np.random.default_rng(1)
    el = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
    a, b = rng.uniform(0.1, 5, 300), rng.uniform(0.1, 5, 300)
    a[:50], b[250:] = 0, 0
    s = D.signatures([(el[a > 0], a[a > 0]), (el[b > 0], b[b > 0])], k=2000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


def test_word_hashes_of_any_length(monkeypatch):
    from itcflow.llm import dartminhash as D
    text = b"alpha beta  " + b"x" * 5000 + b"\tbeta alpha " + b"x" * 5000
    whole = D.word_hashes(text)[0]
    monkeypatch.setattr(D, "BLOCK", 64)
    monkeypatch.setattr(D, "_UP", D._UP[:128])
    small = D.word_hashes(text)[0]
    assert whole.tolist() == small.tolist()
    assert whole[0] == whole[4] and whole[1] == whole[3] and whole[2] == whole[5] and len(set(whole.tolist())) == 3


def test_near_duplicates_edges(spark):
    from itcflow.llm.near_dups import drop_near_duplicates, near_duplicate_classes
    got = near_duplicate_classes(docs(spark, EDGE, extra=True))
    assert got.count() == len(EDGE)
    by = collections.Counter((r["doc_id"], r["class_id"]) for r in rows(got))
    assert by[(1, 1)] == by[(2, 2)] == by[(3, 3)] == 1 and by[(5, 4)] == 2 and by[(4, 4)] == 1
    kept = drop_near_duplicates(docs(spark, EDGE, extra=True))
    assert kept.columns == docs(spark, EDGE, extra=True).columns
    assert sorted(r["doc_id"] for r in rows(kept) if r["doc_id"]) == [1, 2, 3, 4, 6, 7, 9]  # 8 has the words of 7
    assert near_duplicate_classes(docs(spark, [])).count() == 0 == drop_near_duplicates(docs(spark, [])).count()


def test_components_of_a_long_path(spark):
    from itcflow.llm.components import components
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in rows(components(edges))}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
    assert components(edges.limit(0)).count() == 0


# --- 6 lines ------------------------------------------------------------------------------------

def test_line_windows(spark):
    from itcflow.llm.line_dedup import dedup_lines, dedup_rows
    data = [(2, "p\nA\n B\n\nC\nq", "s"), (1, "x\nA\nB\nC\ny", "s"), (3, "A\nB", "s"), (4, "z\nz\nz\nz\nz", "s"), (5, None, "s"),
            (6, "", "s"), (7, "u\nv\nw", "s"), (7, "u\nv\nw", "s"), (None, "A\nB\nC", None), (8, "\n\n \n", "s")]
    got = collections.defaultdict(list)
    for r in rows(dedup_lines(docs(spark, data, extra=True))):
        got[r["doc_id"]].append((r["text"], r["n_lines"], r["n_removed"]))
    assert got[1] == [("x\nA\nB\nC\ny", 5, 0)] and got[2] == [("p\nq", 6, 4)] and got[3] == [("A\nB", 2, 0)]
    assert got[4] == [("z", 5, 4)] and got[5] == [(None, 0, 0)] and got[6] == [("", 1, 0)] and got[None] == [("", 3, 3)]
    assert sorted(got[7]) == [("", 3, 3), ("u\nv\nw", 3, 0)] and got[8] == [("\n\n \n", 4, 0)]
    back = dedup_rows(docs(spark, data, extra=True))
    assert back.columns == docs(spark, data, extra=True).columns and back.count() == len(data)
    assert dedup_lines(docs(spark, [])).count() == 0
    assert dedup_lines(docs(spark, EDGE)).count() == len(EDGE)


# --- 8 language ---------------------------------------------------------------------------------

def test_language_of_held_out_documents(spark):
    from itcflow.llm.hyper_lang import held_out, identify, learn_from_documents
    table = spark.read.parquet(f"{SF01}/documents.parquet")
    out = rows(identify(table, learn_from_documents(table)).select("doc_id", "lang", "lang_pred", "score", held_out().alias("h")))
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    out = [r for r in out if r["h"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.98 and all(0 <= r["score"] <= 1 for r in out)


def test_language_edges(spark):
    from itcflow.llm.hyper_lang import Profiles, identify, learn, learn_from_documents
    model = learn(spark.createDataFrame([("xx", "ababab"), ("yy", "cdcdcd"), (None, "ef"), ("zz", None), ("ww", "12")],
                                        "lang string, text string"))
    assert model.langs == ["xx", "yy"]
    got = identify(docs(spark, EDGE + [(50, "abab", "a"), (51, "CDCD!", "a")], extra=True), model)
    assert got.count() == len(EDGE) + 2
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows(got)}
    assert by[1] == by[2] == by[3] == by[9] == ("und", 0.0) and by[50][0] == "xx" and by[51][0] == "yy"
    nothing = learn_from_documents(docs(spark, []))
    assert nothing.langs == [] and identify(docs(spark, []), nothing).count() == 0
    assert {r["lang_pred"] for r in rows(identify(docs(spark, EDGE), nothing))} == {"und"}
    p, text = Profiles(), " ".join(VOC * 40)
    whole = p.counts(text)
    import itcflow.llm.hyper_lang as H
    old, H.BLOCK = H.BLOCK, 100
    try:
        cut = p.counts(text)
    finally:
        H.BLOCK = old
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()


# --- 1 mixing -----------------------------------------------------------------------------------

def brute_targets(sizes, weights=(1, 2, 3)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, rest = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        if not free:
            return full
        level = rest / sum(w[s] for s in free)
        above = [s for s in free if w[s] * level > 3 * sizes[s]]
        if not above:
            return full | {s: w[s] * level for s in free}
        for s in above:
            full[s] = 3 * sizes[s]
            rest -= full[s]


def check_mix(out, data):
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for _, t, s in data:
        sizes[s] += len(WORD.findall(t or ""))
        largest[s] = max(largest[s], len(WORD.findall(t or "")))
    want = brute_targets(dict(sizes))
    source = collections.defaultdict(list)
    for i, t, s in data:
        source[(i, len(WORD.findall(t or "")))].append(s)
    for r in out:
        s = source[(r["doc_id"], r["size"])].pop()
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-6, abs_tol=1e-6)
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, largest[s])
    return taken, want


def test_mix_meets_the_targets(spark):
    from itcflow.llm.mixing import mixing_plan, with_copies
    table = spark.read.parquet(f"{SF01}/documents.parquet")
    data = [(r["doc_id"], r["text"], r["source"]) for r in table.collect()]
    first = rows(with_copies(table, mixing_plan(table)))
    taken, want = check_mix(first, data)
    assert all(abs(taken[s] - want[s]) < 0.01 * want[s] for s in want)
    again = rows(with_copies(table.repartition(7), mixing_plan(table.repartition(5))))
    key = lambda r: r["doc_id"]
    assert [r["copies"] for r in sorted(first, key=key)] == [r["copies"] for r in sorted(again, key=key)]


def test_mix_edges(spark):
    from itcflow.llm.mixing import mixed, mixing_plan, with_copies
    data = EDGE + [(20 + i, " ".join(prose(i, 30)), "tiny") for i in range(3)]
    table = docs(spark, data, extra=True)
    plan = mixing_plan(table)
    out = rows(with_copies(table, plan))
    assert len(out) == len(data)
    check_mix(out, data)
    back = mixed(table, plan)
    assert back.columns == table.columns and back.count() == sum(r["copies"] for r in out)
    empty = docs(spark, [])
    assert with_copies(empty, mixing_plan(empty)).count() == 0
    none = docs(spark, [(1, None, "a"), (2, "", "b")])
    assert {r["taken"] for r in rows(with_copies(none, mixing_plan(none)))} == {0}


# --- 5 packing ----------------------------------------------------------------------------------

def ids_of(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    if not hasattr(ids_of, "t"):
        ids_of.t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return ids_of.t.encode(text or "", add_special_tokens=False).ids + [2]


def check_packing(out, data, slack):
    wanted, pieces, sequences = collections.Counter(), collections.defaultdict(list), collections.defaultdict(list)
    for i, t in data:
        ids = ids_of(t)
        for at in range(0, len(ids), 4096):
            wanted[(i, at, zlib.crc32(np.array(ids[at:at + 4096], "<u4").tobytes()), len(ids))] += 1
    for r in out:
        pieces[(r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"])].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: len(v) for k, v in pieces.items()} == dict(wanted)
    total = 0
    for s in sequences.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 4096
        total += at
    assert len(sequences) <= math.ceil(total / 4096) * (1 + slack) + 1


def test_packing_round_trip(spark):
    from itcflow.llm.packing import pack
    table = spark.read.parquet(f"{SF001}/documents.parquet")
    check_packing(rows(pack(table)), [(r["doc_id"], r["text"]) for r in table.collect()], 0.04)


def test_packing_edges(spark):
    from itcflow.llm.packing import pack
    data = EDGE + [(30, "Don't we'll l'été <|endoftext|> “quotes” ½ ﬁ İ ǅ 日本語 é a b x_y 12-3 'tis 'LL", "a"), (31, "a" * 300, "a")]
    out = rows(pack(docs(spark, data, extra=True)))
    check_packing(out, [(i, t) for i, t, _ in data], 1)
    assert pack(docs(spark, [])).count() == 0


def test_packing_reads_added_tokens_as_the_file_does(spark, monkeypatch):
    import public_tokenizers
    from itcflow.llm.packing import pack
    from itcflow.llm.token_ids import TokenIds
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = TokenIds()
    assert np.frombuffer(ids.of(b"one <|endoftext|> two"), "<u4").tolist() == [637, 49407, 1237]
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "It", "'s", " ", "\n", "é", "\u0301", "日", "12", "x" * 210]
    for _ in range(2000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        assert np.frombuffer(ids.of(text.encode()), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    monkeypatch.setattr(ids_of, "t", plain, raising=False)
    data = EDGE + [(30, "Don't we'll l'été <|endoftext|> “quotes” ½ ﬁ İ ǅ 日本語 é a b x_y 12-3 'tis 'LL", "a"), (31, "a<|startoftext|>b " * 3000, "a")]
    check_packing(rows(pack(docs(spark, data, extra=True))), [(i, t) for i, t, _ in data], 1)


def test_a_block_of_texts_learns_its_chunks_together(monkeypatch):
    import pyarrow as pa
    from itcflow.llm import token_ids as K
    ids, alone = K.TokenIds(), []
    make = ids.chunks.make
    monkeypatch.setattr(ids.chunks, "make", lambda chunk: alone.append(chunk) or make(chunk))
    rng = random.Random(12)
    plain = [" ".join(f"{rng.choice(VOC)}{rng.choice(['', ',', '.', "'s", 'É', '7!?'])}" for _ in range(200)) for _ in range(40)]
    assert [np.frombuffer(x, "<u4").tolist() + [2] for x in ids.of_all(pa.array([t.encode() for t in plain]))] == [ids_of(t) for t in plain]
    assert not alone
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "text|>", "It", "'LL", " ", "\n", "\t\r\x0b\x0c", "\xa0", "\x1c", "\x85", "\u2003", "\0", "é", "\u0301",
             "日", "İ", "½", "12", "x" * 70, "y" * 210]
    texts = ["", " ", "\n\n", *("".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(2000)), ""]
    data = pa.array([t.encode() for t in texts])
    for block, most in ((1, 200_000), (200, 200_000), (4 << 20, 50)):
        monkeypatch.setattr(K, "BLOCK_BYTES", block)
        monkeypatch.setattr(K, "MOST", most)
        some = K.TokenIds()
        assert [np.frombuffer(x, "<u4").tolist() + [2] for x in some.of_all(data.slice(1))] == [ids_of(t) for t in texts[1:]]
        for kept in (some.words, some.chunks):
            assert len(kept) <= most and len(kept.old) <= most
            assert max(map(len, [*kept, *kept.old])) <= K.LONGEST
            assert kept.bytes == sum(4 * len(k) + len(v) for k, v in kept.items())
    for few in ([], [""], ["", ""], [" "], ["a", ""]):
        got = list(ids.of_all(pa.array([t.encode() for t in few], pa.binary())))
        assert [np.frombuffer(x, "<u4").tolist() + [2] for x in got] == [ids_of(t) for t in few]
    bad = [b"\xff\xfe a\xc3", b"\xe6\x97 b\x80c"]
    assert list(ids.of_all(pa.array(bad))) == [K.TokenIds().of(t) for t in bad]


def test_words_kept_have_a_bound_in_bytes(monkeypatch):
    from itcflow.llm import token_ids as K
    ids = K.TokenIds()
    rng = random.Random(9)
    held = lambda: sum(len(k) + len(v) for c in (ids.words, ids.chunks) for g in (c, c.old) for k, v in g.items())
    for text in ("ab" * 500_000, "日本語の文章" * 60_000, "".join(rng.choices(VOC, k=200_000)),
                 " ".join("".join(rng.choices(VOC, k=400)) for _ in range(300))):
        data = text.encode()
        got = np.frombuffer(ids.of(data), "<u4").tolist()
        assert got + [2] == ids_of(text)
        assert held() < 64 << 20 and max(map(len, [*ids.chunks, *ids.words]), default=0) <= K.LONGEST
    assert held() < 1 << 20
    monkeypatch.setattr(K, "MOST_BYTES", 10_000)
    small = K.TokenIds()
    text = " ".join("".join(rng.choices(VOC, k=3)) for _ in range(20_000))
    assert np.frombuffer(small.of(text.encode()), "<u4").tolist() + [2] == ids_of(text)
    assert all(sum(4 * len(k) + len(v) for k, v in g.items()) < 11_000 for c in (small.words, small.chunks) for g in (c, c.old))


def test_differencing_never_exceeds_the_capacity():
    from itcflow.llm.packing import differencing, pack_group
    rng = random.Random(4)
    for n in (1, 2, 50, 900):
        sizes = [rng.choice([1, 7, 300, 2049, 4095, rng.randint(1, 4095)]) for _ in range(n)]
        load = collections.Counter()
        for w, s in zip(pack_group(sizes), sizes, strict=True):
            load[w] += s
        assert max(load.values()) <= 4096
    window, most = differencing([8, 7, 6, 5, 4], 2)
    loads = [sum(s for s, w in zip([8, 7, 6, 5, 4], window, strict=True) if w == k) for k in (0, 1)]
    assert max(loads) == most == 16


def test_long_rests_are_cut_to_fill_the_windows(spark):
    from itcflow.llm.packing import cut_group, pack
    rng = random.Random(6)
    for sizes in ([2100] * 500, [1400] * 700, [4095] * 50, [2049, 31] * 300, [rng.choice([3, 2100, 3000]) for _ in range(2000)]):
        load, covered = collections.Counter(), collections.defaultdict(list)
        for i, start, end, w in cut_group(sizes):
            load[w] += end - start
            covered[i].append((start, end))
        for i, n in enumerate(sizes):
            ends = sorted(covered[i])
            assert ends[0][0] == 0 and ends[-1][1] == n and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
        assert max(load.values()) <= 4096 and len(load) <= math.ceil(sum(sizes) / 4096) * 1.01 + 1
    data = [(i, "one " * (2100 + i % 3 * 50) + VOC[i % 9], "a") for i in range(100)]
    ids = {i: ids_of(t) for i, t, _ in data}
    out = rows(pack(docs(spark, data, extra=True)))
    texts, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        texts[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, x in ids.items():
        parts = sorted(texts[i])
        assert [p[0] for p in parts] == [sum(p[1] for p in parts[:n]) for n in range(len(parts))]
        assert sum(p[1] for p in parts) == len(x) and {p[2] for p in parts} == {len(x)}
    for parts in windows.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(p[1] for p in parts[:n]) for n in range(len(parts))]
        assert sum(p[1] for p in parts) <= 4096
    assert len(windows) <= math.ceil(sum(map(len, ids.values())) / 4096) + 1


# --- 7 decision lists ---------------------------------------------------------------------------

def brute_statistics(text):
    ws = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = collections.defaultdict(list)
    for i in range(len(ws) - 4):
        at[tuple(ws[i:i + 5])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return [len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)]


def test_statistics_match_brute_force(spark):
    from itcflow.llm.decision_list import statistics, text_statistics
    table = spark.read.parquet(f"{SF001}/documents.parquet")
    texts = [r["text"] for r in table.collect()] + [t for _, t, _ in EDGE if t and len(t) < 9000]
    texts += ["a b c d e a b c d e", "a a a a a a", "x y z é\u0085", "l\nl\n\nl \nl", "a b c d e f a b c d e g b c d e f"]
    for t in texts:
        assert statistics((t or "").encode())[:5] == brute_statistics(t)
    got = text_statistics(docs(spark, EDGE, extra=True))
    assert got.count() == len(EDGE) and text_statistics(docs(spark, [])).count() == 0
    assert {r["n_words"] for r in rows(got) if r["doc_id"] in (1, 2, 3)} == {0}


def test_learned_rules_agree_with_their_expression(spark):
    from itcflow.llm.decision_list import STATISTICS, feature_table, learn, learn_from, text_statistics
    table = spark.read.parquet(f"{SF01}/documents.parquet")
    stats = text_statistics(table, keep=["doc_id"])
    labelled = stats.join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id")
    rules = learn_from(labelled, "doc_id", "quality")
    local = labelled.withColumn("keep", rules.verdict()).toPandas()
    bad = rules.bad(feature_table(local))
    assert (bad == ~local["keep"].to_numpy(bool)).all()
    bad |= ((local["n_words"] < 10) | (100 * local["n_repeat_words"] > 20 * local["n_words"])).to_numpy(bool)
    assert bad[local["quality"] == 0].mean() > 0.85 and bad[local["quality"] == 1].mean() < 0.05
    nothing = learn_from(labelled.limit(0), "doc_id", "quality")
    assert nothing.rules == [] and stats.where(nothing.verdict()).count() == 1000
    assert learn(np.zeros((4, 9)), np.ones(4, int)).rules == [] and len(STATISTICS) == 9


# --- 4 search -----------------------------------------------------------------------------------

def test_search_edges_and_brute_force(spark):
    from itcflow.llm.segment_search import top_k
    rng = np.random.default_rng(0)
    data = [(i, [float(x) for x in rng.normal(size=12).round(2)]) for i in range(120)]
    data += [(200, None), (201, [1.0, None] + [0.0] * 10), (202, [float("nan")] * 12), (203, [float("inf")] * 12), (204, []),
             (250, data[50][1]), (251, data[50][1]), (None, data[50][1]), (252, [1.0, 2.0]), (300, [2.0, 2.0]), (253, [1e200] * 12)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("q", F.lit(1)).withColumn("row", F.lit(1))
    got = collections.defaultdict(list)
    for r in rows(top_k(df, F.col("vec_id") % 50 == 0)):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in data
          if v and all(x is not None and math.isfinite(x) for x in v)]
    for at, (i, q) in enumerate(ok):
        if i is not None and i % 50 == 0:
            pairs = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for n, (j, v) in enumerate(ok) if n != at and len(v) == len(q))
            want = [(k + 1, None if p[1] else p[2], max(-2 ** 63, min(2 ** 63 - 1, -p[0]))) for k, p in enumerate(pairs[:5])]
            assert sorted(got[i]) == want, i
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_segment_bounds_hold_and_prune():
    from itcflow.llm.segment_search import TopK, levels, segments
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(30, 64)).cumsum(axis=1)
    x = np.floor(256 * (centre[rng.integers(0, 30, 3000)] + 0.1 * rng.normal(size=(3000, 64))))
    q = x[:20]
    for p in levels(64):
        assert (segments(q, p) @ segments(x, p).T >= q @ x.T - 1e-3).all()
    top = TopK(list(range(20)), np.arange(20), q, 5)
    for lo in range(0, 3000, 500):
        top.add(list(range(lo, lo + 500)), np.arange(lo, lo + 500), x[lo:lo + 500])
    s = q @ x.T
    for i in range(20):
        want = sorted((-s[i, j], j) for j in range(3000) if j != i)[:5]
        assert [(b[0], b[2]) for b in top.best[i]] == want
    assert top.exact_pairs < top.pairs / 2


# --- 3 pages ------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="ad-free has-sidebar"><header><p>Site</p></header>
<nav><ul><li><a href="/">Home</a><li><a>More</a></ul></nav><script>var t="</p><p>no";</script><article><h1>A &amp; B</h1>
<p>First   para<b>graph</b> &eacute;t&eacute;&nbsp;ok.<p>Second <a href="x">link</a> here.<!-- <p>hidden</p> --><div class="advert">Buy!</div>
<ul><li>one<li>two</ul><noscript>no</noscript><section class="comments"><p>I think this is a very long comment about the article, really.</p></section>
</article><aside>See also this other story about something.</aside><footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    from itcflow.llm.html_text import blocks, labelled_blocks, main_text, train
    x, y = labelled_blocks()
    tree = train(x, y)
    assert [tree.predict(r) for r in x] == y.astype(bool).tolist()
    assert main_text(PAGE, tree) == "A & B\n\nFirst paragraph été ok.\n\nSecond link here.\n\none\n\ntwo"
    for broken in ("<p", "<", "</", "<!--", "<script>", "<a href='", "<p class=\"x>y", "&#xZ; &bogus; <<<>>>", "<article>" * 200):
        assert isinstance(main_text(broken, tree), str)
    assert blocks("") == []


def test_main_text_hidden_parts_and_open_heads():
    from itcflow.llm.html_labels import _L, _S
    from itcflow.llm.html_text import _hidden, labelled_blocks, main_text, train
    tree = train(*labelled_blocks())
    want = f"{_L}\n\n{_S}\n\n{_L}"
    body = f"<p>{_L}</p><p>{_S}</p><p>{_L}</p>"
    for shown in (' style="overflow: hidden"', ' title="The hidden valley"', " style='overflow-x: hidden; color: red'", " data-x='aria-hidden=true'",
                  " hidden=false", ' title="display: none"', " data-hidden", ' alt="a hidden=1 b"', ' aria-hidden="false"'):
        assert not _hidden(shown), shown
        assert main_text(f"<article><div{shown}>{body}</div></article>", tree) == want, shown
        assert main_text(f"<div{shown}>{body}</div>", tree) == want, shown
    for gone in (" hidden", " HIDDEN=''", ' class="a" hidden id=b', ' style="color:red; display : none"', " style=visibility:hidden",
                 " style='visibility: hidden'", ' aria-hidden="true"', " aria-hidden=true", ' hidden="until-found"'):
        assert _hidden(gone), gone
        assert main_text(f"<article>{body}<div{gone}>{_S}</div></article>", tree) == want, gone
    head = "<!DOCTYPE html><html><head><meta charset=utf-8><title>T</title><link rel=x><style>p{}</style>"
    for page in (f"{head}{body}", f"{head}<article>{body}</article></html>", f"{head}<svg></svg>{body}", f"{head}</head>{body}", f"{head}<body>{body}",
                 f"{head}not shown</head><body>{body}"):
        assert main_text(page, tree) == want, page
    assert main_text(f"{head}{_L} <b>{_S}</b> {_L}", tree) == f"{_L} {_S} {_L}"


def test_main_text_names_are_whole_and_own():
    """Only whole names of an element's own attributes mark it; anchors are no marks."""
    from itcflow.llm.html_labels import _L, _S
    from itcflow.llm.html_text import labelled_blocks, main_text, train
    tree = train(*labelled_blocks())
    want = f"Head\n\n{_L}\n\n{_S}"
    for kept in ('<section id="discussion"><h2>Head</h2>{L}{S}</section>', '<h2 id="terms">Head</h2>{L}{S}', '<h2 id=related-work>Head</h2>{L}{S}',
                 '<h2>Head</h2><p class="side-effects">{l}</p>{S}', '<h2>Head</h2><p data-id="comment-1">{l}</p>{S}',
                 '<h2>Head</h2><p title="x class=sidebar">{l}</p>{S}', "<h2 data-x='a id=\"ad\"'>Head</h2>{L}{S}", '<h2 class="section-header">Head</h2>{L}{S}',
                 '<section id=links class="popular-culture"><h2>Head</h2>{L}{S}</section>', '<h2 id="comments-of-the-mayor">Head</h2>{L}{S}',
                 '<h2>Head</h2><p><span id="replies">{l}</span></p>{S}', '<div class="legal-history"><h2>Head</h2>{L}{S}</div>'):
        page = kept.format(l=_L, L=f"<p>{_L}</p>", S=f"<p>{_S}</p>")
        assert main_text(f"<article>{page}</article>", tree) == want, kept
    for gone in ('class="ad-slot"', "class='x ad_container'", 'id="comment-12"', "class=sideBar", 'class="site-footer"', "id=cookie-banner",
                 'class="relatedPosts"', 'aria-label="Share this article"', "role=navigation", 'class="reader-comments"', "CLASS='Newsletter-Box'"):
        for page in (f"<article><h2>Head</h2><p>{_L}</p><p>{_S}</p><div {gone}><p>{_L}</p></div></article>",
                     f"<article><h2>Head</h2><p>{_L}</p><p>{_S}</p></article><div {gone}><p>{_L}</p></div>"):
            assert main_text(page, tree) == want, gone
    assert main_text(f"<article><h2>Head</h2><p>{_L}</p><p>{_S}</p><section id=comments><p>{_L}</p></section></article>", tree) == want


def test_pages_table(spark):
    import html

    from itcflow.llm.html_text import extract
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    got = {r["page_id"]: r for r in rows(extract(pages))}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)>", inner)]
        want = "\n\n".join(p for p in parts if p)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
    edge = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", ""), (3, "u", "<p>" + "x " * 200_000)], "page_id long, url string, html string")
    out = rows(extract(edge.withColumn("text", F.lit("t")).withColumn("_html", F.lit("t"))))
    assert len(out) == 4 and [r["text"] for r in out if r["page_id"] < 3] == ["", "", ""]
    assert extract(edge.limit(0)).count() == 0


# --- 9 token counts -----------------------------------------------------------------------------

def test_longest_match_equals_word_piece():
    from itcflow.llm.wordpiece_count import from_wordpiece
    from tokenizers import models
    rng = random.Random(3)
    for _ in range(40):
        v = set()
        for _ in range(rng.randint(2, 25)):
            s = "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
            v.add(s if rng.random() < 0.5 else "##" + s)
        m = models.WordPiece({p: i for i, p in enumerate([*sorted(v), "[UNK]"])}, unk_token="[UNK]", max_input_chars_per_word=1000)
        a = from_wordpiece(v)
        for _ in range(100):
            w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
            assert a.count(w.encode()) == len(m.tokenize(w))


def test_token_counts_edges(spark):
    from itcflow.llm.wordpiece_count import from_byte_level, token_counts
    a = from_byte_level()
    out = rows(token_counts(docs(spark, EDGE, extra=True), a))
    by = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in out}
    assert len(out) == len(EDGE) and by[1] == by[2] == by[3] == (0, 0) and by[6][0] == 1 and by[6][1] >= 25_000
    assert token_counts(docs(spark, []), a).count() == 0


# --- 2 chats ------------------------------------------------------------------------------------

def test_perspectives(spark):
    from itcflow.llm.perspectives import perspectives
    turns = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|x|>"), (1, 2, "bob", "Yo"), (1, 3, "ann", None), (2, 0, "system", "s"),
             (None, None, None, "n"), (None, 1, "ann", "m"), (3, 0, "ann", "t"), (3, 0, "ann", "t")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    df = df.withColumn("speaker", F.lit(1)).withColumn("block", F.lit(1)).withColumn("_key", F.lit(1))
    got = {(r["conv_id"], r["speaker"]): r for r in rows(perspectives(df))}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown"), (None, "ann"), (3, "ann")}
    r = got[(1, "ann")]
    assert r["text"] == ("<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi < |x|><|end|>\n<|user bob|>\nYo<|end|>\n<|assistant|>\n<|end|>\n")
    assert [r["text"][s["start"]:s["end"]] for s in r["spans"]] == ["Hi < |x|><|end|>", "<|end|>"]
    assert got[(None, "unknown")]["text"] == "<|user ann|>\nm<|end|>\n<|assistant|>\nn<|end|>\n" and got[(3, "ann")]["n_turns"] == 2
    long = spark.createDataFrame([(1, i, "ann" if i % 2 else "bob", f"t{i}") for i in range(150)], "conv_id long, turn long, role string, text string")
    parts = sorted(rows(perspectives(long).where("speaker = 'ann'")), key=lambda r: r["block"])
    assert [r["n_turns"] for r in parts] == [64, 64, 22] and re.findall(r"t\d+", "".join(r["text"] for r in parts)) == [f"t{i}" for i in range(150)]
    assert perspectives(df.limit(0)).count() == 0


# --- registered queries ---------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["op2_perspectives", "op4_segment_search", "op6_line_windows"])
def test_query_equals_sql(spark, duck, name):
    from itcflow.llm.queries import LLM_QUERIES, LLM_SQL
    df = LLM_QUERIES[name](spark, SF01)
    cols = sorted(df.columns)
    cur = duck(SF01).execute(LLM_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want


def test_dialogues_without_an_id_and_with_an_empty_one_are_two(spark):
    from itcflow.llm.perspectives import perspectives
    turns = spark.createDataFrame([(None, 0, "a", "x"), ("", 0, "a", "y"), ("", 1, "b", "z"), ("=", 0, "a", "w")],
                                  "conv_id string, turn int, role string, text string")
    got = {(r["conv_id"], r["speaker"], r["n_turns"]) for r in rows(perspectives(turns))}
    assert got == {(None, "a", 1), ("", "a", 2), ("", "b", 2), ("=", "a", 1)}


def test_one_query_for_each_operator():
    from itcflow.llm.queries import LLM_QUERIES
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))
