"""Prefix trie of conversations by van Emde Boas recursion.

A trie of sequences of turns is cut at half its depth: the cut prefixes get
names, the upper half becomes a trie of its own over the first half of every
sequence, the lower half a forest with one root a name. Both are cut at their
half in turn, all of a round in parallel, until every depth has been a cut. A
trie as deep as the longest sequence so takes as many rounds as that length has
binary digits, and each (sequence, depth) is named in just one of them.

Depth ``d = odd * 2**z`` is the cut of the interval from ``d - 2**z`` (whose
prefix has its name from an earlier, coarser round and is the root) to
``d + 2**z``; what lies between root and cut is one aligned block of ``2**z``
turns. Blocks are hashed pairwise beforehand (128 bits). So round ``z`` groups
by (depth, root's name, block) and the name is the group's smallest sequence.

Totals go back from fine to coarse: once the sub-tries of ``2**z`` levels are
summed, the totals of the nodes at a cut are grafted onto all nodes of the upper
half above them. That is half a row a node and round, however deep the trie.

Sequences that are equal from end to end are one weighted sequence from the
start. All tables of a round are written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import prefix_sum
from .common import materialize, prepare

#: Ids written out by one row on the way to a node's digest.
CHUNK_IDS = 4096
_NOTHING = hashlib.sha256(b"").hexdigest()


def number_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """``conv, nth, h1, h2, chars``: every turn with its place (from 1), 128 bits
    of its role and text, and its text's code points. Numbered over many tasks,
    so that one conversation may hold any share of the rows."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).isNotNull().alias("known"), F.col(turn_col).alias("turn"),
        role.alias("role"), F.md5(text).alias("digest"), F.xxhash64(F.lit(1), role, text).alias("h1"),
        F.xxhash64(F.lit(2), role, text).alias("h2"), F.length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("again"))
    out = prefix_sum(rows, ["conv"], ["known", "turn", "role", "digest", "again"], F.lit(1).cast("long"), "nth")
    return out.select("conv", "nth", "h1", "h2", "chars")


def plain(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences as they are: (conv, depth, h1, h2, chars, len) and (conv, len)."""
    ends = numbered.groupBy("conv").agg(F.max("nth").alias("len"))
    return numbered.withColumnRenamed("nth", "depth").join(ends, "conv"), ends


def rebuilt(numbered: DataFrame, group: int = 100, spread: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their hundred: the first ``h``
    turns of ``c - c % group``, then c's own after its first ``h``;
    ``h = crc32(decimal c) % spread``. Result as of ``plain``."""
    own = numbered.groupBy("conv").agg(F.max("nth").alias("n"))
    conv = own.select("conv", "n", (F.col("conv") - F.col("conv") % group).alias("base"),
                      (F.crc32(F.col("conv").cast("string").cast("binary")) % spread).alias("h"))
    base = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    conv = conv.join(base, "base", "left").select("conv", "base", "h", taken.alias("taken"),
                                                  (taken + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("len"))
    mark = ["h1", "h2", "chars", "len"]
    rest = (numbered.join(conv, "conv").where("nth > h")
                    .select("conv", (F.col("nth") - F.col("h") + F.col("taken")).alias("depth"), *mark))
    first = numbered.where(F.col("nth") < spread).withColumnRenamed("conv", "base")
    first = first.join(conv, "base").where("nth <= taken").select("conv", F.col("nth").alias("depth"), *mark)
    return first.unionByName(rest), conv.select("conv", "len")


def _pairs(level: DataFrame) -> DataFrame:
    """Blocks of twice the length: two neighbours become one; one alone goes."""
    left, right = F.col("j") % 2 == 0, F.col("j") % 2 == 1
    p = level.groupBy("conv", F.floor(F.col("j") / 2).alias("j")).agg(
        F.max("len").alias("len"), F.max(F.when(right, F.col("chars"))).alias("chars"), F.count(F.lit(1)).alias("n"),
        *[F.max(F.when(side, F.col(h))).alias(name) for side, h, name in
          ((left, "h1", "l1"), (left, "h2", "l2"), (right, "h1", "r1"), (right, "h2", "r2"))])
    both = ["l1", "l2", "r1", "r2"]
    return p.where("n = 2").select("conv", "j", F.xxhash64(F.lit(3), *both).alias("h1"),
                                   F.xxhash64(F.lit(4), *both).alias("h2"), "chars", "len")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (s1, s2, len, conv) -> (s1, s2, len, first, ids): runs of ids, comma-joined."""
    out: list[tuple] = []
    key, ids = None, []

    def full() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())],
                                          names=["s1", "s2", "len", "first", "ids"])

    for batch in batches:
        for *k, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids and (k != key or len(ids) == CHUNK_IDS):
                out.append((*key, ids[0], ",".join(map(str, ids))))
                ids = []
                if len(out) == 512:
                    yield full()
            key = k
            ids.append(conv)
    if ids:
        out.append((*key, ids[0], ",".join(map(str, ids))))
    if out:
        yield full()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs -> (conv, ends_sha256), conv the smallest id; a key's runs are read one
    after the other, never held."""
    key, sha, conv, out = None, None, None, []

    def full() -> pa.RecordBatch:
        convs, digests = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(digests, pa.string())], names=["conv", "ends_sha256"])

    for batch in batches:
        for *k, first, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if sha:
                    out.append((conv, sha.hexdigest()))
                key, conv, sha = k, first, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if len(out) >= 512:
            yield full()
    if sha:
        out.append((conv, sha.hexdigest()))
    if out:
        yield full()


def _end_digests(seqs: DataFrame) -> DataFrame:
    """``conv, ends_sha256``: the digest of the ids of every class of equal sequences,
    beside the smallest of them. Ids are written out in sorted runs by many tasks,
    only runs meet where they are hashed."""
    key = ["s1", "s2", "len"]
    ids = seqs.select(*key, "conv").repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv")
    runs = ids.mapInArrow(_chunks, "s1 bigint, s2 bigint, len bigint, first bigint, ids string")
    return (runs.repartition(*key).sortWithinPartitions(*key, "first")
                .mapInArrow(_digests, "conv bigint, ends_sha256 string"))


def _at(z: int) -> Column:
    """Depths that are a cut of round ``z``."""
    return F.col("depth") % 2 ** (z + 1) == 2 ** z


def _long(x) -> Column:
    return F.lit(x).cast("long")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def build_trie(turns: DataFrame, ends: DataFrame) -> DataFrame:
    """The trie of sequences: ``turns`` (conv, depth from 1 without gaps, h1, h2, chars, len),
    ``ends`` (conv, len), one row for every sequence, empty ones too.

    One row a node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    No sequences, no rows (not even a root).
    """
    last, top, total = ends.agg(F.max("len"), F.min("conv"), F.count(F.lit(1))).first()
    rounds = (last or 0).bit_length()

    levels = []
    level = turns.select("conv", (F.col("depth") - 1).alias("j"), "h1", "h2", "chars", "len")
    for z in range(rounds):
        levels.append(materialize(level, f"blocks{z}") if z else level)
        level = _pairs(levels[-1])
    empty = turns.select("conv", "depth", "h1", "h2", "chars", "len").limit(0)
    cuts = _all([empty] + [level.where("j % 2 = 0").withColumn("depth", (F.col("j") + 1) * 2 ** z).drop("j")
                           for z, level in enumerate(levels)])

    # equal sequences: the blocks that make up a sequence are those of its length's binary digits
    digit = reduce(lambda a, z: a | (_at(z) & (F.col("depth") == F.col("len") - F.col("len") % 2 ** z)), range(rounds), F.lit(False))
    tail = cuts.where(digit).select("conv", "len", *[F.xxhash64(F.lit(k), "depth", "h1", "h2").alias(f"s{k - 4}") for k in (5, 6)])
    none = ends.select("conv", "len", _long(0).alias("s1"), _long(0).alias("s2"))
    seqs = materialize(tail.unionByName(none).groupBy("conv").agg(
        F.max("len").alias("len"), F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2")), "sequences")
    weights = seqs.groupBy("s1", "s2", "len").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("w")).select("conv", "w")
    cuts = materialize(cuts.join(weights, "conv"), "cuts")

    # names: 128 bits of the root's name and the block between root and cut; the trie's root is (0, 0)
    named: list[DataFrame] = []
    for z in reversed(range(rounds)):
        part = cuts.where(_at(z)).withColumn("at", F.col("depth") - 2 ** z)
        if named:
            above = _all(named).where(F.col("depth") % 2 ** (z + 1) == 0).select(
                "conv", F.col("depth").alias("at"), F.col("m1").alias("r1"), F.col("m2").alias("r2"))
            part = part.join(above, ["conv", "at"], "left")
        else:
            part = part.withColumns({"r1": _long(0), "r2": _long(0)})
        block = [F.coalesce("r1", F.lit(0)), F.coalesce("r2", F.lit(0)), F.col("h1"), F.col("h2")]
        named.append(materialize(part.select("conv", "depth", F.xxhash64(F.lit(7), *block).alias("m1"),
                                             F.xxhash64(F.lit(8), *block).alias("m2"), "w", "chars", "len"), f"names{z}"))
    every = _all(named) if named else empty.select("conv", "depth", F.col("h1").alias("m1"), F.col("h2").alias("m2"),
                                                   _long(0).alias("w"), "chars", "len")

    # a sequence's name one turn higher is its node's parent
    up = every.select("conv", (F.col("depth") + 1).alias("depth"), F.col("m1").alias("p1"), F.col("m2").alias("p2"))
    first = lambda *cols: [F.max(c).alias(c) for c in cols]
    rows = (_all([every, up]).groupBy("conv", "depth").agg(*first("m1", "m2", "p1", "p2", "w", "chars", "len"))
            .where("m1 is not null"))
    root = turns.sparkSession.createDataFrame([(0, 0, 0, total, 0, top)] if total else [],
                                              "m1 long, m2 long, depth long, n_convs long, chars long, conv_id long")
    nodes = rows.groupBy("m1", "m2").agg(
        F.max("depth").alias("depth"), F.max(F.coalesce("p1", F.lit(0))).alias("p1"), F.max(F.coalesce("p2", F.lit(0))).alias("p2"),
        F.sum("w").alias("n_convs"), F.max("chars").alias("chars"), F.min("conv").alias("conv_id"))
    nodes = materialize(_all([nodes, root]), "nodes")
    own = nodes.select("m1", "m2", "depth", "conv_id", "n_convs", "chars", _long(0).alias("n_children"))
    child = nodes.where("depth > 0").select(F.col("p1").alias("m1"), F.col("p2").alias("m2"), _long(1).alias("n_children"))
    trie = materialize(_all([own, child]).groupBy("m1", "m2").agg(
        *first("depth", "conv_id", "n_convs", "chars"), F.sum("n_children").alias("n_children")).select(
        "m1", "m2", "depth", "conv_id", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), "trie")

    totals = ["n_leaves", "saved_tokens"]
    added = [F.sum(c).alias(c) for c in totals]
    parts = [trie.select("m1", "m2", "depth", "conv_id", *totals)]
    for z in range(rounds):
        cut = _all([p.where(_at(z)) for p in parts])
        if z:
            cut = cut.groupBy("m1", "m2", "depth").agg(*first("conv_id"), *added)
        cut = cut.select(F.col("conv_id").alias("conv"), (F.shiftright("depth", z) - 1).alias("cell"), *totals)
        upper = every.select("conv", "depth", F.shiftright("depth", z).alias("cell"), "m1", "m2").where("cell % 2 = 0")
        graft = _all([cut.join(upper, ["conv", "cell"]).select("m1", "m2", "depth", *totals),
                      cut.where("cell = 0").select(_long(0).alias("m1"), _long(0).alias("m2"), _long(0).alias("depth"), *totals)])
        parts.append(materialize(graft.groupBy("m1", "m2", "depth").agg(*added), f"graft{z}"))

    # a class of equal sequences ends where its smallest one does
    closed = (_end_digests(seqs).join(_all([every.where("depth = len").select("conv", "m1", "m2"), seqs.where("len = 0").select(
        "conv", _long(0).alias("m1"), _long(0).alias("m2"))]), "conv").select("m1", "m2", "ends_sha256"))
    parent = nodes.select(F.col("m1").alias("p1"), F.col("m2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    above = nodes.where("depth > 0").select("m1", "m2", "p1", "p2").join(parent, ["p1", "p2"]).select("m1", "m2", "parent_conv_id")
    out = _all([trie.drop(*totals), above, closed, *[p.select("m1", "m2", *totals) for p in parts]])
    return (out.groupBy("m1", "m2").agg(*first("conv_id", "depth", "parent_conv_id", "n_convs", "n_children"), *added, *first("ends_sha256"))
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *totals,
                    F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256")))


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", sequences=plain) -> DataFrame:
    """The prefix trie of a table of turns; columns as of ``build_trie``.

    Turns are in order of their number, null first, ties by role and by the MD5
    of the text; repeated rows are turns of their own. A null role or text is
    empty. Rows without a conversation id take no part; an empty table has no
    nodes. Other columns are ignored. ``sequences`` makes the sequences out of
    the numbered turns: ``plain`` or ``rebuilt``.
    """
    prepare(turns.sparkSession)
    numbered = materialize(number_turns(turns, conv_col, turn_col, role_col, text_col), "turns")
    rows, ends = sequences(numbered)
    return build_trie(materialize(rows, "sequence_turns"), materialize(ends, "lengths"))


_CRC = ("list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''), "
        "lambda s: [CAST(ascii(s) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), "
        "lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))")

#: DuckDB SQL of the registered query.
SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, max(i) AS n, xor({_CRC.format('c')}, 4294967295) % 6 AS h FROM t GROUP BY c),
q AS (SELECT l.c, l.h, least(l.h, coalesce(b.n, 0)) AS k, least(l.h, coalesce(b.n, 0)) + greatest(0, l.n - l.h) AS len
      FROM l LEFT JOIN l AS b ON b.c = l.c - l.c % 100),
s AS (SELECT q.c, t.i AS d, t.r, t.x FROM q JOIN t ON t.c = q.c - q.c % 100 AND t.i <= q.k
      UNION ALL SELECT q.c, t.i - q.h + q.k, t.r, t.x FROM q JOIN t ON t.c = q.c AND t.i > q.h),
p AS (SELECT c, d, length(x) AS chars, md5(string_agg(md5(r) || md5(x), '') OVER (PARTITION BY c ORDER BY d)) AS k FROM s
      UNION ALL SELECT c, 0, 0, '' FROM q),
m AS (SELECT c, d, chars, min(c) OVER (PARTITION BY d, k) AS a FROM p),
n AS (SELECT a, d, count(*) AS n_convs, max(chars) AS chars FROM m GROUP BY a, d),
f AS (SELECT n.a, n.d, n.n_convs, n.chars, u.a AS pa FROM n LEFT JOIN m AS u ON u.c = n.a AND u.d = n.d - 1),
g AS (SELECT pa, d - 1 AS d, count(*) AS n_children FROM f WHERE d > 0 GROUP BY pa, d),
w AS (SELECT f.*, coalesce(g.n_children, 0) AS n_children FROM f LEFT JOIN g ON g.pa = f.a AND g.d = f.d),
o AS (SELECT m.a, m.d, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((w.n_convs - 1) * w.chars) AS saved
      FROM w JOIN m ON m.c = w.a AND m.d <= w.d GROUP BY m.a, m.d),
e AS (SELECT m.a, m.d, sha256(string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c)) AS ends
      FROM m JOIN q ON q.c = m.c AND q.len = m.d GROUP BY m.a, m.d)
SELECT w.a AS conv_id, CAST(w.d AS BIGINT) AS depth, w.pa AS parent_conv_id, w.n_convs, w.n_children,
       CAST(o.n_leaves AS BIGINT) AS n_leaves, CAST(o.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM w JOIN o ON o.a = w.a AND o.d = w.d LEFT JOIN e ON e.a = w.a AND e.d = w.d
"""
