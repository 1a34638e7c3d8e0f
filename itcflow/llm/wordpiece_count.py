"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie. Each node has a failure link (the node reached after
the longest pieces that surely begin the node's string are taken off) and the
number of pieces so taken off. A word is read once, byte by byte: where the
trie has no edge, the count of the node is added and its link followed. Time is
linear in the length of the word, and no piece is built.

A word is a run of ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have 0 words
and 0 tokens. A word that the pieces can't spell counts as one token.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, spare, utf8
from .token_ids import Kept, byte_characters

_FIRST, _NEXT = 0, 1  # roots of the pieces that begin a word, and of those that go on


@dataclass
class Automaton:
    """``edges``: node * 256 + byte -> node; ``link``: -1 where there is none."""

    edges: dict[int, int]
    link: list[int]
    taken: list[int]
    before: bytes = b""  # what is put before each word

    def count(self, word: bytes) -> int:
        """Number of pieces of one word."""
        edges, link, taken = self.edges, self.link, self.taken
        node, n = _FIRST, 0
        for b in self.before + word:
            nxt = edges.get(node * 256 + b)
            while nxt is None:
                if link[node] < 0:
                    return 1
                n += taken[node]
                node = link[node]
                nxt = edges.get(node * 256 + b)
            node = nxt
        while node != _NEXT:
            if link[node] < 0:
                return 1
            n += taken[node]
            node = link[node]
        return n


def build(first: Iterable[bytes], following: Iterable[bytes], before: bytes = b"") -> Automaton:
    """The automaton of the pieces that may begin a word and of those that may follow."""
    edges: dict[int, int] = {}
    parent, label, final = [-1, -1], [0, 0], [False, False]
    for root, pieces in ((_FIRST, first), (_NEXT, following)):
        for piece in pieces:
            if not piece:
                continue
            node = root
            for b in piece:
                key = node * 256 + b
                if key not in edges:
                    edges[key] = len(parent)
                    parent.append(node)
                    label.append(b)
                    final.append(False)
                node = edges[key]
            final[node] = True
    link, taken = [-1] * len(parent), [0] * len(parent)
    depth = [0] * len(parent)
    for v in range(2, len(parent)):
        depth[v] = depth[parent[v]] + 1
    for v in sorted(range(2, len(parent)), key=depth.__getitem__):  # a link leads to a node less deep
        if final[v]:
            link[v], taken[v] = _NEXT, 1
            continue
        u = parent[v]
        z, n = link[u], taken[u]
        while z >= 0 and z * 256 + label[v] not in edges:
            n += taken[z]
            z = link[z]
        if z >= 0:
            link[v], taken[v] = edges[z * 256 + label[v]], n
    return Automaton(edges, link, taken, before)


def from_wordpiece(vocabulary: Iterable[str], going_on: str = "##") -> Automaton:
    """Pieces that go on a word carry a prefix, as in word-piece vocabularies."""
    vocabulary = list(vocabulary)
    return build([p.encode() for p in vocabulary if not p.startswith(going_on)],
                 [p[len(going_on):].encode() for p in vocabulary if p.startswith(going_on)])


def from_byte_level(path: str | None = None) -> Automaton:
    """Pieces of a byte-level tokenizer file, where those that begin a word carry
    its blank. All single bytes are pieces, so that every word can be spelled."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = {t["content"] for t in told.get("added_tokens", [])}
    byte = {c: b for b, c in enumerate(byte_characters())}
    pieces = [bytes(byte[c] for c in p) for p in told["model"]["vocab"] if p not in special]
    return build([p for p in pieces if p.startswith(b" ")], [p for p in pieces if b" " not in p], b" ")


def _count(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(sent.value.count)
        for batch in batches:
            split = [t.split() for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([len(ws) for ws in split], pa.int64()),
                 pa.array([sum(map(kept.__getitem__, ws)) for ws in split], pa.int64())],
                names=[*batch.schema.names[:-1], "n_words", "n_tokens"])
    return run


def token_counts(docs: DataFrame, automaton: Automaton, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (by default all but the text) with ``n_words`` and
    ``n_tokens``, which replace columns of these names. The automaton is sent to
    all tasks; its size is the vocabulary's."""
    spark = docs.sparkSession
    prepare(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text_col, "n_words", "n_tokens")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens")])
    return (docs.select(*keep, utf8(text_col).alias(spare(docs, "_text")))
                .mapInArrow(_count(spark.sparkContext.broadcast(automaton)), schema))
