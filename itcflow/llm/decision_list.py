"""Quality rules as learned decision lists.

Statistics of whole texts (``text_statistics``) and a list of rules learned
from labelled rows (``learn``): sequential covering grows one conjunction of
thresholds at a time on two thirds of the rows (by FOIL's gain), prunes it on
the last third (by precision on what it covers), keeps it if it is right more
often than not there, takes away what it covers and goes on. The rules come out
as one ordered Spark ``CASE`` expression (``verdict``).

Null and empty texts have no words: all statistics are 0, all ratios 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, prepare, spare, utf8

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Labelled rows that a list is learned from, at most.
SAMPLE = 50_000

_CONTINUED = bytes(range(0x80, 0xC0))
_ODD = np.uint64(0x9E3779B97F4A7C15)

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
              "n_lines", "n_upper", "n_digits", "n_distinct_words"]


def repeated_words(ws: list[bytes], n: int = WINDOW) -> int:
    """Words that lie in an ``n``-word window found twice or more in the text."""
    if len(ws) <= n:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in ws], np.int64, len(ws))
    # windows by rank: pairs of (window so far, next word) are numbered again, so that no two different ones meet
    w = ids[:len(ids) - n + 1]
    for i in range(1, n):
        _, w = np.unique(w * len(number) + ids[i:len(ids) - n + 1 + i], return_inverse=True)
    twice = np.bincount(w)[w] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ws) + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + n] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _may_repeat(ws: list[bytes], n: int = WINDOW) -> bool:
    """False only if no window can occur twice: a quick look before the exact count."""
    h = np.fromiter(map(hash, ws), np.int64, len(ws)).view(np.uint64)
    w = h[:len(h) - n + 1].copy()
    for i in range(1, n):
        w = w * _ODD + h[i:len(h) - n + 1 + i]
    w.sort()
    return bool((w[1:] == w[:-1]).any())


def statistics(text: bytes) -> list[int]:
    """The values of ``STATISTICS`` for one text."""
    ws = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    packed = text.translate(None, SPACE)
    word_chars = len(packed.translate(None, _CONTINUED))
    return [len(ws), word_chars, len(packed) - len(packed.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(ws) if len(ws) > WINDOW and _may_repeat(ws) else 0,
            len(lines), len(packed) - len(packed.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
            len(packed) - len(packed.translate(None, b"0123456789")), len(set(ws))]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *[pa.array([r[i] for r in rows], pa.int64()) for i in range(len(STATISTICS))]],
            names=[*batch.schema.names[:-1], *STATISTICS])


def text_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (by default all but the text) with the columns of
    ``STATISTICS``, which replace columns of these names."""
    prepare(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != text_col and c not in STATISTICS]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(s, T.LongType()) for s in STATISTICS])
    return docs.select(*keep, utf8(text_col).alias(spare(docs, "_text"))).mapInArrow(_statistics, schema)


#: Feature -> (numerator, denominator): a rule compares numerator with threshold * denominator.
FEATURES = {"symbols per word": ("n_symbols", "n_words"), "repeated lines": ("n_dup_lines", "n_lines"),
            "repeated words": ("n_repeat_words", "n_words"), "letters per word": ("word_chars", "n_words"),
            "words": ("n_words", None), "words per line": ("n_words", "n_lines"),
            "capitals": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"),
            "distinct words": ("n_distinct_words", "n_words")}


def feature_table(rows: pd.DataFrame) -> np.ndarray:
    out = []
    for num, den in FEATURES.values():
        d = np.ones(len(rows)) if den is None else rows[den].to_numpy(float)
        out.append(np.where(d > 0, rows[num].to_numpy(float) / np.where(d > 0, d, 1), 0.0))
    return np.stack(out, axis=1) if len(rows) else np.empty((0, len(FEATURES)))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool  # value >= threshold, else value < threshold
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(FEATURES).index(self.feature)]
        return v >= self.threshold if self.above else v < self.threshold

    def column(self) -> Column:
        num, den = FEATURES[self.feature]
        v = F.col(num) / F.lit(1.0) if den is None else F.when(F.col(den) > 0, F.col(num) / F.col(den)).otherwise(0.0)
        return v >= self.threshold if self.above else v < self.threshold


@dataclass
class DecisionList:
    """Ordered rules, each a conjunction; what no rule covers gets the default."""

    rules: list[list[Test]] = field(default_factory=list)

    def bad(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for rule in self.rules:
            out |= np.logical_and.reduce([t.holds(x) for t in rule])
        return out

    def verdict(self) -> Column:
        """True: keep. One CASE with the rules in their order."""
        case = None
        for rule in self.rules:
            both = rule[0].column()
            for t in rule[1:]:
                both = both & t.column()
            case = F.when(both, F.lit(False)) if case is None else case.when(both, F.lit(False))
        return F.lit(True) if case is None else case.otherwise(F.lit(True))


def _info(p, n):
    return np.where(p > 0, np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)), -30.0)


def _grow(x: np.ndarray, y: np.ndarray, most: int) -> list[Test]:
    rule, inside = [], np.ones(len(x), bool)
    while len(rule) < most and (y[inside] == 0).any():
        p, n = float(y[inside].sum()), float((1 - y[inside]).sum())
        best = (1e-9, None)
        for f, name in enumerate(FEATURES):
            v, t = x[inside, f], y[inside]
            order = np.argsort(v, kind="stable")
            v, t = v[order], t[order]
            cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(cuts):
                continue
            low_p = np.cumsum(t)[cuts - 1].astype(float)
            low_n = cuts - low_p
            for above, a, b in ((False, low_p, low_n), (True, p - low_p, n - low_n)):
                gain = a * (_info(a, b) - _info(p, n))
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], Test(name, above, float((v[cuts[i]] + v[cuts[i] - 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return rule


def _worth(rule: list[Test], x: np.ndarray, y: np.ndarray) -> float:
    """Share of right rows among those covered, drawn towards one half for few."""
    hit = np.logical_and.reduce([t.holds(x) for t in rule]) if rule else np.ones(len(x), bool)
    return (float(y[hit].sum()) + 1) / (float(hit.sum()) + 2)


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.9, most_tests: int = 4, most_rules: int = 16) -> DecisionList:
    """Rules for the rows marked ``bad`` (1 or 0). A rule must be right on
    ``precision`` of what it covers in the rows it is pruned on, and cover at
    least 5 bad rows of all. Every third row is for pruning."""
    out = DecisionList()
    left = np.ones(len(x), bool)
    third = np.arange(len(x)) % 3 == 2
    while len(out.rules) < most_rules and bad[left & ~third].any():
        rule = _grow(x[left & ~third], bad[left & ~third], most_tests)
        px, py = x[left & third], bad[left & third]
        while len(rule) > 1 and _worth(rule[:-1], px, py) >= _worth(rule, px, py):
            rule = rule[:-1]
        if not rule:
            break
        hit = np.logical_and.reduce([t.holds(x) for t in rule]) & left
        if bad[hit].sum() < 5 or bad[hit].mean() < precision or _worth(rule, px, py) < 0.5:
            break
        out.rules.append(rule)
        left &= ~hit
    return out


def learn_from(labelled: DataFrame, id_col: str, label_col: str, sample: int = SAMPLE, **params) -> DecisionList:
    """A list from rows with the statistics, an id and a label (1 good, 0 bad;
    other labels and null don't count). At most ``sample`` rows are collected:
    if there are more, those whose hash lies under the share that gives so many."""
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(
        F.xxhash64(F.col(id_col).cast("string"), *STATISTICS).alias("h"), F.col(label_col).alias("label"), *STATISTICS)
    share = min(1.0, sample / max(1, rows.count()))
    rows = (rows.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
                .orderBy("h", "label", *STATISTICS).limit(sample).toPandas())
    return learn(feature_table(rows), 1 - rows["label"].to_numpy(np.int64), **params)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
