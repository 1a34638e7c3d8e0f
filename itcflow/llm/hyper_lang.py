"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code
point. An n-gram is bound into one vector: its letters' vectors, the first
turned ``n - 1`` places, the next one place less, multiplied element by
element. A text's vector is the sum (bundle) of its n-grams' vectors, a
language's prototype the sum over its training texts. The answer is the
prototype with the largest cosine.

Texts are lower-cased; each run of other characters than letters counts as one
blank, also before the first and after the last letter. Null texts and texts
without a letter are ``und`` with score 0. Ties go to the smaller language.
Sums are of integers, so a run's result doesn't depend on the order of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, spare, tidy
from .dartminhash import mix

DIM = 1024
N = 3
UNKNOWN = "und"

#: Code points handled in one numpy call, and n-gram vectors a worker keeps (as bytes;
#: an eighth of them at a time as floats).
BLOCK, KEPT = 1 << 19, 20_000

_BITS = 21  # of a code point
_BLANK = 32


class Profiles:
    """The n-grams of texts and their vectors."""

    def __init__(self, dim: int = DIM, n: int = N):
        self.dim, self.n = dim, n
        self.letter = np.zeros(0x110000, np.int8)  # 0: not looked up, 1: letter, -1: other
        self.row: dict[int, int] = {}
        self.vectors = np.zeros((KEPT, dim), np.int8)

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        new = np.unique(codes[self.letter[codes] == 0])
        for c in new:
            self.letter[c] = 1 if chr(c).isalpha() else -1
        return self.letter[codes] == 1

    def _symbols(self, text: str, before: np.ndarray, last: bool) -> np.ndarray:
        """The letters of a text after the symbols ``before``, other runs as one blank."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        codes = np.concatenate([before, np.where(self._letters(codes), codes, _BLANK), [_BLANK] * last]).astype(np.int64)
        return codes[np.concatenate([[True], (codes[1:] != _BLANK) | (codes[:-1] != _BLANK)])]

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of a whole text (their code points, 21 bits each) and
        their counts, block by block; none if it has no letter."""
        parts, at, before = [], 0, np.array([_BLANK])
        while at < len(text):
            end = min(len(text), at + BLOCK)
            while end < len(text) and text[end].isalpha():  # a block ends with a word
                end += 1
            symbols = self._symbols(text[at:end], before, end == len(text))
            grams = np.zeros(max(0, len(symbols) - self.n + 1), np.uint64)
            for i in range(self.n):
                grams = (grams << np.uint64(_BITS)) | symbols[i:i + len(grams)].astype(np.uint64)
            parts.append(np.unique(grams, return_counts=True))
            before, at = symbols[len(symbols) - min(len(symbols), self.n - 1):], end
        if len(parts) == 1:
            return parts[0]
        if not parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        every, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return every, np.bincount(where, np.concatenate([c for _, c in parts]), len(every)).astype(np.int64)

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """One vector of +1 and -1 for each n-gram."""
        out = np.ones((len(grams), self.dim), np.int8)
        words = np.arange(self.dim // 64, dtype=np.uint64)
        for i in range(self.n):
            code = (grams >> np.uint64(_BITS * (self.n - 1 - i))) & np.uint64((1 << _BITS) - 1)
            seen, at = np.unique(code, return_inverse=True)
            bits = mix(mix(seen + np.uint64(1))[:, None] + words[None, :] * np.uint64(0x9E3779B97F4A7C15))
            sign = np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1).astype(np.int8) * 2 - 1
            out *= np.roll(sign, self.n - 1 - i, axis=1)[at]
        return out

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of distinct n-grams, kept for the next call."""
        if len(grams) > KEPT:
            return self.bind(grams).astype(np.float32)
        keys = grams.tolist()
        new = [g for g in keys if g not in self.row]
        if len(self.row) + len(new) > KEPT:
            self.row.clear()
            new = keys
        if new:
            lo = len(self.row)
            self.vectors[lo:lo + len(new)] = self.bind(np.array(new, np.uint64))
            self.row.update(zip(new, range(lo, lo + len(new)), strict=True))
        return self.vectors[[self.row[g] for g in keys]].astype(np.float32)

    def bundle(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The vector of each text, whole numbers as float64."""
        every, at = np.unique(np.concatenate([g for g, _ in counted]), return_inverse=True)
        out = np.zeros((len(counted), self.dim))
        doc = np.repeat(np.arange(len(counted)), [len(g) for g, _ in counted])
        times = np.concatenate([c for _, c in counted])
        for lo in range(0, len(every), KEPT // 8):
            part = every[lo:lo + KEPT // 8]
            m = np.zeros((len(counted), len(part)), np.float32)
            inside = (at >= lo) & (at < lo + len(part))
            m[doc[inside], at[inside] - lo] = times[inside]
            out += m.astype(np.float64) @ self.of(part) if times.max(initial=0) > 10_000 else m @ self.of(part)
        return out


@dataclass
class LanguageModel:
    """Prototypes by language: at most a few thousand rows of ``dim`` numbers."""

    langs: list[str]
    prototypes: np.ndarray
    dim: int = DIM
    n: int = N


def _sums(dim: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, total = Profiles(dim, n), {}
        for batch in batches:
            by_lang: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, times = profiles.counts(text)
                by_lang.setdefault(lang, []).append((grams, times))
            for lang, parts in by_lang.items():
                every, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                times = np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)
                if len(every):
                    total[lang] = total.get(lang, 0) + profiles.bundle([(every, times)])[0]
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total)), pa.array([np.rint(v).astype(np.int64) for v in total.values()])],
                names=["lang", "v"])
    return run


def learn(texts: DataFrame, lang_col: str = "lang", text_col: str = "text", dim: int = DIM, n: int = N) -> LanguageModel:
    """Prototypes of the languages of ``texts``. Each task sums its own rows, so
    that one language may hold any share of them; rows without text or language
    don't count. ``dim`` is a multiple of 64, ``n`` at most 3."""
    prepare(texts.sparkSession)
    rows = texts.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).dropna()
    sums = (rows.mapInArrow(tidy(_sums(dim, n)), "lang string, v array<bigint>")
                .select("lang", F.posexplode("v").alias("i", "x"))
                .groupBy("lang", "i").agg(F.sum("x").alias("x"))
                .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("v")))
    found = sorted((r["lang"], r["v"]) for r in sums.collect())
    return LanguageModel([lang for lang, _ in found],
                         np.array([v for _, v in found], float).reshape(len(found), dim), dim, n)


def _answers(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(model.dim, model.n)
        norm = np.linalg.norm(model.prototypes, axis=1, keepdims=True)
        unit = model.prototypes / np.where(norm == 0, 1, norm)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for lo in range(0, len(texts), 64):
                counted = [profiles.counts(t or "") for t in texts[lo:lo + 64]]
                known = [i for i, (g, _) in enumerate(counted) if len(g)]
                if not known or not model.langs:
                    continue
                v = profiles.bundle([counted[i] for i in known])
                length = np.linalg.norm(v, axis=1)
                cos = (v @ unit.T) / np.where(length == 0, 1, length)[:, None]
                best = np.argmax(cos, axis=1)
                for i, b, c in zip(known, best, cos, strict=True):
                    lang[lo + i], score[lo + i] = model.langs[b], min(1.0, max(0.0, c[b]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang), pa.array(score)],
                                             names=[*batch.schema.names[:-1], "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if not given) with ``lang_pred`` and ``score``,
    which replace columns of these names. Only the text decides."""
    prepare(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in keep]
                          + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*keep, F.col(text_col).alias(spare(docs, "_text"))).mapInArrow(tidy(_answers(model)), schema)


def held_out(id_col: str = "doc_id"):
    """The third of the ids that learning leaves out; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_from_documents(docs: DataFrame) -> LanguageModel:
    """The model of the rows that are not held out and carry a language and an id."""
    return learn(docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()))
