"""Token ids of whole texts with a tokenizer file, at the rate a corpus needs.

The tokenizer of ``word_bpe_49k.json`` drops white space and never merges
across it, so a text's ids are those of its blank-separated chunks, one after
the other. A worker keeps the ids of chunks and words it has met. New chunks of
Latin letters, digits and ASCII signs are cut by the file's own pattern and
each word goes to the file's merges once; all other chunks, and those that hold
one of the file's added tokens (``<|endoftext|>``), go through the whole
tokenizer. For a column of texts, Arrow cuts and numbers the chunks, so that Python
sees each of them once a block; new ones are cut into words all together.
``tests/llm`` holds the ids against ``encode`` on whole texts.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of one generation of a worker's memory, and bytes of their keys and
#: values; two generations are kept. A short entry takes some 150 bytes as Python
#: objects, and workers that wait for a task keep theirs, so that a few hold it at once.
MOST, MOST_BYTES = 200_000, 32 << 20
#: Packs up to 31 ids as little-endian unsigned 32-bit numbers.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
#: Longer keys are worked out each time and not kept: in texts without blanks a
#: chunk is a paragraph, and hardly any comes twice.
LONGEST = 64
#: Bytes of texts worked on at once (one text at least): bounds memory where texts are long.
BLOCK_BYTES = 4 << 20

# Letters whose lower case is one character and that never combine with a neighbour.
_LETTER = "a-zA-ZÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[{_LETTER}!-~]+")
# A word, and signs that end a clause: the split pattern makes one or two words of it.
_SIMPLE = re.compile(f"([{_LETTER}]+)([.,;:!?]*)")
# The split pattern of the tokenizer file, over the plain characters and blanks between chunks.
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9 ]+| ")
# Stands between the ids of two chunks; no id of a file is as high.
_BETWEEN = b"\xff\xff\xff\xff"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level files."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class Kept(dict):
    """Key -> value by ``make``; old entries go when two generations are full.
    Both count entries and bytes, so memory has a bound whatever the texts."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old, self.bytes = make, {}, 0

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= MOST or self.bytes >= MOST_BYTES:
            self.forget(self)
        self[key] = value
        self.bytes += 4 * len(key) + (len(value) if isinstance(value, bytes) else 8)
        return value

    def many(self, keys: list, make_all) -> list:
        """The values, bytes, of distinct keys; ``make_all`` makes those of all new keys at once."""
        out = list(map(self.get, keys))
        absent = [i for i, value in enumerate(out) if value is None]
        if absent:
            new = [keys[i] for i in absent]
            values = list(map(self.old.get, new))
            made = iter(make_all([key for key, value in zip(new, values) if value is None]))
            values = [next(made) if value is None else value for value in values]
            for i, value in zip(absent, values):
                out[i] = value
            self._keep(new, values)
        return out

    def _keep(self, keys: list, values: list[bytes]) -> None:
        if max(map(len, keys)) > LONGEST:
            short = [len(key) <= LONGEST for key in keys]
            keys, values = list(compress(keys, short)), list(compress(values, short))
        step = min(1024, MOST)
        for at in range(0, len(keys), step):
            some, theirs = keys[at:at + step], values[at:at + step]
            size = 4 * sum(map(len, some)) + sum(map(len, theirs))
            if len(self) + len(some) > MOST or self.bytes + size > MOST_BYTES:
                self.forget(self)
            self.update(zip(some, theirs))
            self.bytes += size

    def forget(self, but: dict | None = None) -> None:
        """Starts anew, with no entry, or with an old generation only."""
        self.old = dict(but or {})
        self.clear()
        self.bytes = 0


class TokenIds:
    """Ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)", re.I)
        self.model = self.tokenizer.model
        self.shown = dict(enumerate(byte_characters()))
        self.words = Kept(self._word)
        self.chunks = Kept(self._chunk)

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.shown)
        ids = [t.id for t in self.model.tokenize(shown)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """``_word`` of each of them."""
        return list(map(self._word, words))

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        simple = _SIMPLE.fullmatch(text) if len(text) < 200 else None
        if simple:
            word, sign = simple.groups()
            return self.words[word.lower()] + self.words[sign] if sign else self.words[word.lower()]
        if len(text) < 200 and _PLAIN.fullmatch(text) and not self.added.search(text):
            return b"".join([self.words[w] for w in _WORDS.findall(text.lower())])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunks(self, chunks: list[bytes]) -> list[bytes]:
        """``_chunk`` of each of them."""
        if not chunks:
            return []
        texts = b" ".join(chunks).decode("utf-8", "replace").split(" ")
        added = self.added.search(" ".join(texts))
        plain = [bool(_PLAIN.fullmatch(t)) and len(t) < 200 and not (added and self.added.search(t)) for t in texts]
        words = _WORDS.findall(" ".join(compress(texts, plain)).lower())
        known = dict.fromkeys(words)
        known.pop(" ", None)
        known = dict(zip(known, self.words.many(list(known), self._words))) | {" ": _BETWEEN}
        ids = iter(b"".join(map(known.__getitem__, words)).split(_BETWEEN))
        return [next(ids) if p else self._chunk(c) for p, c in zip(plain, chunks, strict=True)]

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def of_all(self, texts: pa.BinaryArray) -> Iterator[bytes]:
        """``of`` each text, in order; texts must not be null."""
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, done = 0, 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, done + BLOCK_BYTES, "right")))
            yield from self._block(texts.slice(at, upto - at))
            at, done = upto, int(ends[upto - 1])

    def _block(self, texts: pa.BinaryArray) -> Iterator[bytes]:
        cut = pc.ascii_split_whitespace(texts.view(pa.string()))  # at the bytes that bytes.split() takes
        chunks = cut.values.view(pa.binary()).dictionary_encode()
        known = self.chunks.many(chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), self._chunks)
        size = np.fromiter(map(len, known), np.int64, len(known))
        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(known), [
            None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), pa.py_buffer(b"".join(known))]).take(chunks.indices)
        upto = np.frombuffer(ids.buffers()[1], np.int64)[cut.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        for start, end in zip(upto, upto[1:]):
            yield bytes(data[start:end])

    def forget(self) -> None:
        """Drops the words met so far; the file stays read."""
        self.words.forget()
        self.chunks.forget()


@lru_cache(maxsize=2)
def of_worker(path: str | None = None) -> TokenIds:
    """The tokenizer of a Python worker: its file is read and its words are
    worked out once for all tasks that the worker runs."""
    return TokenIds(path)
