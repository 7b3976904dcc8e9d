"""Whole texts to token ids with the tokenizers library: Arrow splits and numbers words, each different one is looked up once."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import utf8

#: Runs of letters that a worker remembers before it forgets the later half; about 200 bytes each.
MOST_STEMS = 300_000
#: What may stand behind a run of letters and is encoded on its own; an apostrophe isn't among it, as it can join letters.
TAIL = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


def _byte_characters() -> list[str]:
    """Byte-level tokenizers write a byte as a character: itself where it is printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


_SHOWN = {b: c for b, c in enumerate(_byte_characters()) if b != 10}


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _values(column: pa.Array) -> list[bytes]:
    data, at = utf8(column)
    raw, ends = data[at[0] : at[-1]].tobytes(), (at - at[0]).tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class WordEncoder:
    """For tokenizers that never join characters across white space and drop it, as the probe tells.

    Such a tokenizer gives a text the ids of its words, one after the other; and a word of letters with punctuation behind them
    the ids of the letters, and then those of the punctuation.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.stems: dict[bytes, bytes] = {}
        self.others: dict[bytes, bytes] = {}
        probe = "One two,\tthreeé 'tis it's  4five\nÉé ́x <|y|> six."
        if self._ids(probe) != [x for w in probe.encode().split() for x in self._ids(w.decode())]:
            raise ValueError("this tokenizer's ids depend on more than single words")
        # letters can go to the model directly where it takes lower-cased bytes as characters
        self.direct = all([self._ids(w)] == self._stems([w.encode()]) for w in ("One", "Éétés", "straßE", "日本"))
        # (Σ is lower-cased by its place in Python, and İ becomes two characters)
        self.direct = self.direct and all(self._ids("Éa" + t) == self._ids("Éa") + self._ids(t) for t in (*TAIL, ".,", ")!?", "###", "<|"))

    def _ids(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _stems(self, words: list[bytes]) -> list[list[int]]:
        low = "\n".join([w.decode().lower() for w in words])
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(s)] for s in low.encode().decode("latin-1").translate(_SHOWN).split("\n")]

    def _found(self, words: list[bytes], memory: dict[bytes, bytes], ids) -> list[bytes]:
        """Packed ids of each word; those of new words are remembered."""
        if len(memory) > MOST_STEMS:  # frequent words are met first, and stay
            for old in list(memory)[MOST_STEMS // 2 :]:
                del memory[old]
        if new := [w for w in words if w not in memory]:
            memory.update(zip(new, self._packed(ids(new)), strict=True))
        return [memory[w] for w in words]

    def _packed(self, ids: list[list[int]]) -> Iterator[bytes]:
        data, width, at = np.fromiter(chain.from_iterable(ids), self.kind).tobytes(), self.kind.itemsize, 0
        for own in ids:
            end = at + len(own) * width
            yield data[at:end]
            at = end

    def _parts(self, words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        """Each word's two parts as places in a list of packed ids: letters and what stands behind them, or the word and nothing."""
        stem = pc.utf8_rtrim(words, characters=TAIL)
        plain = np.zeros(len(words), bool)
        if self.direct:
            plain = pc.and_not(pc.utf8_is_alpha(stem), pc.match_substring_regex(stem, "[Σİ]")).to_numpy(zero_copy_only=False)
            far = np.flatnonzero(plain & ~pc.string_is_ascii(stem).to_numpy(zero_copy_only=False))
            plain[far] = [unicodedata.is_normalized("NFC", s) for s in stem.take(pa.array(far)).to_pylist()]
        part, packed = np.zeros((len(words), 2), np.int64), [b""]

        def put(column: int, rows: np.ndarray, values: pa.Array, memory, ids) -> None:
            own = values.dictionary_encode()
            part[rows, column] = own.indices.to_numpy() + len(packed)
            packed.extend(self._found(_values(own.dictionary), memory, ids))

        whole = lambda new: [self._ids(w.decode()) for w in new]
        data, at = utf8(words)
        left = np.diff(at) - np.diff(utf8(stem)[1])
        put(0, plain, pc.ascii_lower(stem.filter(pa.array(plain))), self.stems, self._stems)
        put(0, ~plain, words.filter(pa.array(~plain)), self.others, whole)
        tailed = np.flatnonzero(plain & (left > 0))
        ends = np.append(0, np.cumsum(left[tailed]))
        inside = np.arange(ends[-1]) + np.repeat(at[tailed + 1] - ends[1:], left[tailed])
        put(1, tailed, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(tailed), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])]), self.others, whole)
        return part, packed

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the n + 1 offsets of the texts in them."""
        split = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        first = split.offsets.to_numpy()
        words = split.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
        part, packed = self._parts(words.dictionary)
        size = np.fromiter(map(len, packed), np.int64) // self.kind.itemsize
        begin = np.cumsum(size) - size
        part = part[words.indices.to_numpy()].ravel()
        size = size[part]
        end = np.cumsum(size)
        ids = np.frombuffer(b"".join(packed), self.kind)[np.arange(end[-1] if len(end) else 0) + np.repeat(begin[part] - (end - size), size)]
        return ids, np.append(0, end)[2 * (first - first[0])]
