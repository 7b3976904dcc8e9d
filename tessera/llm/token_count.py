"""Token counts of a unigram vocabulary without making the tokens.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; dynamic programming over the ends of matches carries
the best score and its piece count. Ties go as in the tokenizers library's unigram model: of equal scores the path whose last
piece begins first stays, and an unknown character (only where no single-character piece matches) is tried last. Unknown
characters fall back to one piece per UTF-8 byte, as does the unknown piece's own name beside them.

Words begin at each space, which is written as U+2581 in front of them, and are never joined, so that each different word is
counted once per worker. Scores are multiples of 1 / SCALE: their sums are exact, and ties are real ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

MARK, SCALE, UNKNOWN_PENALTY = "▁", 1024, 10
#: Different words that a worker remembers; beyond it, it begins anew.
MOST_WORDS = 500_000


def pieces_of(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file by id. The score is -ln(id + 1) to the nearest 1 / SCALE, as frequencies fall with rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), -round(SCALE * math.log(i + 1)) / SCALE) for i in range(model.get_piece_size())]


class Counter:
    """Best score (in 1 / SCALE) and piece count of words."""

    def __init__(self, pieces: list[tuple[str, float]], unknown_id: int = 0):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for k, (piece, score) in enumerate(pieces):
            if piece:
                self.automaton.add_word(piece, (len(piece), round(score * SCALE), len(piece.encode()) if k == unknown_id else 0))
        self.automaton.make_automaton()
        self.name = pieces[unknown_id][0]
        self.named = len(self.name.encode())
        self.alphabet = {piece for piece, _ in pieces if len(piece) == 1 and piece != self.name}
        self.unknown = min(round(score * SCALE) for _, score in pieces) - UNKNOWN_PENALTY * SCALE
        self.counts: dict[str, int] = {}
        self.scores: dict[str, int] = {}

    def known(self, word: str) -> tuple[int, int]:
        """viterbi of a word all of whose characters are pieces, and that has no unknown piece's name: nothing in it is unknown."""
        best, count, done = [0] * (len(word) + 1), [0] * (len(word) + 1), 0
        for last, (size, score, _) in self.automaton.iter(word):  # by end, and from the longest to the shortest
            start, end = last + 1 - size, last + 1
            total = best[start] + score
            if end > done or total > best[end]:
                best[end], count[end], done = total, count[start] + 1, end
        return best[-1], count[-1]

    def viterbi(self, word: str) -> tuple[int, int]:
        if self.alphabet.issuperset(word) and (not self.name or self.name not in word):
            return self.known(word)
        n = len(word)
        best, count = [0] * (n + 1), [0] * (n + 1)
        lone, run = [False] * (n + 1), [False] * (n + 1)  # what ends here is the unknown piece's own name alone, or unknown
        done, high, number, single, by = 0, None, 0, False, 0

        def unknown(start: int, end: int, name: bool) -> None:
            """Count what is unknown: with what is unknown before it, it falls back to bytes; only a name alone is one piece."""
            if name and not lone[start] and not run[start]:
                count[end], lone[end] = count[start] + 1, True
            else:
                size = self.named if name else len(word[start].encode("utf-8", "surrogatepass"))
                count[end], run[end] = count[start] + size + (self.named - 1 if lone[start] else 0), True

        def close() -> None:
            nonlocal done, high
            if high is not None:
                if not single and best[done] + self.unknown > high:
                    best[done + 1] = best[done] + self.unknown
                    unknown(done, done + 1, False)
                else:
                    best[done + 1] = high
                    if by:
                        unknown(done + 1 - by, done + 1, True)
                    else:
                        count[done + 1] = number
                done, high = done + 1, None

        def pass_over(end: int) -> None:  # ends that no piece has
            nonlocal done
            while done < end:
                best[done + 1] = best[done] + self.unknown
                unknown(done, done + 1, False)
                done += 1

        for last, (size, score, name) in self.automaton.iter(word):  # by end, and from the longest to the shortest
            start = last + 1 - size
            if last > done or high is None:
                close()
                pass_over(last)
                high, number, single, by = best[start] + score, count[start] + 1, size == 1, size if name else 0
                continue
            total = best[start] + score
            if total > high:
                high, number, by = total, count[start] + 1, size if name else 0
            single = single or size == 1
        close()
        pass_over(n)
        return best[n], count[n]

    def learn(self, words: set[str]) -> None:
        missing = words.difference(self.counts)
        if len(self.counts) + len(missing) > MOST_WORDS:
            self.counts.clear()
            self.scores.clear()
            missing = words
        for w in missing:
            self.scores[w], self.counts[w] = self.viterbi(MARK + w)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(pieces_of(path))


def words_of(text: str) -> list[str]:
    """What stands after each mark, the text's own or a space's; a text that begins without one gets one."""
    parts = text.replace(" ", MARK).split(MARK)
    return parts[1:] if text[:1] in (" ", MARK) else parts


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, score) of each row of docs(doc_id, text); path: a sentencepiece file with the vocabulary.

    score is the best segmentation's. Null and empty texts have 0 tokens and score 0; texts are counted whole, however long;
    repeated rows stay repeated, and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        know = counter(path)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                split = [words_of(t) if t else [] for t in batch.column("text").slice(lo, 512).to_pylist()]
                know.learn(set().union(*split))
                n = [sum(map(know.counts.__getitem__, words)) for words in split]
                score = [sum(map(know.scores.__getitem__, words)) / SCALE for words in split]
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(lo, 512), "n_tokens": pa.array(n, pa.int64()), "score": pa.array(score, pa.float64())})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(docs, run, "doc_id long, n_tokens long, score double")
