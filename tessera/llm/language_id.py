"""Language identification with string kernels.

A text's features are the hashed 1- to N-grams of characters that it has at all (blended spectrum, presence), in lower case,
with everything that is no letter as one blank. The kernel of two texts is the number of features in common over the square
root of both numbers. Nystroem: a few training texts are landmarks; a text becomes its kernels to them times the inverse root
of the landmarks' own kernel matrix. On these, one kernel ridge regression per language against the rest is fitted.

Scoring a batch is a product of its presence matrix with the landmarks', scaled, times the weights.

Far from all languages the outputs are near 0 and the score near 0.5, so that it doesn't tell strange texts. These show in the
share of their n-grams that any training text has, counted with repeats so that it doesn't fall with length. The limit comes
from the training texts' own shares, each measured by the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import mapped

#: Longest n-gram; hashed features (a power of two).
LONGEST, FEATURES = 3, 1 << 13
#: Training sample: texts per language, languages, and characters of a text that may be in it. The rest of the labelled rows
#: isn't needed for the fit; every row is predicted.
PER_LANGUAGE, MOST_LANGUAGES, MOST_CHARS = 200, 64, 20_000
LANDMARKS, RIDGE = 128, 1e-2
#: Slots of n-grams known from training; the quantile of the training texts' shares of known n-grams that is still a language's;
#: the part of that share under which a text is strange; n-grams of that share that every text is given, for very short ones.
KNOWN, CLEAN, STRANGE, GIVEN = 1 << 20, 0.05, 0.75, 2
UNDETERMINED = "und"
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point below 0x3000: its lower case where that is one letter, else 0."""
    out = np.zeros(0x3000, np.uint32)
    for c in range(0x3000):
        low = chr(c).lower()
        if chr(c).isalpha():
            out[c] = ord(low) if len(low) == 1 else c
    return out


def code_points(text: str) -> np.ndarray:
    """Lower-case letters of a text as numbers, 0 for all else."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    if not len(c) or int(c.max()) < len(table):
        return table[c]
    far = np.flatnonzero(c >= len(table))
    out = table[np.minimum(c, len(table) - 1)]
    unique, at = np.unique(c[far], return_inverse=True)
    out[far] = np.array([x if chr(x).isalpha() else 0 for x in unique.tolist()], np.uint32)[at]
    return out


def grams(c: np.ndarray) -> Iterator[np.ndarray]:
    """32-bit hashes of c's n-grams, for each n; runs of blanks count as one."""
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c = c[keep]
    h = np.zeros(len(c), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(c) < n:
            return
        h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint32(n)) * _A
        g = h ^ (h >> np.uint32(15))
        yield g * _B


def slots(g: np.ndarray, size: int) -> np.ndarray:
    return g >> np.uint32(32 - size.bit_length() + 1)


def features(c: np.ndarray, row: np.ndarray, known: np.ndarray | None = None) -> tuple[int, int]:
    """Set the places of row that c's n-grams have; returns how many n-grams are known, and how many there are."""
    hits = total = 0
    for g in grams(c):
        row[slots(g, FEATURES)] = 1
        if known is not None:
            hits, total = hits + int(np.count_nonzero(known[slots(g, KNOWN)])), total + len(g)
    return hits, total


class KernelClassifier:
    """Fitted weights; plain arrays, so that it can be broadcast: FEATURES x LANDMARKS + KNOWN bytes and little more."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray, known: np.ndarray, clean: float):
        self.languages, self.landmarks, self.weights, self.known, self.clean = languages, landmarks, weights, known, clean

    @classmethod
    def fit(cls, texts: list[str], labels: list[str]) -> KernelClassifier:
        """Landmarks are the first texts of each language in turn. Texts become features a block at a time."""
        languages = sorted(set(labels))
        of = [[i for i, y in enumerate(labels) if y == language] for language in languages]
        turns = [rows[k] for k in range(max(map(len, of), default=0)) for rows in of if k < len(rows)]
        marks = cls._presence([texts[i] for i in turns[:LANDMARKS]])
        values, vectors = np.linalg.eigh(cls._kernel(marks, marks).astype(np.float64))
        good = values > 1e-6 * max(values.max(initial=0), 1e-12)
        root = vectors[:, good] / np.sqrt(values[good])
        blocks = [cls._kernel(cls._presence(texts[lo : lo + 256]), marks) @ root for lo in range(0, len(texts), 256)]
        z = np.concatenate(blocks) if blocks else np.zeros((0, 0))
        y = np.array([[1.0 if label == language else -1.0 for language in languages] for label in labels])
        w = np.linalg.solve(z.T @ z + RIDGE * len(z) * np.eye(z.shape[1]), z.T @ y) if len(z) else np.zeros((0, 0))
        return cls(languages, marks.astype(np.uint8), (root @ w).astype(np.float32), *cls._known(texts))

    @staticmethod
    def _presence(texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), FEATURES), np.float32)
        for row, text in zip(x, texts, strict=True):
            features(code_points(text), row)
        return x

    @staticmethod
    def _known(texts: list[str]) -> tuple[np.ndarray, float]:
        """Which n-grams the texts have, and the share of known n-grams from which a text is sure to be clean."""
        counts = np.zeros(KNOWN, np.int32)
        for text in texts:
            counts[np.unique(np.concatenate([slots(g, KNOWN) for g in grams(code_points(text))]))] += 1
        shares = []
        for text in texts:
            own = np.concatenate([slots(g, KNOWN) for g in grams(code_points(text))])
            shares.append(np.count_nonzero(counts[own] > 1) / len(own))
        return counts > 0, float(np.quantile(shares, CLEAN)) if len(texts) > 1 else 0.0

    @staticmethod
    def _kernel(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
        size = lambda m: np.sqrt(np.maximum(m.sum(axis=1), 1, dtype=np.float32))
        return (x @ marks.T.astype(np.float32)) / size(x)[:, None] / size(marks.astype(np.float32))[None, :]

    def predict(self, texts: list[str | None], batch: int = 256, judge: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (0 to 1), and, where they are to be judged, whether it is strange to all languages, of each text."""
        names, scores, strange = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        x = np.zeros((min(batch, max(1, len(texts))), FEATURES), np.float32)
        for lo in range(0, len(texts), batch):
            rows = []
            x[:] = 0
            for i, text in enumerate(texts[lo : lo + batch]):
                c = code_points(text) if text else np.zeros(0, np.uint32)
                if c.any():
                    hits, total = features(c, x[i], self.known if judge else None)
                    strange[lo + i] = judge and hits + GIVEN * self.clean < STRANGE * self.clean * (total + GIVEN)
                    rows.append(i)
            if rows and self.languages:
                f = self._kernel(x[rows], self.landmarks) @ self.weights
                for i, k, s in zip(rows, f.argmax(axis=1).tolist(), ((f.max(axis=1) + 1) / 2).clip(0, 1).tolist(), strict=True):
                    names[lo + i], scores[lo + i] = self.languages[k], s
        return names, scores, strange


def training_sample(docs: DataFrame) -> DataFrame:
    """(rank, lang, text): at most PER_LANGUAGE labelled texts a language, and PER_LANGUAGE x MOST_LANGUAGES in all, lowest ranks
    first, so that each of very many languages has some. Ranks are by a hash of the id, texts above MOST_CHARS characters last;
    these are cut there for the fit.

    Learns only from rows whose crc32(doc_id as text) mod 3 is not 1, with a text of letters and a lang.
    """
    rows = docs.where(~F.coalesce("held_out", F.lit(False)) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("doc_id", "lang", (F.length("text") > MOST_CHARS).alias("long"), F.substring("text", 1, MOST_CHARS).alias("text"))
    order = Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id", "text")
    # the limit by rank is applied in each task before rows of a language meet
    picked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PER_LANGUAGE)
    return picked.orderBy("rank", "lang").limit(PER_LANGUAGE * MOST_LANGUAGES).select("rank", "lang", "text")


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit_languages(docs: DataFrame) -> KernelClassifier:
    """A classifier from docs(doc_id, text, lang); the sample that reaches the driver is bounded by the constants above."""
    sample = training_sample(docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))).toPandas()
    sample = sample.sort_values(["rank", "lang", "text"], kind="stable")
    return KernelClassifier.fit(sample["text"].tolist(), sample["lang"].tolist())


def predict_languages(docs: DataFrame, model: KernelClassifier, added: str = "", texts: bool = True, judge: bool = True) -> DataFrame:
    """docs(doc_id, text, ...) with lang_pred, score and, where `judge` is set, strange, whose names begin with `added`; only the text
    is looked at.

    All columns stay, in order, but for those of the same names, and the text where `texts` is false. A null text, or one without
    a letter, is `und` with score 0 and strange; a text of any length is read whole. Where nothing could be learned, every text
    is `und`.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [added + c for c in ("lang_pred", "score", "strange")[: 3 if judge else 2]]
    stay = [c for c in docs.columns if c not in names and (texts or c != "text")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in (whole.slice(lo, 256) for whole in batches for lo in range(0, len(whole), 256)):
            found = sent.value.predict(batch.column("text").to_pylist(), judge=judge)
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.record_batch({**{c: batch.column(c) for c in stay}, **{c: pa.array(v, k) for c, v, k in zip(names, found, kinds)}})

    docs = docs.select(*stay, *([] if texts else ["text"]))
    fields = [f for f in docs.schema.fields if f.name in stay]
    fields += [T.StructField(c, t()) for c, t in zip(names, (T.StringType, T.DoubleType, T.BooleanType))]
    return mapped(docs, run, T.StructType(fields))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of docs(doc_id, text, lang); rows without an id are held out of nothing."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit_languages(docs)
    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return predict_languages(rows, model, texts=False, judge=False).select("doc_id", "held_out", "lang_pred", "score")
