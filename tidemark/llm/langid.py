"""Language identification, words first, with backoff to character n-grams.

A known word has a log frequency in each language. A word the model does not
know is scored by its longest character n-grams: those of ``NGRAMS[0]``
characters that occur in training, or, if none does, those one shorter, down to
single letters. A text's sums over its words decide; the score is the winner's
share after the sums are tempered by the root of the number of words.

The model is fitted on the whole texts of a bounded sample: about ``SAMPLE``
labelled documents drawn by a hash of the id, as many of each language, and all
of a language that has fewer. It knows every word of them.

Edge cases: a null, empty or letterless text is ``und`` with score 0, as is every
text when nothing could be learned; ties go to the language first in the
alphabet; null languages and null ids are not learned from; rows that repeat an
id are rows of their own; columns that are not named, whatever they are called,
are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Cache, bounded_batches, claim

SAMPLE = 8000
NGRAMS = (4, 3, 2, 1)
#: Counts a word needs in training to be known; below, its n-grams speak for it.
KNOWN = 3
#: No word tells for or against a language by more than this (in logarithms of probabilities).
MOST = 6.0

_LETTERS = re.compile(r"[^\W\d_]+")
_MODELS: dict[bytes, Model] = {}


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked (single letters: without)."""
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    def __init__(self, counts: dict[str, dict[str, int]]):
        """counts: of words, by language."""
        self.languages = sorted(counts)
        n = len(self.languages)
        by_word: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        for k, lang in enumerate(self.languages):
            for w, c in counts[lang].items():
                by_word[w][k] += c
        self.words = self._logs({w: c for w, c in by_word.items() if c.sum() >= KNOWN})
        self.grams = {}
        for size in NGRAMS:
            found: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
            for w, c in by_word.items():
                for g in grams(w, size):
                    found[g] += c
            self.grams[size] = self._logs(found)

    def _logs(self, counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Log frequencies in each language, relative to the best; a half is added to every count."""
        if not counts:
            return {}
        total = np.sum(list(counts.values()), axis=0) + 0.5 * len(counts)
        out = {}
        for key, c in counts.items():
            logs = np.log((c + 0.5) / total)
            out[key] = np.maximum(logs - logs.max(), -MOST)
        return out

    def word(self, word: str) -> bytes:
        """The word's scores by language, single precision; empty if it has no letter."""
        if not any(map(str.isalpha, word)):
            return b""
        got = self.words.get(word)
        if got is None:
            for size in NGRAMS:
                known = [s for g in grams(word, size) if (s := self.grams[size].get(g)) is not None]
                if known:
                    got = np.maximum(np.sum(known, axis=0), -MOST)
                    break
            else:
                got = np.zeros(len(self.languages))
        return got.astype(np.float32).tobytes()

    def predict(self, text: str | None, words: Cache) -> tuple[str, float]:
        raw = b"".join(map(words.__getitem__, _LETTERS.findall(text.lower()))) if text and self.languages else b""
        if not raw:
            return "und", 0.0
        each = np.frombuffer(raw, np.float32).reshape(-1, len(self.languages))
        sums = each.sum(0, dtype=np.float64) / np.sqrt(len(each))
        best = int(sums.argmax())
        return self.languages[best], float(1 / np.exp(sums - sums[best]).sum())


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a sample of docs; the driver gets the words of the sample, counted by language."""
    known = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and id is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    share, left, rest = {}, SAMPLE, len(sizes)
    for lang, n in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
        # What small languages leave of their part goes to the others.
        share[lang] = min(1.0, left / rest / n)
        left, rest = left - min(n, left / rest), rest - 1
    spark = docs.sparkSession
    shares = spark.createDataFrame([*share.items()], f"lang {dict(known.dtypes)['lang']}, share double")
    drawn = known.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < 1_000_000 * F.col("share"))
    words = drawn.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).filter("word != ''")
    out: dict[str, dict[str, int]] = defaultdict(Counter)
    for lang, word, count in zip(*[c.to_pylist() for c in words.groupBy("lang", "word").count().toArrow().columns]):
        out[lang][word] = count
    return Model(out)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row. No shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(pickle.dumps((model.languages, model.words, model.grams)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid", _MODELS)
        if shared.value not in _MODELS:
            _MODELS.clear()
            own = Model({})
            own.languages, own.words, own.grams = pickle.loads(shared.value)
            _MODELS[shared.value] = (own, Cache(own.word))
        own, words = _MODELS[shared.value]
        for batch in batches:
            found = [own.predict(x, words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double")
