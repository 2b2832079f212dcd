"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

Tokens are compared by the normalised gap-weighted subsequence kernel, which
tolerates inserted and missing characters. Landmarks are the beginnings and
words that, one after another, account for most labelled toxic texts and hardly
any clean ones. The Nyström map of those landmarks makes the kernel linear, and
a support vector machine with squared hinge is fitted on tokens: of a toxic
text the token nearest to a landmark and others very near, of a clean text its
nearest few. A text's decision is that of its worst token; a sigmoid fitted on the
labelled texts turns it into a score. Letters written apart (``i d i o t``) are
also read together.

The model is fitted on a bounded sample of the labelled rows, ``SAMPLE`` texts
of either label, drawn by a hash of the id; every text is scored whole.

Edge cases: null and empty texts have no token and get the score of none; with
labels of one kind only, or none, every score is that share (0 without labels);
null labels and labels without a document are left out; of several labels of
one id the highest counts; rows of one id are rows of their own; other columns
are kept where asked for, whatever their names (the score's name is a parameter);
an empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm import strings
from tidemark.llm.common import bounded_batches, claim

#: At most about so many labelled texts of each label are learned from.
SAMPLE = 1000
LANDMARKS = 96
#: A landmark accounts for at least so many texts of the sample, and for this share of clean ones at most.
LEAST_TEXTS = 3
#: ... and for at least this share of the toxic ones.
LEAST_SHARE = 0.015
#: A toxic text is accounted for by so many landmarks before the search leaves it.
COVER = 4
CLEAN_SHARE = 0.05
#: Chance, over all beginnings considered, of taking one that has nothing to do with the label.
CHANCE = 0.01
#: Beginnings of tokens that may be landmarks have so many characters; longer tokens are read in windows.
SHORTEST = 4
LONGEST = 24
#: Stands before a token, so that beginnings count.
START = "^"
#: Stands behind a token, so that a beginning alone is not the word.
END = "$"
#: Tokens of toxic texts are also learned with a character put in, with this share of the weight.
DISTURBED = 0.5
#: Tokens of clean texts that are this much like a landmark become landmarks too, the most frequent so many.
ALIKE = 0.5
#: Of a toxic text the token most like a landmark is learned, and others this much like one.
CLEARLY = 0.7
HARMLESS = 48
CACHE_TOKENS = 150_000
#: Texts whose tokens are held at once.
TOGETHER = 128

_SCORERS: dict[bytes, Scorer] = {}

_APART = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")
_MARKS = re.compile(r"[\W_]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def tokens(text: str | None) -> set[str]:
    """The distinct raw tokens of a text: between white space, in lower case, and letters apart read together."""
    if not text:
        return set()
    low = text.lower()
    found = set(low.split())
    for m in _APART.finditer(low):
        found.add("".join(m[0].split()))
    return found


def windows(token: str) -> list[str]:
    """What of a token is compared: without marks at its ends and, besides, without any; in windows if it is long."""
    if token.isalnum():
        cores = [token]
    else:
        core = _EDGES.sub("", token)
        cores = [core] if core.isalnum() else [core, _MARKS.sub("", core)]
    out = []
    for core in cores:
        if 3 <= len(core) <= LONGEST:
            out.append(START + core + END)
        elif len(core) > LONGEST:
            half = LONGEST // 2
            out += [(START if not i else "") + core[i : i + LONGEST] for i in range(0, len(core) - half, half)]
    return out


def disturbed(token: str) -> list[str]:
    """A token with a character put in, at each place."""
    return [token[:i] + "*x1"[i % 3] + token[i:] for i in range(2, len(token.rstrip(END)))]


@dataclass
class Model:
    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: float = -1.0
    slope: float = 0.0
    offset: float = -30.0

    def decide(self, found: list[str]) -> np.ndarray:
        """The decision of each token."""
        parts = [windows(t) for t in found]
        of = np.repeat(np.arange(len(found)), [len(p) for p in parts])
        out = np.full(len(found), self.bias)
        if len(of) and self.landmarks:
            each = strings.similarities([x for p in parts for x in p], self.landmarks) @ self.weights + self.bias
            np.maximum.at(out, of, each)
        return out

    def score(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.offset, -30, 30)))


def landmarks(texts: list[set[str]], toxic: np.ndarray) -> list[str]:
    """Beginnings and words that cover the toxic texts, most still uncovered first."""
    of: dict[str, set[int]] = defaultdict(set)
    clean: dict[str, int] = defaultdict(int)

    def candidates(text: set[str]) -> set[str]:
        return {w[:n] for t in text for w in windows(t) for n in range(SHORTEST + 1, min(len(w.rstrip(END)), 14) + 1)}

    once = {frozenset(texts[i]): int(i) for i in np.flatnonzero(toxic)[::-1]}  # copies speak once
    seen = sorted(once.values())
    count = Counter()
    for i in seen:
        count.update(candidates(texts[i]))
    least = max(LEAST_TEXTS, LEAST_SHARE * len(seen))
    often = {c for c, k in count.items() if k >= least}
    del count
    for i in seen:
        for c in candidates(texts[i]) & often:
            of[c].add(i)
    for i in np.flatnonzero(~toxic):
        for c in candidates(texts[i]):
            if c in of:
                clean[c] += 1
    n, m = max(1, len(seen)), max(1, int((~toxic).sum()))
    base, enough = n / (n + m), math.log(max(1, len(of)) / CHANCE)

    def surprise(c: str) -> float:
        """Of so many texts with c, so many toxic: minus the logarithm of a bound on the chance of that."""
        k, total = len(of[c]), len(of[c]) + clean[c]
        share = k / total
        rest = (1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0.0
        return total * (share * math.log(share / base) + rest) if share > base else 0.0

    of = {c: s for c, s in of.items() if clean[c] / m <= CLEAN_SHARE * len(s) / n and surprise(c) >= enough}
    chosen: list[str] = []
    left = {i: COVER for c in of.values() for i in c}
    while of and len(chosen) < LANDMARKS:
        best = max(of, key=lambda c: (len(of[c]), len(c), c))
        chosen.append(best)
        gone = set()
        for i in of.pop(best):
            left[i] -= 1
            if not left[i]:
                gone.add(i)
        # Other beginnings of the same words say the same.
        of = {c: rest for c, s in of.items() if not (c.startswith(best) or best.startswith(c)) and len(rest := s - gone) >= least}
    return chosen


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge, by Newton's method in the primal; y is -1 or 1."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    keep = np.ones(len(w))
    keep[-1] = 1e-6
    for _ in range(50):
        margin = 1 - y * (x1 @ w)
        on = margin > 0
        grad = keep * w - 2 * c * x1[on].T @ (weight[on] * y[on] * margin[on])
        hess = np.diag(keep) + 2 * c * (x1[on] * weight[on, None]).T @ x1[on]
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def sigmoid(decision: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a sigmoid through decisions, with smoothed targets, by Newton's method."""
    p, n = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (p + 1) / (p + 2), 1 / (n + 2))
    ab = np.array([1.0, 0.0])
    x = np.stack([decision, np.ones(len(decision))], axis=1)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (q - target) + 1e-6 * ab)
        ab -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0]), float(ab[1])


def fit(texts: list[set[str]], toxic: np.ndarray) -> Model:
    """The model of labelled texts, given by their tokens."""
    toxic = np.asarray(toxic, bool)
    share = float(toxic.mean()) if len(toxic) else 0.0
    flat = Model(offset=float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))))
    if not 0 < share < 1:
        return flat
    marks = landmarks(texts, toxic)
    if not marks:
        return flat
    vocabulary = sorted(set().union(*texts))
    parts = [windows(t) for t in vocabulary]
    of = np.repeat(np.arange(len(vocabulary)), [len(p) for p in parts])
    words = [x for p in parts for x in p]
    like = strings.similarities(words, marks)
    nearest = np.zeros(len(vocabulary))
    first = np.full(len(vocabulary), -1)
    top = like.max(1)
    order = np.argsort(top, kind="stable")
    nearest[of[order]], first[of[order]] = top[order], order
    at = {t: i for i, t in enumerate(vocabulary)}
    count: dict[tuple[int, bool], int] = defaultdict(int)
    harmless: Counter[str] = Counter()
    for text, bad in zip(texts, toxic):
        own = sorted((i for t in text if first[i := at[t]] >= 0), key=lambda i: (-nearest[i], i))
        for i in [i for k, i in enumerate(own) if not k or nearest[i] >= CLEARLY] if bad else own[:4]:
            count[int(first[i]), bool(bad)] += 1
            if not bad and nearest[i] >= ALIKE:
                harmless[words[first[i]]] += 1
    # What clean texts often have that looks like a landmark is one too, to be told apart from.
    more = [w for w, k in sorted(harmless.items(), key=lambda x: (-x[1], x[0]))[:HARMLESS] if k >= LEAST_TEXTS and w not in marks]
    marks = marks + more
    if more:
        like = np.hstack([like, strings.similarities(words, more)])
    rows = list(count)
    y = [1.0 if bad else -1.0 for _, bad in rows]
    weight = [float(count[r]) for r in rows]
    features = [like[[i for i, _ in rows]]]
    bad_words = sorted({words[i] for i, bad in rows if bad and top[i] > 0.5})
    odd = [v for w in bad_words for v in disturbed(w)]
    if odd:
        features.append(strings.similarities(odd, marks))
        y += [1.0] * len(odd)
        weight += [DISTURBED * sum(weight) / len(odd)] * len(odd)
    x, y, weight = np.concatenate(features), np.array(y), np.array(weight)
    for side in (-1, 1):
        weight[y == side] /= max(1.0, weight[y == side].sum())
    among = strings.similarities(marks, marks).astype(np.float64)
    among = (among + among.T) / 2
    value, vector = np.linalg.eigh(among)
    root = vector @ np.diag(np.where(value > 1e-6, 1 / np.sqrt(np.maximum(value, 1e-6)), 0)) @ vector.T
    w, bias = svm(x @ root, y, weight * 1000)
    model = Model(marks, root @ w, bias)
    decision = np.full(len(vocabulary), bias)
    np.maximum.at(decision, of, like @ model.weights + bias)
    worst = np.array([max((decision[at[t]] for t in text), default=bias) for text in texts])
    model.slope, model.offset = sigmoid(worst, toxic)
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a sample of labelled rows; the driver gets their distinct tokens."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) > 0).alias("bad"))
    counts = {r["bad"]: r["count"] for r in known.groupBy("bad").count().collect()}
    share = F.when(F.col("bad"), min(1.0, SAMPLE / max(1, counts.get(True, 0)))).otherwise(min(1.0, SAMPLE / max(1, counts.get(False, 0))))
    drawn = known.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < share * 1_000_000)
    # The sample is bounded, and so is what is broadcast.
    rows = docs.select(id_col, text_col).join(F.broadcast(drawn), id_col).select("bad", text_col)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(tokens(x)) for x in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["bad", "tokens"])

    got = rows.mapInArrow(run, "bad boolean, tokens array<string>").toArrow()
    known_words: dict[str, str] = {}  # a word of many texts is held once
    found = []
    for batch in got.to_batches(max_chunksize=64):
        for is_bad, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.append((is_bad, [known_words.setdefault(w, w) for w in words]))
    del got, known_words
    found.sort()  # whatever order tasks end in
    return fit([set(words) for _, words in found], np.array([b for b, _ in found], bool))


class Scorer:
    """Decisions of texts in a Python worker; those of tokens are kept in a bounded cache."""

    def __init__(self, model: Model):
        self.model, self.known, self.old = model, {}, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[self._some(texts[at : at + TOGETHER]) for at in range(0, len(texts), TOGETHER)]])

    def _some(self, texts: list[str | None]) -> np.ndarray:
        found = [tokens(x) for x in texts]
        if len(self.known) > CACHE_TOKENS:
            self.old, self.known = self.known, {}
        new = []
        for t in set().union(*found):
            if t not in self.known:
                if (was := self.old.get(t)) is None:
                    new.append(t)
                else:
                    self.known[t] = was
        for at in range(0, len(new), 1 << 15):
            part = new[at : at + (1 << 15)]
            self.known.update(zip(part, self.model.decide(part).tolist()))
        get = self.known.__getitem__
        return np.array([max(map(get, text), default=self.model.bias) for text in found])


def score(docs: DataFrame, model: Model, *, keep: list[str] | None = None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns ``keep`` of docs (the id by default) and the score, for every row. No shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep or ["doc_id"])], docs[text_col].alias("scored_text"))
    fields = [f for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", _SCORERS)
        key = pickle.dumps(shared.value)
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        scorer = _SCORERS[key]
        for batch in batches:
            *kept, texts = batch.columns
            out = scorer.model.score(scorer(texts.to_pylist()))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.float64())], [*[f.name for f in fields], "score"])

    scored = rows.mapInArrow(run, StructType([*fields, StructField("score", DoubleType())]))
    return scored.toDF(*(keep or ["doc_id"]), score_col)
