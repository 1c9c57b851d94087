"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel of two words is the sum over common subsequences of three letters, each weighted by ``DECAY`` to the length it
spans in either word, of at most ``SPAN`` letters, divided by the words' norms: inserted or exchanged letters lengthen
or cost some subsequences but leave the others. Marks inside a word are dropped, digits and signs that stand for letters
are read as such, and single letters in a row are read as one word.

Training takes a bounded sample of labelled documents (near copies of one text count once) and labels their sentences:
those of documents labelled clean are clean; of documents labelled toxic those are toxic that hold a word which such
documents hold significantly more often, and the others are left out. A sentence is as toxic as its worst word: the
machine is a multiple-instance one, whose instances are the words of labelled sentences. Every word of a clean sentence
is clean; of a toxic sentence one word, the witness, is toxic. The linear machine is fitted on the Nystroem features of
both, then every toxic sentence takes the word of the highest margin for its witness, and clean sentences that the
machine takes for toxic give their worst words to the clean side; so it goes on for ``ROUNDS``. As the kernel is an
inner product, landmarks and weights fold into one weight per subsequence, so a word is scored in time proportional to
its length. A document's score is a logistic curve, fitted on the training documents, over the margins of the three worst
instances of its sentences (the worst sentences' margins; one sentence may give several).
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlefold.llm.quality import log_binomial_tail

DECAY = 0.6
SPAN = 6
LANDMARKS = 192
#: Rarer words of clean sentences that a machine is fitted on at first, at most.
N_CLEAN = 8000
#: Labelled documents of either label that are fetched for training, at most; the bound on what the driver gathers.
TRAIN_TOXIC, TRAIN_CLEAN = 3000, 6000
KEEP_WORDS = 300_000
SCHEMA = "doc_id long, score double, worst_word string"
_LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")
_SINGLES = re.compile(r"(?<!\S)(?:\w[^\w\s]*\s+){2,}\w(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_CODES = 64  # 0: none, 1-26: a-z, 27-61: other letters, by their number, 62: a word's start, 63: its end
TOP, ROUNDS = 3, 3


def words_of(text: str) -> list[str]:
    low = text.lower()
    found = low.split()
    found += [re.sub(r"\W", "", m) for m in _SINGLES.findall(low)]
    return found


def sentences_of(text: str) -> list[list[str]]:
    """The words of each sentence; sentences end at ``.``, ``!`` or ``?`` before white space, and at line ends."""
    return [words for s in _SENTENCE.split(text) if (words := words_of(s))]


def letters(word: str) -> list[int]:
    """Letter codes between the marks of the word's ends: look-alikes are read as letters, other signs dropped."""
    if any(c.isalpha() for c in word):
        word = word.translate(_LOOKALIKE)
    if not word.isascii():
        word = unicodedata.normalize("NFC", word)
    return [62, *(ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 35 for c in word if c.isalpha()), 63]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Subsequences of three letters: (word number, code of the letters, weight), and each word's norm."""
    coded = [letters(w) for w in words]
    sizes = np.array([len(c) for c in coded], dtype=np.int64)
    flat = np.array([x for c in coded for x in c] + [0] * SPAN, dtype=np.int64)
    owner = np.concatenate([np.repeat(np.arange(len(words)), sizes), np.full(SPAN, -1)])
    n = len(flat) - SPAN
    rows, codes, weights = [], [], []
    for span in range(3, SPAN + 1):
        inside = np.flatnonzero(owner[:n] == owner[span - 1 : span - 1 + n])
        for middle in range(1, span - 1):
            rows.append(owner[inside])
            codes.append((flat[inside] * _CODES + flat[inside + middle]) * _CODES + flat[inside + span - 1])
            weights.append(np.full(len(inside), DECAY**span))
    row, code, weight = np.concatenate(rows), np.concatenate(codes), np.concatenate(weights)
    norm = np.sqrt(np.bincount(row, weight * weight, minlength=len(words)))
    return row, code, weight, np.maximum(norm, DECAY**3)


class Landmarks:
    """Nystroem features of words: their kernel with the landmarks times the root of the landmarks' inverse kernel matrix."""

    def __init__(self, marks: list[str]):
        row, code, weight, norm = features(marks)
        self.codes, column = np.unique(code, return_inverse=True)
        phi = np.zeros((len(marks), len(self.codes)))
        np.add.at(phi, (row, column), weight / norm[row])
        values, vectors = np.linalg.eigh(phi @ phi.T)
        use = values > 1e-6 * values.max()
        self.project = phi.T @ (vectors[:, use] / np.sqrt(values[use]))  # from subsequences to features

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.project.shape[1]))
        for at in range(0, len(words), 1000):
            row, code, weight, norm = features(words[at : at + 1000])
            column = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            known = self.codes[column] == code
            n, k = len(norm), len(self.codes)
            spread = np.bincount(row[known] * k + column[known], (weight / norm[row])[known], minlength=n * k).reshape(n, k)
            out[at : at + n] = spread @ self.project
        return out

    def fold(self, w: np.ndarray) -> np.ndarray:
        """One weight per subsequence: the same margins without landmarks."""
        weights = np.zeros(_CODES**3, np.float32)
        weights[self.codes] = self.project @ w
        return weights


class Model:
    """Margin of a word: ``weights`` of its subsequences over its norm, plus ``bias``. Score of a text: logistic in ``curve``
    over the ``TOP`` worst margins in its sentences; for missing ones stands the margin of a word without subsequences."""

    def __init__(self, weights: np.ndarray, bias: float, curve: np.ndarray | None = None):
        self.weights, self.bias, self.curve = weights.astype(np.float32), bias, curve

    def words(self, words: list[str]) -> np.ndarray:
        row, code, weight, norm = features(words)
        return np.bincount(row, weight * self.weights[code], minlength=len(words)) / norm + self.bias

    def known(self, words: list[str]) -> dict[str, float]:
        return {w: v for part in _parts(words, 20_000) for w, v in zip(part, self.words(part).tolist())}

    @staticmethod
    def margins(sentences: list[list[str]], known: dict[str, float]) -> list[float]:
        return [known[w] for s in sentences for w in s]

    def worst(self, margins: list[float]) -> list[float]:
        return heapq.nlargest(TOP, margins + [self.bias] * (TOP - len(margins)) if len(margins) < TOP else margins)

    def score(self, worst: list[float]) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.curve[:-1] @ np.array(worst) + self.curve[-1], -30, 30))))


def _without_copies(texts: list[str]) -> list[str]:
    """Leave out texts that share one of eight min-hashes of three-word shingles with an earlier one: most likely near copies."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text in texts:
        w = text.lower().split()
        shingles = {" ".join(s) for s in zip(w, w[1:], w[2:])} or {" ".join(w)}
        base = np.array([xxhash.xxh64_intdigest(s, 1) for s in shingles], np.uint64)
        keys = {(k, int((base * np.uint64(2 * k + 0x9E3779B97F4A7C15) >> np.uint64(7)).min())) for k in range(8)}
        if not keys & seen:
            out.append(text)
        seen |= keys
    return out


def fit(toxic: list[str], clean: list[str], seed: int = 7) -> Model | None:
    """The model, or None if no word tells the labels apart. Order of the texts decides which of several copies stays."""
    toxic, clean = _without_copies(toxic), _without_copies(clean)
    if not toxic or not clean:
        return None
    df_toxic = Counter(w for t in toxic for w in set(words_of(t)))
    df_clean = Counter(w for t in clean for w in set(words_of(t)))
    share = len(toxic) / (len(toxic) + len(clean))
    tested = sum(1 for w, k in df_toxic.items() if k >= 3)
    limit = math.log(0.5 / max(1, tested))

    def tail(w: str, k: int) -> float:
        return log_binomial_tail(df_clean[w], k + df_clean[w], 1 - share)

    def tells(w: str, k: int) -> bool:
        return k >= 3 and k > (k + df_clean[w]) * share and len(w) >= 3 and tail(w, k) <= limit

    marked = {w: tail(w, k) for w, k in df_toxic.items() if tells(w, k)}
    toxic_sentences = [s for t in toxic for s in sentences_of(t) if not marked.keys().isdisjoint(s)]
    clean_sentences = [s for t in clean for s in sentences_of(t)]
    if not toxic_sentences or not clean_sentences:
        return None
    rng = np.random.default_rng(seed)
    pick = lambda items, n: [items[i] for i in sorted(rng.choice(len(items), min(len(items), n), replace=False))]
    in_clean = Counter(w for s in clean_sentences for w in set(s))
    common = [w for w, _ in sorted(in_clean.items(), key=lambda x: (-x[1], x[0]))[:2000]]
    good = common + pick(sorted(in_clean.keys() - set(common)), N_CLEAN)
    witness = Counter(min(marked.keys() & set(s), key=lambda w: (marked[w], w)) for s in toxic_sentences)
    features_of = Landmarks(pick(sorted(witness), LANDMARKS // 2) + pick([w for w in good if w not in witness], LANDMARKS // 2))
    for _ in range(ROUNDS):
        bad = sorted(witness)
        z = features_of(bad + good)
        y = np.concatenate([np.ones(len(bad)), -np.ones(len(good))])
        seen = np.array([witness[w] for w in bad] + [1 + in_clean[w] for w in good], dtype=float)
        w, b = _svm(z, y, np.log2(1 + seen) * np.where(y > 0, len(good) / len(bad), 1.0))
        model = Model(features_of.fold(w), b)
        margin = model.known(sorted({w for s in toxic_sentences for w in s} | in_clean.keys()))
        witness = Counter(max(s, key=lambda w: (margin[w], w)) for s in toxic_sentences)
        rest = sorted((w for w in in_clean.keys() - set(good) if margin[w] > -0.5), key=lambda w: (-margin[w], w))
        good = good + rest[:1500]
    known = model.known(sorted(df_toxic.keys() | df_clean.keys()))
    found = [model.worst(model.margins(sentences_of(t), known)) for t in toxic + clean]
    model.curve = _logistic(np.array(found), np.array([1.0] * len(toxic) + [0.0] * len(clean)))
    return model


def _parts(words: list[str], size: int = 500) -> Iterator[list[str]]:
    for at in range(0, len(words), size):
        yield words[at : at + size]


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, c: float = 10.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM, squared hinge, by Newton steps on the primal (the bias is lightly regularised)."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1.0] * z.shape[1] + [1e-3])
    cost = c * cost / len(y)
    for _ in range(rounds):
        on = y * (x @ w) < 1
        xs = x[on] * cost[on, None]
        new = np.linalg.solve(xs.T @ x[on] + ridge * 1e-2, xs.T @ y[on])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients and shift of P(y = 1 | m), lightly regularised Newton steps. No coefficient is left below 0."""
    x, use = np.hstack([m, np.ones((len(m), 1))]), np.ones(m.shape[1] + 1, bool)
    while True:
        w = np.zeros(use.sum())
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x[:, use] @ w, -30, 30)))
            step = np.linalg.solve((x[:, use] * (p * (1 - p))[:, None]).T @ x[:, use] + 0.05 * np.eye(len(w)), x[:, use].T @ (p - y) + 0.05 * w)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        out = np.zeros(len(use))
        out[use] = w
        if (out[:-1] >= 0).all():
            return out
        use[:-1] &= out[:-1] >= 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", n_toxic: int = TRAIN_TOXIC, n_clean: int = TRAIN_CLEAN) -> Model | None:
    """Fit on at most ``n_toxic`` and ``n_clean`` labelled documents, those whose ids hash lowest.

    Null ids, labels and texts are left out; of several labels of one document the largest counts, of several texts the least.
    """
    marks = labels.select(F.col(f"`{id_col}`").alias("lid"), F.col(f"`{label_col}`").alias("y")).where("lid is not null and y is not null").groupBy("lid").agg(F.max("y").alias("y"))
    order = (F.xxhash64("lid"), F.col("lid"))
    some = marks.where("y = 1").orderBy(*order).limit(n_toxic).unionByName(marks.where("y = 0").orderBy(*order).limit(n_clean))
    rows = docs.where(F.col(f"`{text_col}`").isNotNull()).join(F.broadcast(some), F.col(f"`{id_col}`") == F.col("lid")).groupBy("lid", "y").agg(F.min(F.col(f"`{text_col}`")).alias("t")).collect()
    rows.sort(key=lambda r: (r.lid, r.t))
    return fit([r.t for r in rows if r.y == 1], [r.t for r in rows if r.y == 0])


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``score`` (0 to 1) and ``worst_word``. Null texts are empty ones; an empty text scores as words
    without any letter. Without a model every score is 0. No other column is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for b in batches:
            out: list[float] = []
            worst: list[str | None] = []
            block: list[list[list[str]]] = []

            def flush() -> None:
                nonlocal known
                distinct = {w for sentences in block for s in sentences for w in s}
                if len(known) > KEEP_WORDS:
                    known = {w: known[w] for w in distinct & known.keys()}
                known.update(model.known(sorted(distinct - known.keys())))
                for sentences in block:
                    margins = model.margins(sentences, known)
                    out.append(model.score(model.worst(margins)))
                    worst.append(max((w for s in sentences for w in s), key=known.__getitem__, default=None))
                block.clear()

            chars = 0
            for value in b.column(1):
                text = value.as_py() or ""
                if model is None:
                    out.append(0.0)
                    worst.append(None)
                    continue
                block.append(sentences_of(text))
                chars += len(text)
                if chars > 1 << 21:
                    flush()
                    chars = 0
            if block:
                flush()
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.float64()), pa.array(worst, pa.string())], ["doc_id", "score", "worst_word"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, SCHEMA)
