"""Language of a text: the average of hashed subword vectors and a linear softmax, trained by stochastic gradient descent.

Words are runs of letters in lower case; a word's subwords are its character 3- and 4-grams with end marks and the word
itself, each hashed to a bucket of the vector table. A text is the average over all subwords of all its words. Since the
classifier is linear, a trained model keeps one row of class scores for each bucket.

Scores are probabilities after temperature scaling on texts left out of the descent, and on short pieces of them, so that
texts that are told apart without a fault don't make every answer certain. A prediction is *rejected* if its score is too
low, or if too few of the text's subwords are known, that is, were met in training. Both bounds lie midway between what
all but a small share of left-out texts reach (rightly answered ones for the score) and what most of them reach with
their own language left out in turn: the score among the other languages, and the share of subwords known from those.
Where the two overlap, or there are too few languages to leave one out, a bound is the low end of the former. Known
subwords have a hash table of their own, large enough that few fall together by chance.

A null text or one without letters is ``und`` with score 0 and is rejected. An empty training table gives a model that
answers ``und`` for all. Repeated rows are answered alike; a null language or key is not learned from.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumql.llm.common import Lexicon, add_columns, bounded_sample, free_name, gram_buckets, held_out, map_texts

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS, WIDTH, SEEN = 1 << 16, 12, 1 << 20
#: Bounds of the training sample: documents for each language, and the longest text taken.
PER_LANGUAGE, MOST_CHARS = 1500, 20_000
#: Share of left-out texts whose score may lie below the rejection bound, and words of the pieces used for calibration.
REJECTED_SHARE, PIECES = 0.0005, (2, 6, 20)
#: Share of left-out texts, taken without their own language, that lies below what a bound is set against.
FOREIGN_SHARE = 0.9
#: Weight of a score's other classes when the temperature is set.
SMOOTHING = 0.01


def words_of(text: str) -> list[str]:
    """Runs of letters; the pattern also takes numerals that are no digits, which alone make no word."""
    return [word for word in LETTERS.findall(text) if word.isalpha() or any(map(str.isalpha, word))]


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return gram_buckets(words, (3, 4), BUCKETS)


def marks(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The subwords again, as places in the table of those met in training."""
    return gram_buckets(words, (3, 4), SEEN)


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # one row of class scores for each bucket
    bias: np.ndarray
    seen: np.ndarray  # whether a subword at that place was met in training
    temperature: float = 1.0
    bound: float = 1.0  # least score
    known: float = 1.0  # least share of known subwords

    def predict(self, texts: list[str | None], lexicon: Lexicon) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and whether the answer is rejected, for each text."""
        found = [lexicon.numbers(text.lower().split()) if text else None for text in texts]
        rows = lexicon.rows()
        names, values, rejected = [], [], []
        for numbers in found:
            total = rows[numbers].sum(axis=0) if numbers is not None and len(numbers) else None
            if total is None or total[-1] == 0 or not self.languages:
                names.append(UNKNOWN)
                values.append(0.0)
                rejected.append(True)
                continue
            p = softmax((total[:-2] / total[-1] + self.bias) / self.temperature)
            best = int(p.argmax())
            names.append(self.languages[best])
            values.append(float(p[best]))
            rejected.append(bool(p[best] < self.bound or total[-2] / total[-1] < self.known))
        return names, values, rejected

    def lexicon(self) -> Lexicon:
        """Class scores summed over a token's subwords, how many of those are known, and how many there are."""

        def make(tokens: list[str]) -> np.ndarray:
            words, owner = [], []
            for i, token in enumerate(tokens):
                for word in words_of(token):
                    words.append(word)
                    owner.append(i)
            rows = np.zeros((len(tokens), len(self.languages) + 2))
            if words:
                which, buckets = subwords(words)
                token_of = np.array(owner)[which]
                for k in range(len(self.languages)):
                    rows[:, k] = np.bincount(token_of, self.scores[buckets, k], len(tokens))
                which, places = marks(words)
                rows[:, -2] = np.bincount(np.array(owner)[which], self.seen[places], len(tokens))
                rows[:, -1] = np.bincount(token_of, minlength=len(tokens))
            return rows

        return Lexicon(make)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], languages: list[str], epochs: int = 4, rate: float = 0.6, seed: int = 7) -> LanguageModel:
    """Descent over snippets of growing length from each text; every fifth text is left out to set temperature and bound."""
    names = sorted(set(languages))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(SEEN, bool))
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (WIDTH, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    items, left_out, seen = [], [], {}
    for i, (text, language) in enumerate(zip(texts, languages)):
        words = words_of(text.lower())
        if not words:
            continue
        if i % 5 == 4:
            left_out.append((words, names.index(language)))
            continue
        seen.setdefault(names.index(language), np.zeros(SEEN, bool))[marks(words)[1]] = True
        for length in (4, 12, 40):
            start = int(rng.integers(max(1, len(words) - length + 1)))
            items.append((subwords(words[start : start + length])[1], names.index(language)))
    steps = max(1, epochs * len(items))
    for step, k in enumerate(np.concatenate([rng.permutation(len(items)) for _ in range(epochs)]) if items else ()):
        found, label = items[k]
        h = vectors[found].mean(axis=0)
        error = softmax(h @ weights + bias)
        error[label] -= 1
        lr = rate * (1 - step / steps)
        np.subtract.at(vectors, found, (lr / len(found)) * (weights @ error) * 4)
        weights -= lr * np.outer(h, error)
        bias -= lr * 0.1 * error
    every = np.zeros(SEEN, np.uint8)
    for own in seen.values():
        every += own & (every < 2)  # 2 stands for two languages or more
    model = LanguageModel(names, (vectors @ weights).astype(np.float64), bias.astype(np.float64), every > 0)
    calibrate(model, left_out, seen, every, rng)
    return model


def calibrate(model: LanguageModel, left_out: list[tuple[list[str], int]], seen: dict[int, np.ndarray], every: np.ndarray, rng: np.random.Generator) -> None:
    """Temperature from left-out texts and pieces of them, and the two bounds from whole left-out texts and from pieces."""
    logits, labels, whole, own_share, other_share = [], [], [], [], []
    for words, label in left_out:
        for length in (*PIECES, len(words)):
            start = int(rng.integers(max(1, len(words) - length + 1)))
            part = words[start : start + length]
            buckets, places = subwords(part)[1], marks(part)[1]
            logits.append(model.scores[buckets].mean(axis=0) + model.bias)
            labels.append(label)
            whole.append(length == len(words))
            own_share.append(float((every[places] > 0).mean()))
            mine = seen[label][places] if label in seen else np.zeros(len(places), bool)
            other_share.append(float((every[places] > mine).mean()))
    if not labels:
        model.bound = model.known = 0.0  # nothing to calibrate on: nothing but texts without letters is rejected
        return
    logits, labels, whole = np.array(logits), np.array(labels), np.array(whole)
    aim = np.full(logits.shape, SMOOTHING / logits.shape[1])
    aim[np.arange(len(labels)), labels] += 1 - SMOOTHING
    tried = np.geomspace(0.01, 10, 90)
    losses = [-(aim * np.log(softmax(logits / t) + 1e-12)).sum(axis=1).mean() for t in tried]
    model.temperature = float(tried[int(np.argmin(losses))])
    p = softmax(logits / model.temperature)
    right = p.max(axis=1)[whole & (p.argmax(axis=1) == labels)]
    without = logits / model.temperature
    without[np.arange(len(labels)), labels] = -np.inf
    foreign = softmax(without).max(axis=1)[whole] if logits.shape[1] > 2 else np.ones(1)

    def between(own: np.ndarray, other: np.ndarray) -> float:
        """Midway between the low end of ``own`` and the high end of ``other``, if they are apart."""
        low, high = float(np.quantile(own, REJECTED_SHARE)), float(np.quantile(other, FOREIGN_SHARE))
        return (low + high) / 2 if high < low else low

    model.bound = between(right, foreign) if len(right) else 1.0
    model.known = between(np.array(own_share), np.array(other_share) if len(seen) > 1 else np.ones(1))


def train_language_model(docs: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id",
                         per_language: int = PER_LANGUAGE, most_chars: int = MOST_CHARS) -> LanguageModel:
    """Fit on rows whose key is not held out: about ``per_language`` for each language, of ``most_chars`` characters at most."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(language).alias("lang")).filter(
        ~held_out(F.col("key")) & F.col("lang").isNotNull() & (F.char_length("text") <= most_chars))
    taken = bounded_sample(rows, "lang", "key", per_language)[0].orderBy("lang", "key", "text").toArrow()
    return fit(taken.column("text").to_pylist(), taken.column("lang").to_pylist())


def predict_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with predicted language, score and rejection, and the names those columns got (clashing names grow)."""
    names = {k: free_name(docs, k) for k in ("lang_pred", "lang_score", "lang_rejected")}
    schema = T.StructType([*docs.schema.fields, T.StructField(names["lang_pred"], T.StringType()),
                           T.StructField(names["lang_score"], T.DoubleType()), T.StructField(names["lang_rejected"], T.BooleanType())])
    lexicon = model.lexicon()

    def step(rows: pa.RecordBatch) -> pa.RecordBatch:
        lexicon.trim()
        languages, scores, gone = model.predict(rows.column(text).to_pylist(), lexicon)
        return add_columns(rows, {names["lang_pred"]: pa.array(languages, pa.string()), names["lang_score"]: pa.array(scores, pa.float64()),
                                  names["lang_rejected"]: pa.array(gone, pa.bool_())})

    return map_texts(docs, text, step, schema), names


def keep_known_language(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """Rows whose language is predicted and not rejected, with their own columns."""
    model = train_language_model(docs if learn_from is None else learn_from)
    done, names = predict_language(docs, model)
    return done.filter(~F.col(names["lang_rejected"])).select(*docs.columns)
