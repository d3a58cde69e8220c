"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a token are a word vector (the token without punctuation, in lower case, hashed) and a character vector (the
mean over its hashed character n-grams). Both tables start from the log-odds of their buckets in the training sample.
Tokens are cut into overlapping windows that cover the whole text; two gated recurrent layers read each window in both
directions, an attention over their states pools them, and a linear layer gives the window's logit. A text's score is
the logistic of its highest window's logit, scaled on left-out documents. Training follows the same rule: the windows
that a document's label says most about are those with its highest logits, chosen anew in every epoch.

Null and empty texts have no token; they read as one empty window. Without labelled rows of both classes all scores are
0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumql.llm.common import Lexicon, add_columns, bounded_sample, free_name, gram_buckets, held_out, map_texts

SPAN, STRIDE = 32, 16
HIDDEN, WORD, CHAR = 8, 6, 6
WORD_BUCKETS, CHAR_BUCKETS, GRAMS = 1 << 16, 1 << 15, (3, 4, 5)
#: Bounds of the training sample: documents for each label, and the longest text taken.
PER_LABEL, MOST_CHARS = 1600, 4000
#: Windows in one step of the network, so that memory does not follow the length of a text.
AT_ONCE = 1024
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def tokens_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def window_starts(n: int) -> np.ndarray:
    """First tokens of windows that cover ``n`` tokens, each sharing half with the next."""
    return np.arange(0, max(1, n - SPAN + STRIDE), STRIDE)


def token_buckets(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket of each token; token number and bucket of each character n-gram."""
    words = [EDGES.sub("", token) for token in tokens]
    _, own = gram_buckets(words, (), WORD_BUCKETS)
    owner, grams = gram_buckets(words, GRAMS, CHAR_BUCKETS, whole=False)
    return own, owner, grams


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class ToxicityModel:
    word: np.ndarray
    char: np.ndarray
    gates: list[np.ndarray]  # for each direction: input weights with bias, and state weights, for update, reset, state
    attention: np.ndarray
    out: np.ndarray
    scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    trained: bool = True

    def inputs(self, tokens: list[str]) -> np.ndarray:
        own, owner, grams = token_buckets(tokens)
        return self.inputs_at(own, owner, grams, len(tokens))

    def inputs_at(self, own: np.ndarray, owner: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
        count = np.maximum(1, np.bincount(owner, minlength=n))
        char = np.stack([np.bincount(owner, self.char[grams, k], n) / count for k in range(CHAR)], axis=1) if n else np.zeros((0, CHAR))
        return np.concatenate([self.word[own], char, np.ones((n, 1))], axis=1).astype(np.float32)

    def projections(self, tokens: list[str]) -> np.ndarray:
        """What a token adds to the gates of both directions."""
        x = self.inputs(tokens)
        return np.concatenate([x @ self.gates[0], x @ self.gates[2]], axis=1)

    def lexicon(self) -> Lexicon:
        return Lexicon(self.projections, 200_000)

    def logits(self, projected: np.ndarray, numbers: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Logit of each window: ``numbers`` has its tokens as rows of ``projected``, ``length`` how many count."""
        parts = []
        for i in range(0, len(numbers), AT_ONCE):
            x = projected[numbers[i : i + AT_ONCE].T]
            parts.append(self.forward(x, length[i : i + AT_ONCE])[0])
        return np.concatenate(parts) if parts else np.zeros(0)

    def forward(self, x: np.ndarray, length: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        span, count, _ = x.shape
        inside = (np.arange(span)[:, None] < length[None, :]).astype(np.float32)
        full = bool((length == span).all())
        states = np.empty((span, count, 2 * HIDDEN), np.float32)
        memory: list = [[None] * span, [None] * span]
        half = np.float32(0.5)
        for side, order in ((0, range(span)), (1, range(span - 1, -1, -1))):
            state_weights = self.gates[2 * side + 1]
            h = np.zeros((count, HIDDEN), np.float32)
            for t in order:
                own = x[t, :, 3 * HIDDEN * side : 3 * HIDDEN * (side + 1)]
                turned = h @ state_weights
                zr = own[:, : 2 * HIDDEN] + turned[:, : 2 * HIDDEN]
                zr *= half
                np.tanh(zr, out=zr)
                zr *= half
                zr += half
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                n = r * turned[:, 2 * HIDDEN :]
                n += own[:, 2 * HIDDEN :]
                np.tanh(n, out=n)
                if keep:
                    memory[side][t] = (h, z, r, n, turned[:, 2 * HIDDEN :])
                move = n - h
                move *= 1 - z
                if not full:
                    move *= inside[t][:, None]
                h = h + move
                states[t, :, HIDDEN * side : HIDDEN * (side + 1)] = h
        weight = states @ self.attention
        weight = np.where(inside > 0, weight, np.float32(-1e9))
        weight = np.exp(weight - weight.max(axis=0))
        weight = weight * inside
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        return pooled @ self.out[:-1] + self.out[-1], (x, inside, states, memory, weight, pooled)

    def backward(self, error: np.ndarray, kept: tuple) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Gradients of the projections, the state weights, the attention and the output layer."""
        x, inside, states, memory, weight, pooled = kept
        out = np.append(error @ pooled, error.sum()).astype(np.float32)
        pooled_error = error[:, None] * self.out[:-1]
        dots = (states * pooled_error).sum(axis=2)
        score_error = weight * (dots - (weight * dots).sum(axis=0))
        attention = np.einsum("tn,tnh->h", score_error, states)
        state_error = weight[:, :, None] * pooled_error + score_error[:, :, None] * self.attention
        dx, turns = np.zeros_like(x), []
        for side, order in ((0, range(len(x) - 1, -1, -1)), (1, range(len(x)))):
            u = self.gates[2 * side + 1]
            du, dh = np.zeros_like(u), np.zeros_like(states[0, :, :HIDDEN])
            for t in order:
                h, z, r, n, turned = memory[side][t]
                dh = dh + state_error[t, :, HIDDEN * side : HIDDEN * (side + 1)]
                now = dh * inside[t][:, None]
                dn = now * (1 - z) * (1 - n * n)
                dz = now * (h - n) * z * (1 - z)
                dr = dn * turned * r * (1 - r)
                own = np.concatenate([dz, dr, dn], axis=1)
                dx[t, :, 3 * HIDDEN * side : 3 * HIDDEN * (side + 1)] = own
                through = np.concatenate([dz, dr, dn * r], axis=1)
                du += h.T @ through
                dh = dh - now * (1 - z) + through @ u.T
            turns.append(du)
        return dx, turns, attention, out

    def text_logits(self, texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
        """Highest window logit of each text."""
        found = [lexicon.numbers(tokens_of(text)) for text in texts]
        blank = lexicon[""]
        numbers, length, owner = windows(found, blank)
        if not len(owner):
            return np.zeros(0)
        logits = self.logits(lexicon.rows(), numbers, length)
        return np.maximum.reduceat(logits, np.flatnonzero(np.diff(owner, prepend=-1)))

    def scores(self, texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(texts))
        return logistic(self.scale[0] * self.text_logits(texts, lexicon).astype(np.float64) + self.scale[1])


def windows(found: list[np.ndarray], blank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers, count of tokens, and text of all windows."""
    numbers, length, owner = [], [], []
    place = np.arange(SPAN)
    for i, own in enumerate(found):
        starts = window_starts(len(own))
        padded = np.append(own, np.full(SPAN, blank))
        numbers.append(padded[np.minimum(starts[:, None] + place, len(own))])
        length.append(np.clip(len(own) - starts, 1, SPAN))
        owner.append(np.full(len(starts), i))
    if not found:
        return np.zeros((0, SPAN), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(numbers), np.concatenate(length), np.concatenate(owner)


def log_odds(buckets: np.ndarray, ones: np.ndarray, zeros: np.ndarray, size: int) -> np.ndarray:
    """How much more often a bucket occurs under label 1 than under label 0, in logs; half an occurrence is added to each.

    ``ones`` and ``zeros`` tell how many documents of each label hold what lies in the bucket.
    """
    ones, zeros = np.bincount(buckets, ones, size), np.bincount(buckets, zeros, size)
    share = max(1, ones.sum()) / max(1, zeros.sum())
    return np.log(ones + 0.5) - np.log(zeros * share + 0.5)


def fit(texts: list[str], labels: list[int], epochs: int = 7, rate: float = 0.02, odds: float | None = None, seed: int = 11) -> ToxicityModel:
    """Every fifth document is left out of training to scale the scores; ``odds`` of label 1 where the sample's differ."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    width = WORD + CHAR + 1
    model = ToxicityModel(small(WORD_BUCKETS, WORD) * 0.1, small(CHAR_BUCKETS, CHAR) * 0.1,
                          [small(width, 3 * HIDDEN), small(HIDDEN, 3 * HIDDEN), small(width, 3 * HIDDEN), small(HIDDEN, 3 * HIDDEN)],
                          small(2 * HIDDEN), small(2 * HIDDEN + 1))
    truth = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        model.trained = False
        return model
    # Both classes in the same order of texts, so that the left-out fifth has both.
    fold = np.zeros(len(texts), np.int64)
    for label in (0, 1):
        own = np.flatnonzero(truth == label)
        fold[own] = np.arange(len(own)) % 5
    learn = np.flatnonzero(fold != 4) if min(np.bincount(truth)) >= 5 else np.arange(len(texts))
    lexicon: dict[str, int] = {"": 0}
    found = []
    for i in learn:
        found.append(np.array([lexicon.setdefault(token, len(lexicon)) for token in tokens_of(texts[i])], dtype=np.int64))
    y = truth[learn]
    own, owner, grams = token_buckets(list(lexicon))
    order = np.argsort(owner, kind="stable")
    owner, grams = owner[order], grams[order]
    first = np.searchsorted(owner, np.arange(len(lexicon) + 1))
    # In how many documents of either label each token occurs.
    held = [np.zeros(len(lexicon)), np.zeros(len(lexicon))]
    for label, tokens in zip(y, found):
        held[label][np.unique(tokens)] += 1
    model.word[:, 0] = 0.5 * log_odds(own, held[1], held[0], WORD_BUCKETS)
    model.char[:, 0] = 0.5 * log_odds(grams, held[1][owner], held[0][owner], CHAR_BUCKETS)
    numbers, length, text_of = windows(found, 0)
    positive = y[text_of] == 1
    moments: dict[int, list[np.ndarray]] = {}
    step = 0

    def adam(k: int, value: np.ndarray, slope: np.ndarray) -> None:
        m, v = moments.setdefault(k, [np.zeros_like(value), np.zeros_like(value)])
        m += 0.1 * (slope - m)
        v += 0.01 * (slope * slope - v)
        value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    for epoch in range(epochs):
        inputs = model.inputs_at(own, owner, grams, len(lexicon))
        if epoch == 0:  # before there is a network, the highest log-odds of a token stands for the logit
            logits = inputs[:, 0][numbers].max(axis=1) + inputs[:, WORD][numbers].max(axis=1)
        else:
            logits = model.logits(np.concatenate([inputs @ model.gates[0], inputs @ model.gates[2]], axis=1), numbers, length)
        ranked = np.lexsort((-logits, text_of))
        starts = np.flatnonzero(np.diff(text_of[ranked], prepend=-1))
        place = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.append(starts, len(ranked))))
        chosen = ranked[(place < 1) | ((place < 2) & ~positive[ranked])]
        chosen = np.concatenate([chosen, rng.choice(np.flatnonzero(~positive), min((~positive).sum(), len(chosen) // 4), replace=False)])
        weight = np.where(positive[chosen], 0.5 / max(1, positive[chosen].sum()), 0.5 / max(1, (~positive[chosen]).sum())) * len(chosen)
        for part in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // 96)):
            step += 1
            rows = chosen[part]
            unique, inverse = np.unique(numbers[rows], return_inverse=True)
            inverse = inverse.reshape(len(rows), SPAN)
            count = first[unique + 1] - first[unique]
            local = np.repeat(np.arange(len(unique)), count)
            at = first[unique][local] + np.arange(len(local)) - np.repeat(np.cumsum(count) - count, count)
            x = model.inputs_at(own[unique], local, grams[at], len(unique))
            projected = np.concatenate([x @ model.gates[0], x @ model.gates[2]], axis=1)
            logits_now, kept = model.forward(projected[inverse].transpose(1, 0, 2), length[rows], keep=True)
            error = ((logistic(logits_now) - positive[rows]) * weight[part] / len(rows)).astype(np.float32)
            dx, turns, attention, out = model.backward(error, kept)
            place = inverse.T.reshape(-1)
            order = np.argsort(place, kind="stable")
            flat = np.add.reduceat(dx.reshape(-1, dx.shape[2])[order], np.searchsorted(place[order], np.arange(len(unique))))
            forward, back = flat[:, : 3 * HIDDEN], flat[:, 3 * HIDDEN :]
            input_error = forward @ model.gates[0].T + back @ model.gates[2].T
            for k, (value, slope) in enumerate(((model.gates[0], x.T @ forward), (model.gates[1], turns[0]), (model.gates[2], x.T @ back),
                                                (model.gates[3], turns[1]), (model.attention, attention), (model.out, out))):
                adam(k, value, slope)
            np.subtract.at(model.word, own[unique], rate * 5 * input_error[:, :WORD])
            share = input_error[local, WORD : WORD + CHAR] / np.maximum(1, np.bincount(local, minlength=len(unique)))[local, None]
            for k in range(CHAR):
                model.char[:, k] -= rate * 5 * np.bincount(grams[at], share[:, k], CHAR_BUCKETS)
    rest = np.flatnonzero(fold == 4) if len(learn) < len(texts) else learn
    model.scale = scaled(model.text_logits([texts[i] for i in rest], model.lexicon()), truth[rest])
    if odds:
        model.scale[1] += np.log(odds) - np.log(max(1, truth.sum()) / max(1, (1 - truth).sum()))
    return model


def scaled(logits: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Slope and offset of the logistic that fits labels to logits (Newton steps; targets drawn in a little)."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = logistic(a * logits + b)
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - target) * logits).sum() + 0.01 * (a - 1), (p - target).sum()])
        h = np.array([[(w * logits * logits).sum() + 0.01, (w * logits).sum()], [(w * logits).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        move *= min(1.0, 1.0 / max(1e-9, np.abs(move).max()))
        a, b = a - move[0], b - move[1]
    return np.array([max(a, 1e-3), b])


def train_toxicity_model(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
                         per_label: int = PER_LABEL, most_chars: int = MOST_CHARS) -> ToxicityModel:
    """Fit on labelled rows whose key is not held out: about ``per_label`` for each label, of ``most_chars`` characters at most.

    The sample is chosen by key and label alone; texts are read once, for the chosen keys.
    """
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & ~held_out(F.col("key"))).groupBy("key").agg(F.max("label").alias("label"))
    chosen, counts = bounded_sample(marked, "label", "key", per_label)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.char_length("text") <= most_chars).join(chosen, "key")
    taken = rows.select("key", "label", "text").orderBy("key", "text").limit(4 * per_label).toArrow()
    return fit(taken.column("text").to_pylist(), taken.column("label").to_pylist(), odds=counts.get(1, 0) / max(1, counts.get(0, 0)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with the score of each whole text, and the name that column got."""
    name = free_name(docs, "toxicity")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    lexicon = model.lexicon()

    def step(rows: pa.RecordBatch) -> pa.RecordBatch:
        lexicon.trim()
        scores = model.scores(rows.column(text).to_pylist(), lexicon)
        return add_columns(rows, {name: pa.array(scores, pa.float64())})

    return map_texts(docs, text, step, schema), name


def drop_toxic(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """Rows that score below ``least``, with their own columns."""
    done, name = score_toxicity(docs, train_toxicity_model(docs if learn_from is None else learn_from, labels))
    return done.filter(F.col(name) < least).select(*docs.columns)
