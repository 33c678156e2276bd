"""Quality by attention-based multiple-instance learning: a text is the bag of its passages."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .labelled import kept, labelled_sample, scored

THRESHOLD = 0.3
#: At most so many labelled texts of each kind are learnt from.
SAMPLE = {1: 3_000, 0: 1_500}
#: Bytes of a passage; the last one of a text takes what remains.
PASSAGE = 512
#: Bytes whose passages are counted at once, whole passages.
SLICE = 512 * PASSAGE
TRIGRAMS = 256
DISTINCT = 2_048
HIDDEN, ATTENTION = 24, 12
EPOCHS, BATCH, RATE, DECAY = 40, 64, 4e-3, 1e-4
_KINDS = 8


def _kinds() -> np.ndarray:
    """A class for each byte: 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 sentence mark, 6 symbol, 7 not ASCII."""
    of = np.zeros(256, np.int64)
    for c in range(256):
        s = chr(c)
        of[c] = 7 if c > 127 else 1 if s.islower() else 2 if s.isupper() else 3 if s.isdigit() else 4 if s.isspace() else 5 if s in ".,;:'\"-()" else 6 if s.isprintable() else 0
    return of


_OF = _kinds()
WIDTH = TRIGRAMS + _KINDS + 5


def passages(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of numbers for each passage of each text, and each text's number of passages (at least 1).

    A row holds the roots of the shares of hashed byte trigrams, the shares of byte classes, how
    many different trigrams there are, the mean length of words, how far zlib shortens the whole
    text, and the text's and the passage's length. It does not depend on the other texts. Passages
    are counted a slice at a time, so that a long text takes little more than its rows.
    """
    raw = [x.encode("utf-8", "surrogatepass") for x in some]
    count = np.array([max(1, -(-len(r) // PASSAGE)) for r in raw], np.int64)
    whole = np.array([(len(zlib.compress(r, 1)) / (len(r) + 16), np.log1p(len(r)) / 10) for r in raw], np.float32).reshape(-1, 2)
    made, now, held = [], [], 0
    for r in raw:
        for a in range(0, max(1, len(r)), SLICE):
            now.append((r[a : a + SLICE + 2], min(SLICE, len(r) - a)))  # trigrams of a slice's end look ahead
            held += now[-1][1]
            if held >= SLICE:
                made.append(_counts(now))
                now, held = [], 0
    if now:
        made.append(_counts(now))
    rows = np.concatenate(made) if made else np.zeros((0, WIDTH - 2), np.float32)
    return np.c_[rows[:, :-1], np.repeat(whole, count, axis=0), rows[:, -1:]], count


def _counts(slices: list[tuple[bytes, int]]) -> np.ndarray:
    """The rows of some slices (their bytes with what follows, and how many are their own), without what a whole text tells."""
    size = np.array([n for _, n in slices], np.int64)
    count = np.maximum(1, -(-size // PASSAGE))
    flat = np.frombuffer(b"".join(r + b"\0\0"[: max(0, n + 2 - len(r))] for r, n in slices) + b"\0\0", np.uint8).astype(np.int64)
    first = np.cumsum(size + 2) - size - 2
    owner = np.repeat(np.arange(len(slices)), size)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    at = inside + first[owner]
    piece = (np.cumsum(count) - count)[owner] + inside // PASSAGE
    n = int(count.sum())
    mixed = (flat[at] * 961 + flat[at + 1] * 31 + flat[at + 2]) * 2654435761 & 0xFFFFFFFF
    length = np.maximum(np.bincount(piece, minlength=n), 1)[:, None]
    grams = np.bincount(piece * TRIGRAMS + (mixed >> 24), minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    kinds = np.bincount(piece * _KINDS + _OF[flat[at]], minlength=n * _KINDS).reshape(n, _KINDS) / length
    seen = (np.bincount(piece * DISTINCT + (mixed >> 20) % DISTINCT, minlength=n * DISTINCT).reshape(n, DISTINCT) > 0).sum(1, keepdims=True) / np.minimum(length, DISTINCT)
    return np.c_[np.sqrt(grams / length), kinds, seen, 1 / (kinds[:, [4]] + 0.02) / 10, np.log(length) / 10].astype(np.float32)


def in_parts(some: list[str], most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """passages() of some texts at a time, of about `most` characters together or one text."""
    at = 0
    while at < len(some):
        to, n = at, 0
        while to < len(some) and (to == at or n + len(some[to]) <= most):
            n += len(some[to])
            to += 1
        yield passages(some[at:to])
        at = to


@dataclass(frozen=True)
class QualityModel:
    """Weights of the encoder, of the two gates of the attention, and of the classifier."""

    mean: np.ndarray
    dev: np.ndarray
    weights: dict[str, np.ndarray]

    def scorer(self) -> Callable[[list[str]], np.ndarray]:
        def score(some: list[str]) -> np.ndarray:
            made = [_forward(self.weights, (x - self.mean) / self.dev, count)[0] for x, count in in_parts(some)]
            return np.concatenate([np.zeros(0), *made])

        return score

    def attention(self, text: str) -> np.ndarray:
        """The weight of each passage of a text; they sum to 1."""
        x, count = passages([text])
        return _forward(self.weights, (x - self.mean) / self.dev, count)[1]["a"]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The bags' probabilities, and what the gradients need."""
    start = np.cumsum(count) - count
    h = np.tanh(x @ w["encode"] + w["encode0"])
    t, g = np.tanh(h @ w["value"]), _sigmoid(h @ w["gate"])
    e = (t * g) @ w["weigh"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), count))
    a = e / np.repeat(np.add.reduceat(e, start), count)
    bag = np.add.reduceat(a[:, None] * h, start, axis=0)
    p = _sigmoid(bag @ w["judge"] + w["judge0"])
    return p, {"h": h, "t": t, "g": g, "a": a, "bag": bag}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    p, c = _forward(w, x, count)
    start, h, a = np.cumsum(count) - count, c["h"], c["a"]
    dz = (p - y) / len(y)
    dbag = np.repeat(dz[:, None] * w["judge"], count, axis=0)
    da = (dbag * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, start), count))
    dt = de[:, None] * w["weigh"] * c["g"] * (1 - c["t"] ** 2)
    dg = de[:, None] * w["weigh"] * c["t"] * c["g"] * (1 - c["g"])
    dh = (a[:, None] * dbag + dt @ w["value"].T + dg @ w["gate"].T) * (1 - h**2)
    return {"encode": x.T @ dh, "encode0": dh.sum(0), "value": h.T @ dt, "gate": h.T @ dg, "weigh": (c["t"] * c["g"]).T @ de, "judge": c["bag"].T @ dz, "judge0": dz.sum(keepdims=True)}


def fit(rows: pd.DataFrame, seed: int = 11) -> QualityModel:
    """rows: text, y (1 good). Trained by Adam on cross-entropy; one order of steps, so the same rows give the same model."""
    draw = np.random.default_rng(seed)
    shapes = {"encode": (WIDTH, HIDDEN), "encode0": (HIDDEN,), "value": (HIDDEN, ATTENTION), "gate": (HIDDEN, ATTENTION), "weigh": (ATTENTION,), "judge": (HIDDEN,), "judge0": (1,)}
    w = {k: (draw.standard_normal(s) / max(1, s[0]) ** 0.5 if len(s) == 2 or k in ("weigh", "judge") else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    y = rows["y"].to_numpy(np.float32)
    if len(y) == 0 or y.min() == y.max():  # nothing to tell apart: every text gets the share of good rows
        w["judge"][:] = 0
        w["judge0"][:] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return QualityModel(np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), w)
    x, count = (np.concatenate(z) for z in zip(*in_parts(list(rows["text"]))))
    mean, dev = x.mean(0), x.std(0) + 1e-2
    x = (x - mean) / dev
    start = np.cumsum(count) - count
    m, v, step = ({k: np.zeros_like(z) for k, z in w.items()} for _ in "mv"), None, 0
    m, v = m
    for epoch in range(EPOCHS):
        order = draw.permutation(len(y))
        rate = RATE * (0.5 + 0.5 * np.cos(np.pi * epoch / EPOCHS))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            at = np.concatenate([np.arange(start[j], start[j] + count[j]) for j in some])
            step += 1
            for k, d in _gradients(w, x[at], count[some], y[some]).items():
                d = d + DECAY * w[k] * (k not in ("encode0", "judge0"))
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return QualityModel(mean, dev, w)


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> QualityModel:
    return fit(labelled_sample(docs, labels, "quality", sample))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: good), predicted (score >= threshold) for every whole text.

    Learnt from at most `sample` labelled rows, never from held-out ones; scored where the texts
    are, without a shuffle, long ones a slice at a time. Null text counts as empty: one passage without
    bytes. Repeated rows are scored as often; a score that equals the threshold is predicted 1; a null
    doc_id is not held out; other columns are not read; an empty table gives no rows.
    """
    return scored(docs, train(docs, labels, sample).scorer, threshold)


def without_poor(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """The rows of docs, all columns as they are, that quality_scores calls good.

    Nulls, empty and very long texts are scored as there; repeated rows stay or go together; a score
    that equals the threshold stays; columns of any name pass through; an empty table gives no rows.
    """
    return kept(docs, train(docs, labels, sample).scorer, threshold, keep=1)
