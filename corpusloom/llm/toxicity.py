"""Toxicity by compression distance: two zstandard dictionaries, and which of them makes a window shorter."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from .labelled import kept, labelled_sample, logistic, scored

THRESHOLD = 0.5
#: At most so many labelled texts of each kind are learnt from.
SAMPLE = {1: 2_000, 0: 4_000}
#: Bytes of a window: whole words until it has so many. Under 64 bytes zstandard stores what it
#: can't match byte by byte, so a length tells how much of a window the dictionary holds.
WINDOW = 12
LONGEST_WORD = 40
TOXIC_DICT, ORDINARY_DICT = 4_096, 32_768
#: The ordinary dictionary is trained on at most so many words, a seeded choice from all ordinary texts of the sample.
ORDINARY_WORDS = 60_000
#: Length of the byte strings whose document frequencies say which words of toxic texts are typical.
GRAM = 6
MIN_MATCH = 6
SHORTEST_SAMPLE = 8
LEAST_DEVIATES = 7.0
LEAST_DOCS = 4
#: Every window begins with this and both dictionaries end with it: the first match's fixed cost is then the same.
CARRIER = bytes(range(1, 25))
KEPT_WINDOWS = 200_000
#: The sample's texts are in so many folds: a text's gains are weighed under dictionaries that its fold did not train.
FOLDS = 2
FEATURES = 8


def words(text: str) -> list[bytes]:
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if any(len(w) > LONGEST_WORD for w in found):
        found = [w[i : i + LONGEST_WORD] for w in found for i in range(0, len(w), LONGEST_WORD)]
    return found


def windows(text: str) -> list[bytes]:
    """The whole text in windows of whole words, a space at either end."""
    out, now, n = [], [], 0
    for w in words(text):
        now.append(w)
        n += len(w) + 1
        if n >= WINDOW:
            out.append(b" %b " % b" ".join(now))
            now, n = [], 0
    if now:
        out.append(b" %b " % b" ".join(now))
    return out


def _grams(text: str) -> set[bytes]:
    padded = {b" %b " % w for w in words(text)}
    return {w[i : i + GRAM] for w in padded for i in range(len(w) - GRAM + 1)}


def _typical(toxic: list[str], ordinary: list[str]) -> set[bytes]:
    """Byte strings in many more toxic texts than ordinary ones, by the deviates of the two shares."""
    ours = Counter(g for x in toxic for g in _grams(x))
    ours = {g: n for g, n in ours.items() if n >= LEAST_DOCS}
    theirs = Counter(g for x in ordinary for g in _grams(x) & ours.keys())
    a, b = len(toxic), len(ordinary)
    found = set()
    for g, n in ours.items():
        share = (n + theirs[g]) / (a + b)
        if n / a - theirs[g] / b >= LEAST_DEVIATES * (share * (1 - share) * (1 / a + 1 / b)) ** 0.5 > 0:
            found.add(g)
    return found


def _train(size: int, samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=6).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform samples to choose from: they are the dictionary
        return b"".join(dict.fromkeys(samples))[-size:] or b" " * 8


def _length(content: bytes) -> Callable[[bytes], int]:
    """Compressed bytes of a window under a dictionary of this content."""
    content += CARRIER
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(3, min_match=MIN_MATCH, strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_checksum=False, write_dict_id=False, source_size=64, dict_size=len(content))
    held.precompute_compress(compression_params=how)
    compress = zstandard.ZstdCompressor(compression_params=how, dict_data=held).compress
    return lambda w: len(compress(CARRIER + w))


@dataclass(frozen=True)
class ToxicityModel:
    """Both dictionaries, and the weights that turn a text's window gains into a probability."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    dev: np.ndarray
    weights: np.ndarray

    def scorer(self) -> Callable[[list[str]], np.ndarray]:
        gains = _gains(self.toxic, self.ordinary)

        def score(some: list[str]) -> np.ndarray:
            x = np.array([summary(gains(t)) for t in some]).reshape(-1, FEATURES)
            z = np.c_[(x - self.mean) / self.dev, np.ones(len(x))] @ self.weights
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return score


def _gains(toxic: bytes, ordinary: bytes) -> Callable[[str], np.ndarray]:
    """How many bytes shorter the toxic dictionary makes each window of a text than the ordinary one."""
    short, long, seen = _length(toxic), _length(ordinary), {}

    def gains(text: str) -> np.ndarray:
        if len(seen) > KEPT_WINDOWS:
            seen.clear()
        out = []
        for w in windows(text):
            if (g := seen.get(w)) is None:
                g = seen[w] = long(w) - short(w)
            out.append(g)
        return np.array(out, float)

    return gains


def summary(gains: np.ndarray) -> list[float]:
    """What a text's windows say together: the highest gains, and how dense the gains are."""
    n = len(gains)
    if not n:
        return [0.0] * FEATURES
    top = np.sort(gains)[::-1][:4]
    over = np.maximum(gains - 1, 0)
    return [top[0], top[:2].sum() if n > 1 else top[0] - 3, top.sum(), over.sum() / n**0.5, over.mean(), np.log(n), np.log1p(over.sum()), (gains >= 3).mean()]


def dictionaries(toxic: list[str], ordinary: list[str], chosen: np.random.Generator, ordinary_words: int = ORDINARY_WORDS) -> tuple[bytes, bytes]:
    """One trained on the parts of toxic texts that are typical of them, one on words of the ordinary texts.

    The ordinary dictionary's words are a seeded choice of at most `ordinary_words` from all ordinary texts.
    """
    typical = _typical(toxic, ordinary)

    def passage(word: bytes) -> bytes:
        """The part of a word from its first typical string to its last, at least as long as the trainer takes."""
        at = [i for i in range(len(word) - GRAM + 1) if word[i : i + GRAM] in typical]
        if not at:
            return b""
        to = max(at[-1] + GRAM, min(len(word), at[0] + SHORTEST_SAMPLE))
        return word[min(at[0], max(0, to - SHORTEST_SAMPLE)) : to]

    ours = [p for x in toxic for w in words(x) if (p := passage(b" %b " % w))] or [b" %b " % w for x in toxic for w in words(x)]
    seen: dict[bytes, bytes] = {}

    def plain(word: bytes) -> bytes:
        """The padded word, one object however often it comes; nothing where a part of it is typical."""
        if (p := seen.get(word)) is None:
            p = b" %b " % word
            p = seen[word] = b"" if passage(p) else p
        return p

    theirs = [p for x in ordinary for w in sorted(set(words(x))) if (p := plain(w))] or [b" "]
    theirs = [theirs[i] for i in np.sort(chosen.choice(len(theirs), min(len(theirs), ordinary_words), replace=False))]
    return _train(TOXIC_DICT, ours), _train(ORDINARY_DICT, theirs)


def fit(rows: pd.DataFrame, seed: int = 7, ordinary_words: int = ORDINARY_WORDS) -> ToxicityModel:
    """rows: text, y (1 toxic). Without both kinds every text gets the share of toxic rows as its score.

    How gains turn into a score is fitted on each text's gains under dictionaries trained on the other
    folds, which training did not raise; the model's dictionaries are trained on all texts.
    """
    y = rows["y"].to_numpy(float)
    chosen = np.random.default_rng(seed)
    toxic, ordinary = (list(dict.fromkeys(rows["text"][y == k])) for k in (1, 0))  # copies count once
    if not toxic or not ordinary:
        share = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 99.5))
        return ToxicityModel(b" " * 8, b" " * 8, np.zeros(FEATURES), np.ones(FEATURES), np.r_[np.zeros(FEATURES), share])
    made = dictionaries(toxic, ordinary, chosen, ordinary_words)
    apart = [[x[i] for i in chosen.permutation(len(x))] for x in (toxic, ordinary)]
    found, of = [], []
    for fold in range(FOLDS if min(map(len, apart)) >= FOLDS else 1):
        train = [[t for i, t in enumerate(x) if i % FOLDS != fold] or x for x in apart]
        gains = _gains(*dictionaries(*train, chosen, ordinary_words))
        for kind, x in zip((1.0, 0.0), apart):
            mine = [t for i, t in enumerate(x) if i % FOLDS == fold] if len(x) >= FOLDS else x
            found += [summary(gains(t)) for t in mine]
            of += [kind] * len(mine)
    return ToxicityModel(*made, *calibrate(np.array(found), np.array(of)))


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A logistic regression whose constant is set so that 0.5 is the cut with the fewest errors on these rows."""
    mean, dev, w = logistic(x, y)
    z = np.c_[(x - mean) / dev, np.ones(len(x))] @ w
    order = np.argsort(-z, kind="stable")
    right = np.cumsum(2 * y[order] - 1)
    right[np.r_[z[order][1:] == z[order][:-1], False]] = -len(y)  # no cut between equals
    best = int(np.argmax(right))
    cut = z[order][best] if best + 1 == len(y) else (z[order][best] + z[order][best + 1]) / 2
    w[-1] -= cut
    return mean, dev, w


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> ToxicityModel:
    return fit(labelled_sample(docs, labels, "toxic", sample))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: toxic), predicted (score >= threshold) for every whole text.

    Learnt from at most `sample` labelled rows, never from held-out ones; scored where the texts
    are, without a shuffle. Null text counts as empty and gets the score of a text without windows.
    Repeated rows are scored as often; a null doc_id is not held out; other columns are not read.
    """
    model = train(docs, labels, sample)
    return scored(docs, model.scorer, threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """The rows of docs, all columns as they are, that toxicity_scores does not call toxic.

    Nulls, empty and very long texts are scored as there; repeated rows stay or go together; a score
    that equals the threshold goes; columns of any name pass through; an empty table gives no rows.
    """
    model = train(docs, labels, sample)
    return kept(docs, model.scorer, threshold, keep=0)
