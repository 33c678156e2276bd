"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, decoding of many windows at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Classes of characters that a window is read as: digits, lower case, upper case, white space, line ends, letters
#: beyond ASCII, other controls, and each ASCII punctuation mark by itself.
DIGIT, SMALL, LARGE, SPACE, LINE, BEYOND, CONTROL = range(7)


def _classes() -> np.ndarray:
    table = np.full(129, CONTROL, np.intp)
    mark = CONTROL + 1
    for i in range(128):
        c = chr(i)
        if c.isdigit():
            table[i] = DIGIT
        elif c.isalpha():
            table[i] = SMALL if c.islower() else LARGE
        elif c in "\n\r":
            table[i] = LINE
        elif c in " \t":
            table[i] = SPACE
        elif c.isprintable():
            table[i] = mark
            mark += 1
    table[128] = BEYOND
    return table


#: Width of a state in either direction.
HIDDEN = 6
CLASS = _classes()
CLASSES = int(CLASS.max()) + 1


def read_classes(text: str) -> np.ndarray:
    return CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


@dataclass(frozen=True)
class Tagger:
    """Weights. Gates are piecewise linear: a sigmoid is clip(x/4 + 1/2, 0, 1), a tanh clip(x, -1, 1).

    x: for each direction, the part of the gates' inputs that a class gives (4H x classes, bias
    included); u: the part that the last state gives (4H x H); w, b: tags from both states; a[i, j]:
    from tag i to tag j. Tag 0 is outside of any span.
    """

    x: tuple[np.ndarray, np.ndarray]
    u: tuple[np.ndarray, np.ndarray]
    w: np.ndarray
    b: np.ndarray
    a: np.ndarray

    def emissions(self, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(steps, tags, windows) for windows in columns, the longest first; after a window's end they mean nothing."""
        steps, lanes = codes.shape
        hidden = self.u[0].shape[1]
        live = np.searchsorted(-size, -np.arange(steps), "left")  # windows longer than t, as sizes fall
        out = np.zeros((steps, len(self.b), lanes), np.float32)
        for way in (0, 1):
            x, u, w = _halved(self.x[way], hidden), _halved(self.u[way], hidden, bias=False), self.w[:, way * hidden : (way + 1) * hidden]
            h, c = np.zeros((hidden, lanes), np.float32), np.zeros((hidden, lanes), np.float32)
            z, given = np.empty((4 * hidden, lanes), np.float32), np.empty((4 * hidden, lanes), np.float32)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                n = live[t]
                now, state, cell = z[:, :n], h[:, :n], c[:, :n]
                np.matmul(u, state, out=now)
                now += x.take(codes[t, :n], axis=1, out=given[:, :n] if n < lanes else given, mode="clip")  # faster than a check of each class
                i, f, o, g = (now[k * hidden : (k + 1) * hidden] for k in range(4))
                np.clip(now[: 3 * hidden], 0, 1, out=now[: 3 * hidden])
                np.clip(g, -1, 1, out=g)
                cell *= f
                i *= g
                cell += i
                np.clip(cell, -1, 1, out=state)
                state *= o
                if way == 0:
                    np.matmul(w, state, out=out[t, :, :n])
                else:
                    out[t, :, :n] += w @ state
        out += self.b[:, None]
        return out

    def decode(self, codes: np.ndarray, size: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(window, tag, start, end, score) of the spans on each window's best path; score: how much better than outside."""
        em = self.emissions(codes, size)
        steps, tags, lanes = em.shape
        live = np.searchsorted(-size, -np.arange(steps), "left")
        best, outside = em.copy(), em[0, 0].copy()
        a, top, one = self.a.astype(np.float32), np.empty((tags, lanes), np.float32), np.empty((tags, lanes), np.float32)
        for t in range(1, steps):
            n = live[t]
            before = best[t - 1, :, :n]
            np.add(before[0], a[0][:, None], out=top[:, :n])
            for i in range(1, tags):
                np.add(before[i], a[i][:, None], out=one[:, :n])
                np.maximum(top[:, :n], one[:, :n], out=top[:, :n])
            best[t, :, :n] += top[:, :n]
            outside[:n] += a[0, 0]
            outside[:n] += em[t, 0, :n]
        last = best[size - 1, :, np.arange(lanes)]
        some = np.flatnonzero(last.max(1) > outside)  # elsewhere the path is outside all the way
        if not len(some):
            return []
        tag, path = last[some].argmax(1), np.zeros((steps, len(some)), np.int8)
        for t in range(int(size[some].max()) - 1, -1, -1):
            begun, more = t < size[some], t + 1 < size[some]
            into = best[t][:, some].T + a[:, tag].T
            tag = np.where(more, into.argmax(1), tag)
            path[t] = np.where(begun, tag, 0)
        found = []
        for k, lane in enumerate(some):
            p = path[: size[lane], k]
            edge = np.flatnonzero(np.diff(p, prepend=0, append=0))
            for s, e in zip(edge[:-1], edge[1:]):
                if j := int(p[s]):
                    gain = (em[s:e, j, lane] - em[s:e, 0, lane]).sum() + a[0, j] + a[j, 0] + (e - s - 1) * a[j, j] - (e - s + 1) * a[0, 0]
                    found.append((int(lane), j, int(s), int(e), float(gain)))
        return found


def _halved(m: np.ndarray, hidden: int, bias: bool = True) -> np.ndarray:
    """The rows of the sigmoids' inputs as clip(0, 1) takes them."""
    out = m.astype(np.float32).copy()
    out[: 3 * hidden] *= 0.25
    if bias:
        out[: 3 * hidden] += 0.5
    return out


def untrained(tags: int, hidden: int = HIDDEN, seed: int = 3) -> Tagger:
    draw = np.random.default_rng(seed)
    x = [draw.normal(0, 0.4, (4 * hidden, CLASSES)) for _ in range(2)]
    for m in x:
        m[hidden : 2 * hidden] += 1.5  # cells keep what they hold at first
    u = [draw.normal(0, 0.5 / hidden**0.5, (4 * hidden, hidden)) for _ in range(2)]
    b = np.zeros(tags)
    b[0] = 1.0
    return Tagger(tuple(x), tuple(u), draw.normal(0, 0.5, (tags, 2 * hidden)), b, np.eye(tags) * 1.0)


def _forward(x: np.ndarray, u: np.ndarray, codes: np.ndarray) -> dict[str, np.ndarray]:
    """Gates, cells and states of both directions side by side; codes (2, steps, lanes), the second against the text's order."""
    _, steps, lanes = codes.shape
    n = u.shape[2]
    kept = {k: np.zeros((steps, 2, n, lanes)) for k in ("i", "f", "o", "g", "c", "h", "c0", "h0")}
    h, c = np.zeros((2, n, lanes)), np.zeros((2, n, lanes))
    given = np.stack([x[k][:, codes[k]] for k in (0, 1)]).transpose(2, 0, 1, 3)
    for t in range(steps):
        z = given[t] + u @ h
        gates = np.clip(z[:, : 3 * n] / 4 + 0.5, 0, 1)
        i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.clip(z[:, 3 * n :], -1, 1)
        kept["c0"][t], kept["h0"][t] = c, h
        c = f * c + i * g
        h = o * np.clip(c, -1, 1)
        for k, v in zip("ifogch", (i, f, o, g, c, h)):
            kept[k][t] = v
    return kept


def _backward(u: np.ndarray, kept: dict[str, np.ndarray], dout: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of x and u of both directions, given those of the states (steps, 2, n, lanes)."""
    steps, _, n, lanes = dout.shape
    # what each gate's gradient is multiplied by, for all steps at once
    bent = np.clip(kept["c"], -1, 1)
    linear = {k: ((kept[k] > 0) & (kept[k] < 1)) / 4 for k in "ifo"}
    of_i, of_f, of_o, of_g = kept["g"] * linear["i"], kept["c0"] * linear["f"], bent * linear["o"], kept["i"] * (np.abs(kept["g"]) < 1)
    through, back = kept["o"] * (np.abs(kept["c"]) < 1), u.transpose(0, 2, 1)
    dz = np.zeros((steps, 2, 4 * n, lanes))
    dh, dc = np.zeros((2, n, lanes)), np.zeros((2, n, lanes))
    for t in range(steps - 1, -1, -1):
        dh = dh + dout[t]
        dc = dc + dh * through[t]
        dz[t, :, :n], dz[t, :, n : 2 * n], dz[t, :, 2 * n : 3 * n], dz[t, :, 3 * n :] = dc * of_i[t], dc * of_f[t], dh * of_o[t], dc * of_g[t]
        dc = dc * kept["f"][t]
        dh = back @ dz[t]
    flat = dz.transpose(1, 2, 0, 3).reshape(2, 4 * n, -1)
    dx = np.stack([flat[k] @ np.eye(CLASSES)[codes[k].ravel()] for k in (0, 1)])
    return dx, flat @ kept["h0"].transpose(1, 0, 3, 2).reshape(2, -1, n)


def crf(em: np.ndarray, a: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the gold tags (steps, lanes) and its gradients by emissions and transitions."""
    steps, tags, lanes = em.shape
    ea = np.exp(a)
    alpha, beta = np.empty_like(em), np.zeros_like(em)
    alpha[0] = em[0]
    for t in range(1, steps):
        m = alpha[t - 1].max(0)
        alpha[t] = em[t] + m + np.log(ea.T @ np.exp(alpha[t - 1] - m))
    for t in range(steps - 2, -1, -1):
        y = em[t + 1] + beta[t + 1]
        m = y.max(0)
        beta[t] = m + np.log(ea @ np.exp(y - m))
    m = alpha[-1].max(0)
    z = m + np.log(np.exp(alpha[-1] - m).sum(0))
    lane = np.arange(lanes)
    score = np.take_along_axis(em, gold[:, None], 1).sum((0, 1)) + a[gold[:-1], gold[1:]].sum(0)
    dem = np.exp(alpha + beta - z)
    for t in range(steps):
        dem[t, gold[t], lane] -= 1
    y = em[1:] + beta[1:] - z
    m = y.max(1, keepdims=True)
    m0 = alpha[:-1].max(1, keepdims=True)
    da = ea * np.einsum("tib,tjb->ij", np.exp(alpha[:-1] - m0) * np.exp(m0 + m), np.exp(y - m), optimize=True)
    np.subtract.at(da, (gold[:-1].ravel(), gold[1:].ravel()), 1)
    return float((z - score).mean()), dem / lanes, da / lanes


def loss(model: Tagger, codes: np.ndarray, gold: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The loss of windows of one length, and its gradients by x, u (of both directions), w, b and a."""
    u, ways = np.stack(model.u), np.stack([codes, codes[::-1]])
    kept = _forward(np.stack(model.x), u, ways)
    both = np.concatenate([kept["h"][:, 0], kept["h"][::-1, 1]], 1)
    steps, wide, lanes = both.shape
    flat = both.transpose(1, 0, 2).reshape(wide, -1)
    em = (model.w @ flat).reshape(-1, steps, lanes).transpose(1, 0, 2) + model.b[:, None]
    value, dem, da = crf(em, model.a, gold)
    by_tag = dem.transpose(1, 0, 2).reshape(dem.shape[1], -1)
    dboth = (model.w.T @ by_tag).reshape(2, wide // 2, steps, lanes).transpose(2, 0, 1, 3)
    dx, du = _backward(u, kept, np.stack([dboth[:, 0], dboth[::-1, 1]], 1), ways)
    return value, [*dx, *du, by_tag @ flat.T, dem.sum((0, 2)), da]


def fitted(codes: np.ndarray, gold: np.ndarray, tags: int, hidden: int = HIDDEN, rounds: int = 250, batch: int = 64, rate: float = 0.02, seed: int = 3) -> Tagger:
    """Adam over seeded batches of the windows (steps, windows), its rate falling to nothing."""
    draw, model = np.random.default_rng(seed), untrained(tags, hidden, seed)
    weights = [*model.x, *model.u, model.w, model.b, model.a]
    first, second = ([np.zeros_like(p) for p in weights] for _ in range(2))
    for step in range(1, rounds + 1):
        pick = draw.integers(0, codes.shape[1], batch)
        _, grads = loss(Tagger(tuple(weights[:2]), tuple(weights[2:4]), *weights[4:]), codes[:, pick], gold[:, pick])
        norm = sum(float((g**2).sum()) for g in grads) ** 0.5
        now = rate * (1 - step / (rounds + 1))
        for p, g, m, v in zip(weights, grads, first, second):
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g**2 - v)
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Tagger(tuple(weights[:2]), tuple(weights[2:4]), *weights[4:])
