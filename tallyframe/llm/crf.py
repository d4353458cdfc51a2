"""A linear-chain conditional random field over three tags: outside, begin, inside.

A token has a class, a class has features, and a tag's weight for a feature depends on
where the feature stands: at the token itself or at one of its neighbours. Features of
the whole text count once for every token. Fitted by gradient on padded sequences,
decoded by Viterbi.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np

OUTSIDE, BEGIN, INSIDE = range(3)
#: Where neighbours stand that a token looks at, itself first.
OFFSETS = (0, -1, -2, -3, 1)


@dataclass
class Crf:
    """Weights against OUTSIDE, whose own are 0: ``own[offset, feature, tag]`` for begin and
    inside, ``file[feature, tag]``, and ``moves[tag before, tag]``."""

    features: dict[str, int]
    file_features: dict[str, int]
    own: np.ndarray
    file: np.ndarray
    moves: np.ndarray
    #: By tag: what a token outside must lead by to be outside whatever stands around it.
    lead: np.ndarray = field(init=False)
    #: Digest of the weights.
    name: str = field(init=False)

    def __post_init__(self) -> None:
        m = self.moves
        both = [[m[p, y] + m[y, n] - m[p, OUTSIDE] - m[OUTSIDE, n] for p in range(3) for n in range(3)] for y in (BEGIN, INSIDE)]
        self.lead = np.max(both, axis=1)
        self.name = sha256(b"".join(x.tobytes() for x in (self.own, self.file, m)) + str(sorted(self.features)).encode()).hexdigest()

    def of_class(self, names: tuple[str, ...]) -> np.ndarray:
        """Weights [offset, tag] of a class of tokens; features never seen in training add
        nothing."""
        at = [self.features[n] for n in names if n in self.features]
        return self.own[:, at].sum(axis=1)

    def of_file(self, names: tuple[str, ...]) -> np.ndarray:
        at = [self.file_features[n] for n in names if n in self.file_features]
        return self.file[at].sum(axis=0)

    def viterbi(self, e: np.ndarray) -> list[int]:
        """The best tags for the weights ``e`` [token, begin or inside] of a run of tokens
        between two that are outside."""
        m = self.moves.tolist()
        score, back = list(m[OUTSIDE]), []
        for t, (b, i) in enumerate(e.tolist()):
            if t:
                step = []
                for y in range(3):
                    p = max(range(3), key=lambda x: score[x] + m[x][y])  # noqa: B023
                    step.append((score[p] + m[p][y], p))
                back.append([p for _, p in step])
                score = [s for s, _ in step]
            score[BEGIN] += b
            score[INSIDE] += i
        y = max(range(3), key=lambda x: score[x] + m[x][OUTSIDE])
        tags = [y]
        for step in reversed(back):
            y = step[y]
            tags.append(y)
        return tags[::-1]


def weights_at(ids: np.ndarray, table: np.ndarray, low: int, high: int) -> np.ndarray:
    """Weights [token, tag] of the tokens ``low`` to ``high`` of a text with the classes
    ``ids``; ``table[offset, class, tag]`` as of ``Crf.of_class``."""
    e = table[0, ids[low:high]]
    for k, d in enumerate(OFFSETS[1:], 1):
        a, b = max(low + d, 0), min(high + d, len(ids))
        if a < b:
            e[a - d - low : b - d - low] += table[k, ids[a:b]]
    return e


def uncertain(ids: np.ndarray, most: np.ndarray, margin: float, block: int = 1 << 18) -> list[tuple[int, int]]:
    """Runs of tokens that might be tagged. Every other token is outside in the best path:
    the greater of its two tags' weights (``most[offset, class]``) and ``margin`` (of the
    file's weights and ``Crf.lead``) add up to less than 0, so to set it outside gains more
    than the moves beside it can lose."""
    reach = max(map(abs, OFFSETS))
    marks = [np.zeros(1, bool)]
    for low in range(0, len(ids), block):
        a, b = max(low - reach, 0), min(low + block + reach, len(ids))
        near, at = ids[a:b], slice(low - a, min(low + block, len(ids)) - a)
        e = most[0].take(near)
        for k, d in enumerate(OFFSETS[1:], 1):
            x = most[k].take(near)
            if d < 0:
                e[-d:] += x[:d]
            else:
                e[:-d] += x[d:]
        marks.append(e[at] >= -margin - 1e-3)  # as much for rounding
    edges = np.flatnonzero(np.diff(np.concatenate([*marks, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]


def _posterior(e: np.ndarray, moves: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Tag probabilities [row, token, tag], expected moves [3, 3] and the log partition of
    all rows, each begun and ended outside; forward and backward in scaled probabilities."""
    rows, width = e.shape[:2]
    top = e.max(axis=2, keepdims=True)
    x, m = np.exp(e - top), np.exp(moves)
    inside = np.arange(width) < length[:, None]
    a, scale = np.empty_like(x), np.ones((rows, width))
    before = np.repeat(np.eye(3)[[OUTSIDE]], rows, axis=0)
    for t in range(width):
        now = before @ m * x[:, t]
        s = now.sum(axis=1)
        scale[:, t] = np.where(inside[:, t], s, 1.0)
        before = np.where(inside[:, t, None], now / s[:, None], before)
        a[:, t] = before
    last = a[:, -1] @ m[:, OUTSIDE]
    log = float((np.log(scale) + np.where(inside, top[..., 0], 0.0)).sum() + np.log(last).sum())
    b = np.empty_like(x)
    after = m[:, OUTSIDE] / last[:, None]
    for t in range(width - 1, -1, -1):
        b[:, t] = after
        after = np.where(inside[:, t, None], (after * x[:, t]) @ m.T / scale[:, t, None], after)
    p = a * b * inside[..., None]
    both = np.concatenate([np.repeat(np.eye(3)[[OUTSIDE]], rows, axis=0)[:, None], a[:, :-1]], axis=1)
    right = np.where(inside[..., None], x * b / scale[..., None], 0.0)
    expected = np.einsum("rti,rtj->ij", both, right) * m
    expected[:, OUTSIDE] += (a[:, -1] * m[:, OUTSIDE] / last[:, None]).sum(axis=0)
    return p, expected, log


def train(sequences: list[tuple[list[tuple[str, ...]], list[int], tuple[str, ...]]], rounds: int = 80, rate: float = 0.2, penalty: float = 2e-4) -> Crf:
    """Fits (features of each token, tags, features of the file) sequences: full gradient of
    the mean log-likelihood with a squared penalty, steps by Adam."""
    classes: dict[tuple[str, ...], int] = {}
    for tokens, _, _ in sequences:
        for c in tokens:
            classes.setdefault(c, len(classes))
    features = {f: i for i, f in enumerate(sorted({f for c in classes for f in c}))}
    file_features = {f: i for i, f in enumerate(sorted({f for *_, fs in sequences for f in fs}))}
    of = np.zeros((len(classes) + 1, len(features)))  # the last class pads
    for c, i in classes.items():
        for f in c:
            of[i, features[f]] += 1
    rows, width, none = len(sequences), max(len(t) for t, _, _ in sequences), len(classes)
    reach = max(-d for d in OFFSETS)
    ids = np.full((rows, width + 2 * reach), none)
    tags, length, files = np.zeros((rows, width), int), np.array([len(t) for t, _, _ in sequences]), np.zeros((rows, len(file_features)))
    for r, (tokens, y, fs) in enumerate(sequences):
        ids[r, reach : reach + len(tokens)] = [classes[c] for c in tokens]
        tags[r, : len(y)] = y
        for f in fs:
            files[r, file_features[f]] += 1
    inside = np.arange(width) < length[:, None]
    shifted = [ids[:, reach + d : reach + d + width] for d in OFFSETS]
    truth = np.eye(3)[tags] * inside[..., None]
    around = np.concatenate([np.zeros((rows, 1), int), np.where(inside, tags, 0), np.zeros((rows, 1), int)], axis=1)
    seen = np.zeros((3, 3))
    for r in range(rows):
        np.add.at(seen, (around[r, : length[r] + 1], around[r, 1 : length[r] + 2]), 1)
    own, file, moves = np.zeros((len(OFFSETS), len(features), 2)), np.zeros((len(file_features), 2)), np.zeros((3, 3))
    params = [own, file, moves]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, rounds + 1):
        e = np.zeros((rows, width, 3))
        for d, at in enumerate(shifted):
            e[..., 1:] += (of @ own[d])[at]
        e[..., 1:] += (files @ file)[:, None]
        p, expected, _ = _posterior(e, moves, length)
        r = (truth - p)[..., 1:]
        by_class = [np.stack([np.bincount(at.ravel(), r[..., y].ravel(), none + 1) for y in range(2)], axis=1) for at in shifted]
        grads = [np.stack([of.T @ g for g in by_class]), files.T @ r.sum(axis=1), seen - expected]
        for i, (x, g) in enumerate(zip(params, grads, strict=True)):
            g = g / rows - penalty * x
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            x += rate * (first[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.99**k)) + 1e-8)
    return Crf(features, file_features, own, file, moves)
