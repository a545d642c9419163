"""A bidirectional LSTM in numpy that labels the blocks of a page as main text or not."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np

from skyledger.llm.blocks import Block

#: Hashed tag-path and word vectors, plain numbers, and units in each direction.
PATH, WORDS, PLAIN, UNITS = 96, 32, 10, 16
INPUTS = PATH + WORDS + PLAIN
#: Cells of a batch, so that one long page does not widen many short ones.
CELLS = 60_000
EPOCHS, RATE, BATCH = 14, 0.01, 32

_HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
_DIGIT = re.compile(r"\d")
_slots: dict[tuple[str, int], int] = {}


def _slot(token: str, size: int) -> int:
    key = (token, size)
    found = _slots.get(key)
    if found is None:
        if len(_slots) > 200_000:
            _slots.clear()
        found = _slots[key] = zlib.crc32(token.encode("utf-8", "surrogatepass")) % size
    return found


def _with_slots(before: np.ndarray, tokens: tuple[str, ...]) -> np.ndarray:
    """The slots of a path and of the tokens that follow it."""
    slots = [_slot(t, PATH) for t in tokens]
    if before[slots].all():
        return before
    after = before.copy()
    after[slots] = True
    return after


_NO_SLOTS = np.zeros(PATH, bool)


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row per block."""
    out = np.zeros((len(blocks), INPUTS), np.float32)
    for k, block in enumerate(blocks):
        row = out[k]
        place = block.place
        near = place.last(3)
        row[:PATH] = place.summed("slots", _NO_SLOTS, _with_slots)
        # The nearest tags count once more, under names of their own.
        for token in near:
            row[_slot(f"near {token}", PATH)] = 1
        text = block.text
        held = text.split()
        for word in held:
            row[PATH + _slot(word.lower(), WORDS)] += 1
        row[PATH : PATH + WORDS] /= len(held)
        plain = row[PATH + WORDS :]
        letters = max(1, len(text))
        plain[0] = math.log1p(len(held)) / 5
        plain[1] = min(1.0, block.linked / letters)
        plain[2] = len(held) > 12
        plain[3] = (text.count(".") + text.count(",")) / len(held)
        plain[4] = text[-1] in ".!?:;\"'"
        plain[5] = any(t in _HEADINGS for t in near[-2:])
        plain[6] = place.summed("p", False, lambda before, tokens: before or "p" in tokens)
        plain[7] = k / len(blocks)
        plain[8] = len(_DIGIT.findall(text)) / letters
        plain[9] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Direction:
    """One LSTM over padded sequences (time, page, input)."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.w = (rng.standard_normal((INPUTS, 4 * UNITS)) / math.sqrt(INPUTS)).astype(np.float32)
        self.u = (rng.standard_normal((UNITS, 4 * UNITS)) / math.sqrt(UNITS)).astype(np.float32)
        self.b = np.zeros(4 * UNITS, np.float32)
        self.b[UNITS : 2 * UNITS] = 1

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        steps, pages, _ = x.shape
        drive = (x.reshape(-1, INPUTS) @ self.w + self.b).reshape(steps, pages, -1)
        h = np.zeros((pages, UNITS), np.float32)
        c = np.zeros((pages, UNITS), np.float32)
        out = np.empty((steps, pages, UNITS), np.float32)
        for t in range(steps):
            z = drive[t] + h @ self.u
            gates = _sigmoid(z[:, : 3 * UNITS])
            i, f, o = gates[:, :UNITS], gates[:, UNITS : 2 * UNITS], gates[:, 2 * UNITS :]
            g = np.tanh(z[:, 3 * UNITS :])
            before = (h, c)
            c = f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            out[t] = h
            if keep is not None:
                keep.append((i, f, o, g, squashed, *before))
        return out

    def gradients(self, x: np.ndarray, keep: list, dout: np.ndarray) -> list[np.ndarray]:
        steps, pages, _ = x.shape
        dz = np.empty((steps, pages, 4 * UNITS), np.float32)
        du = np.zeros_like(self.u)
        dh = np.zeros((pages, UNITS), np.float32)
        dc = np.zeros((pages, UNITS), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, o, g, squashed, h, c = keep[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - squashed**2)
            dz[t] = np.concatenate(
                [dc * g * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], 1
            )
            du += h.T @ dz[t]
            dh = dz[t] @ self.u.T
            dc = dc * f
        flat = dz.reshape(-1, 4 * UNITS)
        return [x.reshape(-1, INPUTS).T @ flat, du, flat.sum(0)]


def _backwards(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's steps in reverse, its padding left at the end."""
    steps = np.arange(x.shape[0])[:, None]
    at = np.where(steps < lengths, lengths - 1 - steps, steps)
    return x[at, np.arange(x.shape[1])]


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((lengths.max(), len(pages), pages[0].shape[1]), np.float32)
    for k, page in enumerate(pages):
        x[: len(page), k] = page
    return x, lengths


class Labeller:
    """Both directions and the output, a probability of being main text per block."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.ways = (Direction(rng), Direction(rng))
        self.v = (rng.standard_normal(2 * UNITS) / math.sqrt(2 * UNITS)).astype(np.float32)
        self.a = np.zeros(1, np.float32)

    def _parameters(self) -> list[np.ndarray]:
        return [p for w in self.ways for p in (w.w, w.u, w.b)] + [self.v, self.a]

    def _run(self, x: np.ndarray, lengths: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        kept = keep or (None, None)
        ahead = self.ways[0].forward(x, kept[0])
        back = self.ways[1].forward(_backwards(x, lengths), kept[1])
        return np.concatenate([ahead, _backwards(back, lengths)], 2)

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page one value per block; pages of like length go together."""
        out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
        order = sorted((k for k, p in enumerate(pages) if len(p)), key=lambda k: len(pages[k]))
        for group in self._groups(order, pages):
            x, lengths = _padded([pages[k] for k in group])
            p = _sigmoid(self._run(x, lengths) @ self.v + self.a)
            for column, k in enumerate(group):
                out[k] = p[: lengths[column], column]
        return out

    @staticmethod
    def _groups(order: list[int], pages: list[np.ndarray]) -> Iterator[list[int]]:
        group: list[int] = []
        for k in order:
            if group and (len(group) + 1) * len(pages[k]) > CELLS:
                yield group
                group = []
            group.append(k)
        if group:
            yield group

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], seed: int = 7) -> Labeller:
        """Adam on the mean cross-entropy; blocks labelled -1 do not count."""
        rng = np.random.default_rng(seed)
        parameters = self._parameters()
        first = [np.zeros_like(p) for p in parameters]
        second = [np.zeros_like(p) for p in parameters]
        step = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            order = sorted(rng.permutation(len(pages)), key=lambda k: len(pages[k]) + 6 * rng.random())
            batches = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
            for b in rng.permutation(len(batches)):
                step += 1
                chosen = batches[b]
                for p, g, m, s in zip(
                    parameters, self._gradients([pages[k] for k in chosen], [labels[k] for k in chosen]),
                    first, second, strict=True,
                ):
                    g = np.clip(g, -1, 1)
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        return self

    def _gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> list[np.ndarray]:
        x, lengths = _padded(pages)
        y = np.full(x.shape[:2], -1, np.float32)
        for k, label in enumerate(labels):
            y[: len(label), k] = label
        keep: tuple[list, list] = ([], [])
        h = self._run(x, lengths, keep)
        counted = y >= 0
        d = np.where(counted, _sigmoid(h @ self.v + self.a) - y, 0).astype(np.float32) / max(1, counted.sum())
        dh = d[:, :, None] * self.v
        ahead = self.ways[0].gradients(x, keep[0], dh[:, :, :UNITS])
        back = self.ways[1].gradients(_backwards(x, lengths), keep[1], _backwards(dh[:, :, UNITS:], lengths))
        return [*ahead, *back, np.tensordot(d, h, ([0, 1], [0, 1])), np.array([d.sum()], np.float32)]
