"""A convolutional network over bytes, trained and applied in numpy.

Bytes are embedded, filters of several widths slide over a window, each
filter's highest answer is kept, and a softmax layer turns these into class
probabilities.  Texts of any length are read whole, as windows of fixed length
side by side, the last one ending with the text.
"""

from __future__ import annotations

from collections.abc import Sequence
from random import Random

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

#: Bytes of a window, size of the embedding, widths of the filters, filters of each width.
WINDOW, SIZE, WIDTHS, FILTERS = 96, 8, (2, 3, 5), 32
#: Share of the filters' answers that each training step leaves out.
DROPPED = 0.3

_CONSONANTS = "bcdfghjklmnpqrstvwxyz"


def windows(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts (bytes, 0 where a text is short) and the text each is of."""
    rows, owner = [], []
    for i, text in enumerate(texts):
        raw = text.lower().encode()
        if len(raw) <= WINDOW:
            rows.append(raw.ljust(WINDOW, b"\0"))
            owner.append(i)
            continue
        for start in range(0, len(raw) - WINDOW, WINDOW):
            rows.append(raw[start : start + WINDOW])
            owner.append(i)
        rows.append(raw[-WINDOW:])
        owner.append(i)
    flat = np.frombuffer(b"".join(rows), np.uint8)
    return flat.reshape(-1, WINDOW), np.array(owner, np.int64)


class ByteCnn:
    """Classifier of byte windows."""

    def __init__(self, classes: list[str], seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.classes = classes
        self.p = {"embed": normal(256, SIZE, scale=0.5)}
        for w in WIDTHS:
            self.p[f"w{w}"] = normal(w * SIZE, FILTERS, scale=(2.0 / (w * SIZE)) ** 0.5)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = normal(len(WIDTHS) * FILTERS, len(classes), scale=0.1)
        self.p["bias"] = np.zeros(len(classes), np.float32)

    def _patches(self, x: np.ndarray, w: int) -> np.ndarray:
        embedded = self.p["embed"][x].reshape(len(x), -1)
        view = sliding_window_view(embedded, w * SIZE, axis=1)[:, ::SIZE]
        return np.ascontiguousarray(view).reshape(-1, w * SIZE)

    def _forward(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        pooled = []
        for w in WIDTHS:
            patches = self._patches(x, w)
            answers = (patches @ self.p[f"w{w}"]).reshape(len(x), x.shape[1] - w + 1, FILTERS)
            if keep is None:
                top = answers.max(axis=1)
            else:
                at = answers.argmax(axis=1)
                top = np.take_along_axis(answers, at[:, None, :], axis=1)[:, 0]
                keep[w] = (at, patches)
            pooled.append(np.maximum(top + self.p[f"b{w}"], 0))
        hidden = np.concatenate(pooled, axis=1)
        if keep is not None:
            hidden *= keep["mask"]
        logits = hidden @ self.p["out"] + self.p["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        out = np.exp(logits)
        out /= out.sum(axis=1, keepdims=True)
        if keep is not None:
            keep["hidden"] = hidden
        return out

    def _gradients(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        n = len(x)
        mask = (rng.random((n, len(WIDTHS) * FILTERS)) >= DROPPED).astype(np.float32) / np.float32(1 - DROPPED)
        keep: dict = {"mask": mask}
        error = self._forward(x, keep)
        error[np.arange(n), y] -= 1
        error /= n
        g = {"out": keep["hidden"].T @ error, "bias": error.sum(axis=0), "embed": np.zeros_like(self.p["embed"])}
        back = (error @ self.p["out"].T) * (keep["hidden"] > 0) * mask
        for i, w in enumerate(WIDTHS):
            at, patches = keep[w]
            d = back[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"b{w}"] = d.sum(axis=0)
            # of each filter only the place of its highest answer learns
            chosen = patches.reshape(n, WINDOW - w + 1, -1)[np.arange(n)[:, None], at]
            g[f"w{w}"] = np.einsum("nf,nfk->kf", d, chosen)
            to_bytes = (d[:, :, None] * self.p[f"w{w}"].T).reshape(n, FILTERS, w, SIZE)
            places = at[:, :, None] + np.arange(w)
            cell = x[np.arange(n)[:, None, None], places].astype(np.int64)[..., None] * SIZE + np.arange(SIZE)
            g["embed"] += np.bincount(cell.ravel(), to_bytes.ravel(), 256 * SIZE).reshape(256, SIZE).astype(np.float32)
        return g

    def fit(self, texts: Sequence[str], labels: Sequence[str], steps: int = 800, batch: int = 96, seed: int = 2) -> "ByteCnn":
        """Adam on random stretches of the texts, of many lengths, each class equally often.

        Invented words take the place of some words, and some stretches have
        their words in another order, so that the network learns words and
        endings rather than the sentences it happened to see.
        """
        rng, draw = np.random.default_rng(seed), Random(seed)
        of = {c: [t.lower().split() for t, own in zip(texts, labels) if own == c and t.split()] for c in self.classes}
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for step in range(1, steps + 1):
            y = rng.integers(0, len(self.classes), batch)
            x = np.frombuffer(b"".join(self._stretch(draw, of[self.classes[c]]) for c in y), np.uint8)
            rate = 0.01 * (1 - step / (steps + 1)) + 0.0005
            for k, g in self._gradients(x.reshape(batch, WINDOW), y, rng).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    @staticmethod
    def _stretch(rng: Random, texts: list[list[str]]) -> bytes:
        """One window of training text."""
        words = list(rng.choice(texts))
        if rng.random() < 0.4:
            rng.shuffle(words)
        for i in range(len(words)):
            if rng.random() < 0.25:
                made = "".join(rng.choice(_CONSONANTS) + rng.choice("aeiou") for _ in range(rng.randrange(2, 6)))
                words[i] = rng.choice(_CONSONANTS) + made if rng.random() < 0.3 else made
        raw = " ".join(words).encode()
        length = rng.randrange(40, WINDOW + 1)
        start = rng.randrange(max(1, len(raw) - length + 1))
        return raw[start : start + length].ljust(WINDOW, b"\0")

    def probabilities(self, texts: Sequence[str]) -> np.ndarray:
        """Class probabilities of each text: the normed geometric mean over its windows.

        Short windows go together and are cut behind the first filters that see
        nothing but their filling, as further ones would answer the same.
        """
        if not len(texts):
            return np.zeros((0, len(self.classes)), np.float32)
        x, owner = windows(texts)
        size = WINDOW - (x[:, ::-1] != 0).argmax(axis=1)
        order = np.argsort(size, kind="stable")
        p = np.empty((len(x), len(self.classes)), np.float32)
        for i in range(0, len(x), 256):
            own = order[i : i + 256]
            p[own] = self._forward(x[own, : min(WINDOW, size[own[-1]] + max(WIDTHS))])
        logs = np.zeros((len(texts), len(self.classes)))
        np.add.at(logs, owner, np.log(p + 1e-9))
        logs /= np.bincount(owner, minlength=len(texts))[:, None]
        out = np.exp(logs - logs.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)
