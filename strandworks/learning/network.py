"""A small residual network over one-channel grids, with gradients written out: what a training task computes of its own examples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KERNEL = 3


@dataclass(frozen=True)
class Network:
    """A stem of KERNEL x KERNEL filters, residual blocks of two such layers each, the mean over the grid's height, and a linear head."""

    height: int
    width: int
    classes: int
    channels: int = 8
    blocks: int = 2

    def shapes(self) -> dict[str, tuple[int, ...]]:
        k = KERNEL * KERNEL
        out = {"stem": (self.channels, k), "stem_bias": (self.channels,)}
        for b in range(self.blocks):
            for layer in "ab":
                out |= {f"{layer}{b}": (self.channels, self.channels * k), f"{layer}{b}_bias": (self.channels,)}
        return out | {"head": (self.classes, self.channels * self.width), "head_bias": (self.classes,)}

    def size(self) -> int:
        """Trainable parameters."""
        return sum(int(np.prod(s)) for s in self.shapes().values())

    def initial(self, seed: int) -> dict[str, np.ndarray]:
        """Filters by the size of what they read; the second layer of a block begins small, so a block begins near the identity."""
        rng, out = np.random.default_rng(seed), {}
        for name, shape in self.shapes().items():
            scale = 0.0 if name.endswith("bias") else np.sqrt(2 / shape[1]) * (0.2 if name[0] == "b" else 1)
            out[name] = rng.standard_normal(shape) * scale
        return out

    def flat(self, p: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([p[n].ravel() for n in self.shapes()])

    def named(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for n, s in self.shapes().items():
            size = int(np.prod(s))
            out[n] = flat[at : at + size].reshape(s)
            at += size
        return out

    def backbone(self) -> np.ndarray:
        """Which flat parameters aren't the head's."""
        return np.concatenate([np.full(int(np.prod(s)), not n.startswith("head")) for n, s in self.shapes().items()])

    @staticmethod
    def _columns(x: np.ndarray) -> np.ndarray:
        """Every place's neighbourhood: (examples x height x width) rows of channels x KERNEL x KERNEL values, zeros beyond the edges."""
        wide = np.pad(x, ((0, 0), (0, 0), (KERNEL // 2,) * 2, (KERNEL // 2,) * 2))
        windows = np.lib.stride_tricks.sliding_window_view(wide, (KERNEL, KERNEL), (2, 3))
        return windows.transpose(0, 2, 3, 1, 4, 5).reshape(-1, x.shape[1] * KERNEL * KERNEL)

    def _layer(self, x: np.ndarray, w: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        columns = self._columns(x)
        y = (columns @ w.T + bias).reshape(len(x), self.height, self.width, -1).transpose(0, 3, 1, 2)
        return y, columns

    def _layer_back(self, dy: np.ndarray, columns: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of input, filters and biases."""
        n, rows = len(dy), dy.transpose(0, 2, 3, 1).reshape(-1, dy.shape[1])
        parts = (rows @ w).reshape(n, self.height, self.width, -1, KERNEL, KERNEL)
        wide = np.zeros((n, parts.shape[3], self.height + KERNEL - 1, self.width + KERNEL - 1))
        for i in range(KERNEL):
            for j in range(KERNEL):
                wide[:, :, i : i + self.height, j : j + self.width] += parts[..., i, j].transpose(0, 3, 1, 2)
        edge = KERNEL // 2
        return wide[:, :, edge : edge + self.height, edge : edge + self.width], rows.T @ columns, rows.sum(0)

    def scores(self, p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, list]:
        """Class scores of grids (examples x height x width), and what gradients need."""
        y, columns = self._layer(x[:, None], p["stem"], p["stem_bias"])
        kept, h = [(columns, y)], np.maximum(y, 0)
        for b in range(self.blocks):
            first, columns_a = self._layer(h, p[f"a{b}"], p[f"a{b}_bias"])
            second, columns_b = self._layer(np.maximum(first, 0), p[f"b{b}"], p[f"b{b}_bias"])
            total = second + h
            kept.append((columns_a, first, columns_b, total))
            h = np.maximum(total, 0)
        mean = h.mean(2).reshape(len(x), -1)
        kept.append(mean)
        return mean @ p["head"].T + p["head_bias"], kept

    def gradients(self, p: dict[str, np.ndarray], x: np.ndarray, targets: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """The weighted sum of cross-entropies to soft targets over examples, and its flat gradient. No examples: zeros."""
        if not len(x):
            return 0.0, np.zeros(self.size())
        s, kept = self.scores(p, x)
        s = s - s.max(1, keepdims=True)
        log = s - np.log(np.exp(s).sum(1, keepdims=True))
        loss = -float((targets * log * weights[:, None]).sum())
        ds = (np.exp(log) * targets.sum(1, keepdims=True) - targets) * weights[:, None]
        g = {"head": ds.T @ kept[-1], "head_bias": ds.sum(0)}
        dh = np.broadcast_to((ds @ p["head"]).reshape(-1, self.channels, 1, self.width), (len(ds), self.channels, self.height, self.width)) / self.height
        for b in reversed(range(self.blocks)):
            columns_a, first, columns_b, total = kept[b + 1]
            dtotal = dh * (total > 0)
            dfirst, g[f"b{b}"], g[f"b{b}_bias"] = self._layer_back(dtotal, columns_b, p[f"b{b}"])
            dh, g[f"a{b}"], g[f"a{b}_bias"] = self._layer_back(dfirst * (first > 0), columns_a, p[f"a{b}"])
            dh = dh + dtotal
        columns, y = kept[0]
        _, g["stem"], g["stem_bias"] = self._layer_back(dh * (y > 0), columns, p["stem"])
        return loss, self.flat(g)

    def chances(self, p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty((0, self.classes))
        s, _ = self.scores(p, x)
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)
