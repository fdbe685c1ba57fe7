"""A character-level bidirectional LSTM with CRF transitions in numpy: training on labelled spans, decoding of windows."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
ALPHABET = "\0abcdefghijklmnopqrstuvwxyz0123456789 \n@.-_+()[]%,:;/\"'=#"
OTHER = len(ALPHABET)


def encode(text: str, length: int) -> np.ndarray:
    """Symbol ids of a window, padded with 0; letters are lower-cased."""
    found = [ALPHABET.find(c) for c in text.lower()] if len(text.lower()) == len(text) else [ALPHABET.find(c.lower()[:1] or c) for c in text]
    ids = np.zeros(length, np.int64)
    ids[: len(found)] = [OTHER if k < 0 else k for k in found]
    return ids


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Weights of both directions are stacked: [0] reads forward, [1] backward."""

    def __init__(self, embed: int = 12, hidden: int = 20, seed: int = 7):
        rng, tags = np.random.default_rng(seed), len(TAGS)
        self.hidden = hidden
        self.w = {
            "emb": rng.normal(0, 0.3, (OTHER + 1, embed)),
            "wx": rng.normal(0, 0.25, (2, embed, 4 * hidden)),
            "wh": rng.normal(0, 0.2, (2, hidden, 4 * hidden)),
            "b": np.tile(np.repeat([0.0, 1.0, 0.0, 0.0], hidden), (2, 1, 1)),
            "out": rng.normal(0, 0.2, (2 * hidden, tags)),
            "ob": np.zeros(tags),
            "trans": np.zeros((tags, tags)),
            "start": np.zeros(tags),
        }
        self.w["ob"][0] = 2.0
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.banned = np.zeros((tags, tags), np.float32)
        for a in range(tags):
            for b in range(2, tags, 2):  # an I tag follows its B or itself
                if a not in (b, b - 1):
                    self.banned[a, b] = -1e4
        self.first = np.where([t.startswith("I-") for t in TAGS], -1e4, 0.0).astype(np.float32)

    def _run(self, ids: np.ndarray):
        """ids: batch, time. Emission scores and what training needs."""
        w, h = self.w, self.hidden
        n, t = ids.shape
        x = w["emb"][np.stack([ids, ids[:, ::-1]])]  # 2, n, t, e
        pre = np.matmul(x.reshape(2, n * t, -1), w["wx"]).reshape(2, n, t, 4 * h) + w["b"][:, :, None]
        hs, cs, gates = np.zeros((t + 1, 2, n, h), np.float32), np.zeros((t + 1, 2, n, h), np.float32), np.empty((t, 2, n, 4 * h), np.float32)
        for k in range(t):
            g = pre[:, :, k] + np.matmul(hs[k], w["wh"])
            g[..., : 3 * h] = _sigmoid(g[..., : 3 * h])
            g[..., 3 * h :] = np.tanh(g[..., 3 * h :])
            cs[k + 1] = g[..., h : 2 * h] * cs[k] + g[..., :h] * g[..., 3 * h :]
            hs[k + 1] = g[..., 2 * h : 3 * h] * np.tanh(cs[k + 1])
            gates[k] = g
        both = np.concatenate([hs[1:, 0], hs[:0:-1, 1]], axis=2)  # t, n, 2h
        return both @ w["out"] + w["ob"], (x, hs, cs, gates, both)

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """batch, time, tags"""
        return self._run(ids)[0].transpose(1, 0, 2)

    def step(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Negative log likelihood of a batch and its gradients."""
        w, h = self.w, self.hidden
        n, t = ids.shape
        em, (x, hs, cs, gates, both) = self._run(ids)
        trans, first = w["trans"] + self.banned, w["start"] + self.first
        lse = lambda a, ax: (m := a.max(axis=ax, keepdims=True)).squeeze(ax) + np.log(np.exp(a - m).sum(axis=ax))
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[0] = first + em[0]
        for k in range(1, t):
            alpha[k] = lse(alpha[k - 1][:, :, None] + trans, 1) + em[k]
        for k in range(t - 2, -1, -1):
            beta[k] = lse(trans + (em[k + 1] + beta[k + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        tt, rows = tags.T, np.arange(n)
        gold = first[tt[0]] + em[np.arange(t)[:, None], rows, tt].sum(axis=0) + trans[tt[:-1], tt[1:]].sum(axis=0)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        dem = np.exp(alpha + beta - z[:, None])
        grad["start"] = dem[0].sum(axis=0) - np.bincount(tt[0], minlength=len(TAGS))
        pair = np.exp(alpha[:-1, :, :, None] + trans + (em[1:] + beta[1:])[:, :, None, :] - z[:, None, None])
        grad["trans"] = pair.sum(axis=(0, 1))
        np.add.at(grad["trans"], (tt[:-1].ravel(), tt[1:].ravel()), -1)
        dem[np.arange(t)[:, None], rows, tt] -= 1
        grad["out"], grad["ob"] = np.tensordot(both, dem, ((0, 1), (0, 1))), dem.sum(axis=(0, 1))
        dboth = dem @ w["out"].T
        dh_in = np.stack([dboth[..., :h], dboth[::-1, :, h:]], axis=1)  # t, 2, n, h
        dh, dc, dpre = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32), np.empty((t, 2, n, 4 * h), np.float32)
        for k in range(t - 1, -1, -1):
            g, c, dh = gates[k], np.tanh(cs[k + 1]), dh + dh_in[k]
            i, f, o, u = g[..., :h], g[..., h : 2 * h], g[..., 2 * h : 3 * h], g[..., 3 * h :]
            dc = dc + dh * o * (1 - c * c)
            d = dpre[k]
            d[..., :h], d[..., h : 2 * h] = dc * u * i * (1 - i), dc * cs[k] * f * (1 - f)
            d[..., 2 * h : 3 * h], d[..., 3 * h :] = dh * c * o * (1 - o), dc * i * (1 - u * u)
            dc = dc * f
            dh = np.matmul(d, w["wh"].transpose(0, 2, 1))
        for s in (0, 1):
            flat = dpre[:, s].transpose(1, 0, 2).reshape(n * t, -1)
            grad["wx"][s] = x[s].reshape(n * t, -1).T @ flat
            grad["b"][s, 0] = flat.sum(axis=0)
            grad["wh"][s] = np.tensordot(hs[:-1, s], dpre[:, s], ((0, 1), (0, 1)))
            np.add.at(grad["emb"], (ids if s == 0 else ids[:, ::-1]).ravel(), flat @ w["wx"][s].T)
        return float((z - gold).sum()) / n, {k: v / n for k, v in grad.items()}

    def train(self, ids: np.ndarray, tags: np.ndarray, steps: int, batch: int = 32, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over random batches; gives the losses."""
        rng, m, v, losses = np.random.default_rng(seed), {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, []
        for k in range(1, steps + 1):
            pick = rng.integers(0, len(ids), batch)
            loss, grad = self.step(ids[pick], tags[pick])
            losses.append(loss)
            pace = rate * min(1.0, 2.0 * (1 - k / (steps + 1)))
            for name, g in grad.items():
                g = np.clip(g, -5, 5)
                m[name], v[name] = 0.9 * m[name] + 0.1 * g, 0.99 * v[name] + 0.01 * g * g
                self.w[name] = (self.w[name] - pace * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
        return losses

    def forward(self, em: np.ndarray, score: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Best scores after em (time, tags) that follows what gave score, and where each came from."""
        trans, back = self.w["trans"] + self.banned, np.zeros(em.shape, np.uint8)
        for k, row in enumerate(em):
            if score is None:
                score = self.w["start"] + self.first + row
                continue
            all_ = score[:, None] + trans
            back[k] = all_.argmax(axis=0)
            score = all_.max(axis=0) + row
        return score, back

    def trace(self, score: np.ndarray, back: np.ndarray) -> list[int]:
        """The best tags that end in score."""
        path = [int(score.argmax())]
        for b in back[:0:-1]:
            path.append(int(b[path[-1]]))
        return path[::-1]

    def viterbi(self, em: np.ndarray) -> list[int]:
        """The best tags for scores of time, tags."""
        return self.trace(*self.forward(em))
