"""A small causal self-attention model over subword ids, trained and run in numpy.

A window holds CONTEXT ids of context and NEW ids to score; windows overlap by the context,
so each id is scored once. Queries are made for the places before the new ids only. Where the
next id begins a word the model gives its class; a word's share of its class comes from
corpus counts.
"""

from __future__ import annotations

import copy

import numpy as np

CONTEXT = NEW = 16
DIM, CLASSES = 16, 96
#: Bins, by twentieths of a nat, of how much likelier than by counts a class is.
BINS, BIN = 640, 0.05


def windows(ids: list[np.ndarray], start: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows of CONTEXT + NEW ids, which of the new places hold an id), in order of the ids of all texts."""
    rows = []
    for x in ids:
        n = -(-len(x) // NEW) * NEW
        row = np.full(CONTEXT + n, pad, np.int32)
        row[CONTEXT - 1] = start
        row[CONTEXT : CONTEXT + len(x)] = x
        rows.append(np.lib.stride_tricks.sliding_window_view(row, CONTEXT + NEW)[::NEW] if n else np.zeros((0, CONTEXT + NEW), np.int32))
    w = np.concatenate(rows) if rows else np.zeros((0, CONTEXT + NEW), np.int32)
    return w, w[:, CONTEXT:] != pad


class Attention:
    """One attention layer with a residual connection and a softmax over classes."""

    NAMES = ("E", "P", "Wq", "Wk", "Wv", "Wo", "Wc", "b")

    def __init__(self, n_ids: int, class_of: np.ndarray, mass: np.ndarray, seed: int = 3):
        """class_of: the class of each id that begins words, else -1; mass: how often the words of each class stand in the corpus."""
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.class_of = np.append(class_of, -1)
        self.pad = n_ids  # embedding row of padding, masked out
        self.E = (0.3 * rng.standard_normal((n_ids + 1, DIM))).astype(np.float32)
        self.P = (0.1 * rng.standard_normal((CONTEXT + NEW - 1, DIM))).astype(np.float32)
        self.Wq, self.Wk, self.Wv, self.Wo, self.Wc = r(DIM, DIM), r(DIM, DIM), r(DIM, DIM), r(DIM, DIM), r(DIM, CLASSES)
        self.b = np.log(np.maximum(mass / max(mass.sum(), 1e-9), 1e-9)).astype(np.float32)
        self.prior = self.b.copy()
        at = np.arange(CONTEXT + NEW - 1)
        self.mask = np.where(at[None] <= np.arange(CONTEXT - 1, CONTEXT + NEW - 1)[:, None], 0, -1e9).astype(np.float32)

    def _forward(self, w: np.ndarray):
        seen = w[:, :-1]
        x = self.E[seen] + self.P
        flat = x.reshape(-1, DIM)
        k, v = (flat @ self.Wk).reshape(x.shape), (flat @ self.Wv).reshape(x.shape)
        last = np.ascontiguousarray(x[:, CONTEXT - 1 :])
        q = (last.reshape(-1, DIM) @ (self.Wq / np.float32(np.sqrt(DIM)))).reshape(last.shape)
        s = q @ k.transpose(0, 2, 1)
        s += self.mask
        s += np.where(seen == self.pad, np.float32(-1e9), np.float32(0))[:, None]
        s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(2, keepdims=True)
        a = s @ v
        h = last + (a.reshape(-1, DIM) @ self.Wo).reshape(last.shape)
        z = h.reshape(-1, DIM) @ self.Wc + self.b
        z -= z.max(1, keepdims=True)
        return seen, x, k, v, last, q, s, a, h, z

    def _used(self, w: np.ndarray) -> np.ndarray:
        """How many new ids of each window begin words."""
        return (self.class_of[w[:, CONTEXT:]] >= 0).sum(1)

    def _attended(self, w: np.ndarray, query: np.ndarray):
        """Attention of the places before new ids that begin words, in order, over unprojected embeddings; query: from an embedding to the scores of others.

        Gives the class of each such id, its slot (a window has as many as the most such ids of any), the place before it, the embeddings seen, the queries and weights by slots, and the mean embedding of each place.
        """
        seen = w[:, :-1]
        of = self.class_of[w[:, CONTEXT:].ravel()]
        rows = np.flatnonzero(of >= 0)
        at, place = np.divmod(rows, NEW)
        count = np.bincount(at, minlength=len(w))
        wide = int(count.max(initial=0))
        slot = np.arange(len(rows)) + np.repeat(np.arange(len(w)) * wide - (np.cumsum(count) - count), count)
        before = at * seen.shape[1] + place + (CONTEXT - 1)
        x = np.take(self.E, seen, axis=0)
        x += self.P
        places = np.zeros(len(w) * wide, np.int64)
        places[slot] = place
        q = np.zeros((len(places), DIM), np.float32)
        q[slot] = np.take(x.reshape(-1, DIM), before, axis=0) @ query
        q = q.reshape(len(w), wide, DIM)
        s = np.matmul(q, x.transpose(0, 2, 1))
        far = max(s.max(initial=0), -s.min(initial=0)) > 80  # else float32 holds the sums without a shift by the maximum
        s += np.take(self.mask, places, axis=0).reshape(s.shape)
        begins = np.flatnonzero(seen[:, 0] == self.pad)  # only a text's first window has padding before its ids
        s[begins] += np.where(seen[begins] == self.pad, np.float32(-1e9), np.float32(0))[:, None]
        if far and s.size:
            s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        s /= (s.reshape(-1, s.shape[2]) @ np.ones((s.shape[2], 1), np.float32)).reshape(len(w), wide, 1)
        return of[rows], slot, before, x, q, s, np.take(np.matmul(s, x).reshape(-1, DIM), slot, axis=0)

    def _folded(self) -> tuple[np.ndarray, np.ndarray]:
        """From an embedding to the scores of others, and from a mean embedding to what attention adds: products of two weights each."""
        return self.Wq @ self.Wk.T / np.float32(np.sqrt(DIM)), self.Wv @ self.Wo

    def _classes(self, h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exponentials of the output layer, their sums, and the log-probability of each class."""
        p = h @ self.Wc
        p += self.b
        flat = np.arange(len(of)) * CLASSES + of
        own = p.ravel()[flat]
        with np.errstate(over="ignore"):
            np.exp(p, out=p)
            total = p @ np.ones(CLASSES, np.float32)
        if not (np.isfinite(total) & (total > 1e-30)).all():
            p = h @ self.Wc + self.b
            p -= p.max(1, keepdims=True)
            own = p.ravel()[flat]
            np.exp(p, out=p)
            total = p @ np.ones(CLASSES, np.float32)
        return p, total, own - np.log(total)

    def log_p(self, w: np.ndarray, batch: int = 192) -> np.ndarray:
        """Natural log-probability of the class of each new id that begins a word, given the ids before it; 0 at other places."""
        out = np.zeros((len(w), NEW), np.float32)
        query, value = self._folded()
        used = self._used(w)
        order = np.argsort(used, kind="stable")[np.count_nonzero(used == 0) :]
        for i in range(0, len(order), batch):
            part = w[order[i : i + batch]]
            of, _, before, x, _, _, mean = self._attended(part, query)
            h = np.take(x.reshape(-1, DIM), before, axis=0)
            h += mean @ value
            at, place = np.divmod(before, x.shape[1])
            out[order[i : i + batch][at], place - (CONTEXT - 1)] = self._classes(h, of)[2]
        return out

    def train(self, w: np.ndarray, steps: int, batch: int = 192, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on random batches of windows."""
        rng = np.random.default_rng(seed)
        m1, m2 = ({k: np.zeros_like(getattr(self, k)) for k in self.NAMES} for _ in range(2))
        for t in range(1, steps + 1):
            grads = self._gradients(w[rng.integers(0, len(w), batch)])
            lr = rate * min(1.0, t / 20, (steps - t + 1) / (0.3 * steps))
            for k, g in grads.items():
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.01 * (g * g - m2[k])
                getattr(self, k)[...] -= lr * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-6)

    def _parts(self, w: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Gradients of all parameters but the embedding; the ids seen and the gradient of each one's row."""
        seen, x, k, v, last, q, s, a, h, z = self._forward(w)
        of = self.class_of[w[:, CONTEXT:].ravel()]
        real = of >= 0
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        p[np.flatnonzero(real), of[real]] -= 1
        dz = p * (real[:, None] / np.float32(max(1, real.sum())))
        g = {"Wc": h.reshape(-1, DIM).T @ dz, "b": dz.sum(0)}
        dh = (dz @ self.Wc.T).reshape(h.shape)
        g["Wo"] = a.reshape(-1, DIM).T @ dh.reshape(-1, DIM)
        da = (dh.reshape(-1, DIM) @ self.Wo.T).reshape(a.shape)
        dv = s.transpose(0, 2, 1) @ da
        ds = da @ v.transpose(0, 2, 1)
        ds = s * (ds - (ds * s).sum(2, keepdims=True))
        dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
        scale = np.float32(1 / np.sqrt(DIM))
        flat = x.reshape(-1, DIM)
        g["Wq"] = last.reshape(-1, DIM).T @ dq.reshape(-1, DIM) * scale
        g["Wk"], g["Wv"] = flat.T @ dk.reshape(-1, DIM), flat.T @ dv.reshape(-1, DIM)
        dx = (dk.reshape(-1, DIM) @ self.Wk.T + dv.reshape(-1, DIM) @ self.Wv.T).reshape(x.shape)
        dx[:, CONTEXT - 1 :] += dh + (dq.reshape(-1, DIM) @ self.Wq.T).reshape(dh.shape) * scale
        g["P"] = dx.sum(0)
        return g, seen.ravel(), dx.reshape(-1, DIM)

    def _gradients(self, w: np.ndarray) -> dict[str, np.ndarray]:
        g, seen, dx = self._parts(w)
        g["E"] = np.zeros_like(self.E)
        np.add.at(g["E"], seen, dx)
        g["E"][self.pad] = 0
        return g

    def sums(self, w: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Gradients summed over the new ids that begin words, of all weights but the embedding; the ids seen with the gradients of their rows; the log of how much likelier each class is than its prior."""
        query, value = self._folded()
        of, slot, before, x, q, s, mean = self._attended(w, query)
        last = np.take(x.reshape(-1, DIM), before, axis=0)
        h = mean @ value
        h += last
        p, total, own = self._classes(h, of)
        p *= (1 / total)[:, None]
        p.ravel()[np.arange(len(of)) * CLASSES + of] -= 1
        g = {"Wc": h.T @ p, "b": np.ones(len(p), np.float32) @ p}
        dh = p @ self.Wc.T
        dvalue = mean.T @ dh
        g["Wv"], g["Wo"] = dvalue @ self.Wo.T, self.Wv.T @ dvalue
        dmean = dh @ value.T
        inner, dm = np.zeros((s.shape[0] * s.shape[1], 1), np.float32), np.zeros((s.shape[0] * s.shape[1], DIM), np.float32)
        inner[slot, 0] = (dmean * mean) @ np.ones(DIM, np.float32)  # of each place's weights with their gradients
        dm[slot] = dmean
        dm = dm.reshape(q.shape)
        ds = np.matmul(dm, x.transpose(0, 2, 1))
        ds -= inner.reshape(*s.shape[:2], 1)
        ds *= s
        dq = np.take(np.matmul(ds, x).reshape(-1, DIM), slot, axis=0)
        dquery = last.T @ dq / np.float32(np.sqrt(DIM))
        g["Wq"], g["Wk"] = dquery @ self.Wk, dquery.T @ self.Wq
        dx = np.matmul(s.transpose(0, 2, 1), dm)
        dx += np.matmul(ds.transpose(0, 2, 1), q)
        flat = dx.reshape(-1, DIM)
        dh += dq @ query.T
        flat[before] += dh
        g["P"] = (np.ones(len(w), np.float32) @ dx.reshape(len(w), self.P.size)).reshape(self.P.shape)
        return g, w[:, :-1].ravel(), flat, own - self.prior[of]


class Pass:
    """One pass over windows that come in parts: each is used once and trains every weight of a copy of the model.

    Adam, and Adagrad by rows for the embedding. Before a batch is trained on, its classes
    are foretold: ratios counts, by bins, how much likelier they were than by counts alone.
    """

    def __init__(self, model: Attention, batch: int = 384, rate: float = 0.003, seed: int = 7, row_rate: float = 0.05):
        self.model = copy.copy(model)
        for k in model.NAMES:
            setattr(self.model, k, getattr(model, k).copy())
        self.batch, self.rate, self.row_rate, self.rng = batch, rate, row_rate, np.random.default_rng(seed)
        self.m1, self.m2 = ({k: np.zeros_like(getattr(model, k)) for k in model.NAMES if k != "E"} for _ in range(2))
        self.square, self.seen = np.zeros(len(model.E), np.float32), np.zeros(len(model.E), np.int64)
        self.ratios = np.zeros(BINS, np.int64)
        self.rest = np.zeros((0, CONTEXT + NEW), np.int32)
        self.steps = self.windows = 0

    def add(self, w: np.ndarray) -> None:
        w = np.concatenate([self.rest, w])
        w = w[self.rng.permutation(len(w))]
        whole = len(w) // self.batch * self.batch
        for i in range(0, whole, self.batch):
            self._step(w[i : i + self.batch])
        self.rest = w[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._step(self.rest)
        self.rest = self.rest[:0]

    def _step(self, w: np.ndarray) -> None:
        self.windows += len(w)
        w = w[np.argsort(self.model._used(w), kind="stable")]
        parts = [self.model.sums(w[i : i + 128]) for i in range(0, len(w), 128)]
        n = sum(len(ratio) for *_, ratio in parts)
        if not n:
            return
        self.steps += 1
        ratio = np.concatenate([ratio for *_, ratio in parts])
        self.ratios += np.bincount(np.clip(ratio / BIN + BINS // 2, 0, BINS - 1).astype(np.int64), minlength=BINS)
        t = self.steps
        for k, m1 in self.m1.items():
            g = sum(p[0][k] for p in parts) / np.float32(n)
            m1 += 0.1 * (g - m1)
            self.m2[k] += 0.01 * (g * g - self.m2[k])
            getattr(self.model, k)[...] -= self.rate * min(1.0, t / 20) * (m1 / (1 - 0.9**t)) / (np.sqrt(self.m2[k] / (1 - 0.99**t)) + 1e-6)
        seen, dx = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        order = np.argsort(seen.astype(np.uint16) if len(self.seen) <= 1 << 16 else seen, kind="stable")
        seen = seen[order]
        first = np.flatnonzero(np.append(True, seen[1:] != seen[:-1]))
        rows, g = seen[first], np.add.reduceat(dx[order], first, axis=0)
        self.seen[rows] += np.diff(np.append(first, len(seen)))
        real = rows != self.model.pad
        rows, g = rows[real], g[real]
        self.square[rows] += (g * g).mean(1)
        self.model.E[rows] -= np.float32(self.row_rate * min(1.0, t / 20)) * g / (np.sqrt(self.square[rows]) + np.float32(1e-6))[:, None]

    def table(self, start: Attention) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, rows): the weights' changes times what they count, and that count: of the id for a row of the embedding, else of the windows; then the ratios."""
        if not self.windows:
            return np.zeros(0, np.int64), np.zeros((0, DIM + 1))
        ids = np.flatnonzero(self.seen)
        rows = np.vstack([(self.model.E[ids] - start.E[ids]) * self.seen[ids, None], (_stacked(self.model) - _stacked(start)) * self.windows])
        count = np.append(self.seen[ids], np.full(len(rows) - len(ids), self.windows))
        out = np.vstack([np.column_stack([rows, count]), np.pad(self.ratios.reshape(-1, DIM), ((0, 0), (0, 1)))])
        return np.append(ids, len(start.E) + np.arange(len(out) - len(ids))), out


def _stacked(model: Attention) -> np.ndarray:
    """All weights but the embedding as rows of DIM."""
    return np.vstack([getattr(model, k).reshape(-1, DIM) for k in model.NAMES if k != "E"])


def table_rows(model: Attention) -> int:
    return len(model.E) + len(_stacked(model)) + BINS // DIM


def take_means(model: Attention, total: np.ndarray) -> tuple[int, np.ndarray]:
    """Set the weights to the means of the copies whose table() rows were summed to total; the number of windows and the ratios."""
    change = total[:, :DIM] / np.maximum(total[:, DIM:], 1)
    at = len(model.E)
    windows_ = int(total[at, DIM])
    model.E += change[:at].astype(np.float32)
    for k in model.NAMES[1:]:
        p = getattr(model, k)
        p += change[at : at + p.size // DIM].reshape(p.shape).astype(np.float32)
        at += p.size // DIM
    return windows_, total[at:, :DIM].ravel()


def frequent(counts: np.ndarray) -> np.ndarray:
    """The ids that have a class of their own, most frequent first."""
    return np.argsort(-counts, kind="stable")[: CLASSES // 2]


def features(texts: list[np.ndarray], top: np.ndarray, n: int) -> np.ndarray:
    """How often each of the frequent ids stands in the eight places before each id of its text."""
    mark = np.full(n + 1, -1)
    mark[top] = np.arange(len(top))
    gap = np.full(8, n, np.int32)
    ids = np.concatenate([x for t in texts for x in (t, gap)] or [gap])
    at = np.flatnonzero(mark[ids] >= 0)  # each with eight places after it
    before, keys = mark[ids[at]], []
    for back in range(1, 9):
        own = ids[at + back]
        ok = own < n
        keys.append(own[ok].astype(np.int64) * len(top) + before[ok])
    return np.bincount(np.concatenate(keys), minlength=n * len(top)).reshape(n, len(top))


def classes(features: np.ndarray, top: np.ndarray, begins: np.ndarray, rounds: int = 8, seed: int = 9) -> np.ndarray:
    """A class for each id that begins words, -1 for the others: half of the classes are the most frequent ids' own, the others group ids by what stands before them."""
    n, own = len(features), CLASSES // 2
    out = np.where(begins, own, -1)
    out[top] = np.arange(len(top))
    total = features.sum(1)
    rest = np.setdiff1d(np.flatnonzero((total > 0) & begins), top)
    if len(rest) > CLASSES - own:
        x = np.sqrt(features[rest] / total[rest, None])
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(rest), CLASSES - own, replace=False)]
        for _ in range(rounds):
            at = np.argmin((c * c).sum(1)[None] - 2 * x @ c.T, axis=1)
            size = np.bincount(at, total[rest], len(c))
            new = np.zeros_like(c)
            np.add.at(new, at, x * total[rest, None])
            c = np.where(size[:, None] > 0, new / np.maximum(size, 1e-9)[:, None], c)
        out[rest] = own + at
    return out
