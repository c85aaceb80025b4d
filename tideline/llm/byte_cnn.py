"""Quality classifier: a byte-level convolutional network in numpy (operator 4).

A text's UTF-8 bytes are cut into chunks of CHUNK bytes, each overlapping the one
before by half; together they cover all of it (but for filters that would start in
the last WIDTH - 1 bytes of a text that fills its last half chunk). FILTERS learned filters of WIDTH
bytes run over every place (a filter is a table of weights for each place and
byte value). A chunk is described by the greatest and the mean activation of each
filter and, through a hidden layer, by HIDDEN units; the units' greatest values
over all chunks are combined into one probability. The network is trained by
back-propagation on a bounded sample (training.sample).

Defined results: a null text counts as empty; an empty text is one chunk of
padding and gets that chunk's score; without labels of both kinds every score is
one half; repeated rows are scored one by one; extra columns pass through (those
named like an output are replaced); an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, training

CUT = 0.5
WIDTH, FILTERS, HIDDEN, CHUNK = 4, 16, 16, 256
EPOCHS, BATCH, RATE = 10, 32, 0.01
#: Bytes that are worked on at a time.
SLAB = 131_072


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        f32 = lambda *s: rng.standard_normal(s).astype(np.float32)
        self.p = {"table": f32(WIDTH, 256, FILTERS) * 0.5, "b": np.zeros(FILTERS, np.float32), "w1": f32(2 * FILTERS, HIDDEN) * 0.2, "b1": np.zeros(HIDDEN, np.float32), "w2": f32(HIDDEN) * 0.2, "b2": np.zeros(1, np.float32)}
        self.pairs: list[np.ndarray] = []

    def freeze(self) -> "Network":
        """Sums of two neighbouring places' tables, so that a place takes half as many look-ups."""
        t = self.p["table"]
        self.pairs = [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]
        return self

    def activations(self, data: np.ndarray) -> np.ndarray:
        """data: bytes, with WIDTH - 1 more at the end; an activation for each place and filter."""
        n = len(data) - WIDTH + 1
        if self.pairs:
            two = data[:-1].astype(np.int32) * 256 + data[1:]
            out = np.take(self.pairs[0], two[:n], axis=0)
            for k in range(1, WIDTH // 2):
                out += np.take(self.pairs[k], two[2 * k : 2 * k + n], axis=0)
        else:
            out = np.take(self.p["table"][0], data[:n], axis=0)
            for j in range(1, WIDTH):
                out += np.take(self.p["table"][j], data[j : j + n], axis=0)
        out += self.p["b"]
        return np.maximum(out, 0, out=out)

    def layout(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts one behind the other in half chunks: bytes, real bytes of each half, and the halves before each text."""
        half = CHUNK // 2
        counts = np.array([max(1, -(-len(r) // half)) for r in raws])
        starts = np.concatenate([[0], np.cumsum(counts)])
        data = np.zeros(starts[-1] * half + WIDTH - 1, np.uint8)
        real = np.full(starts[-1], half, np.float32)
        for r, a, c in zip(raws, starts, counts):
            data[a * half : a * half + len(r)] = np.frombuffer(r, np.uint8)
            # A filter may not read into the next text: places that lack room before it don't count.
            real[a + c - 1] = max(1, min(len(r) - (c - 1) * half, half - WIDTH + 1))
        return data, real, starts

    def halves(self, data: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest and summed activation of each half chunk, for real bytes alone."""
        half = CHUNK // 2
        top, total = np.empty((len(real), FILTERS), np.float32), np.empty((len(real), FILTERS), np.float32)
        step = max(1, SLAB // half)
        for a in range(0, len(real), step):
            b = min(a + step, len(real))
            act = self.activations(data[a * half : b * half + WIDTH - 1]).reshape(b - a, half, FILTERS)
            for i in np.flatnonzero(real[a:b] < half):
                act[i, int(real[a + i]) :] = 0
            top[a:b], total[a:b] = act.max(axis=1), act.sum(axis=1)
        return top, total

    def chunks(self, top, total, real, starts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of the chunks, the first half of each, and the chunks before each text. A text of one half is one chunk."""
        last = np.zeros(len(real), bool)
        last[starts[1:] - 1] = True
        single = np.diff(starts) == 1
        first = np.flatnonzero(~last | np.isin(np.arange(len(real)), starts[:-1][single]))
        alone = last[first]
        second = np.where(alone, first, np.minimum(first + 1, len(real) - 1))
        mx = np.maximum(top[first], top[second])
        n = np.where(alone, real[first], real[first] + real[second])
        mean = np.where(alone[:, None], total[first], total[first] + total[second]) / n[:, None]
        return np.concatenate([mx, mean], axis=1), first, np.searchsorted(first, starts)

    def forward(self, raws: list[bytes]):
        data, real, starts = self.layout(raws)
        top, total = self.halves(data, real)
        x, first, begin = self.chunks(top, total, real, starts)
        h = np.maximum(x @ self.p["w1"] + self.p["b1"], 0)
        pooled = np.maximum.reduceat(h, begin[:-1], axis=0)
        score = 1 / (1 + np.exp(-np.clip(pooled @ self.p["w2"] + self.p["b2"], -30, 30)))
        return score, (data, real, starts, x, first, begin, h, pooled)

    def gradients(self, raws: list[bytes], y: np.ndarray):
        score, (data, real, starts, x, first, begin, h, pooled) = self.forward(raws)
        half = CHUNK // 2
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        out = ((score - y) / len(y)).astype(np.float32)
        g["w2"], g["b2"] = pooled.T @ out, out.sum(keepdims=True)
        dh = np.zeros_like(h)
        units = np.arange(HIDDEN)
        for d in range(len(raws)):  # only the chunk that gave a unit its greatest value learns
            part = h[begin[d] : begin[d + 1]]
            dh[begin[d] + part.argmax(axis=0), units] += out[d] * self.p["w2"]
        dh *= h > 0
        hit = np.flatnonzero(dh.any(axis=1))
        g["w1"], g["b1"] = x[hit].T @ dh[hit], dh[hit].sum(axis=0)
        dx = dh[hit] @ self.p["w1"].T
        at = first[hit]
        spans = np.minimum(at[:, None] * half + np.arange(CHUNK + WIDTH - 1), len(data) - 1)
        alone = np.isin(at, starts[1:] - 1)
        size = np.where(alone, real[at], real[at] + real[np.minimum(at + 1, len(real) - 1)])
        for a in range(0, len(hit), 256):
            raw = data[spans[a : a + 256]]
            act = self.p["b"] + sum(self.p["table"][j][raw[:, j : j + CHUNK]] for j in range(WIDTH))
            inside = np.arange(CHUNK) < size[a : a + 256, None]
            act = np.where(inside[:, :, None], np.maximum(act, 0), 0)
            da = np.where(act > 0, (dx[a : a + 256, FILTERS:] / size[a : a + 256, None])[:, None, :], 0)
            best = act.argmax(axis=1)
            rows = np.arange(len(raw))[:, None]
            peak = act[rows, best, np.arange(FILTERS)] > 0
            np.add.at(da, (np.broadcast_to(rows, best.shape), best, np.broadcast_to(np.arange(FILTERS), best.shape)), dx[a : a + 256, :FILTERS] * peak)
            g["b"] += da.sum(axis=(0, 1))
            flat = da.reshape(-1, FILTERS)
            for j in range(WIDTH):
                codes = raw[:, j : j + CHUNK].ravel()
                for f in range(FILTERS):
                    g["table"][j, :, f] += np.bincount(codes, weights=flat[:, f], minlength=256).astype(np.float32)
        return score, g

    def fit(self, raws: list[bytes], ys: list[int], epochs: int = EPOCHS) -> "Network":
        rng, y = np.random.default_rng(9), np.array(ys, np.float32)
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for e in range(epochs):
            order, rate = rng.permutation(len(raws)), RATE * (1 - e / epochs) + 1e-3
            for a in range(0, len(order), BATCH):
                part = order[a : a + BATCH]
                _, g = self.gradients([raws[i] for i in part], y[part])
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self


def fit(texts: list[str], ys: list[int]) -> Network:
    net = Network()
    if not ys or min(ys) == max(ys):
        net.p["w2"][:] = 0
        return net.freeze()
    return net.fit([t.encode("utf-8", "surrogatepass") for t in texts], ys).freeze()


def score_documents(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """docs with score (double, 0 to 1: how likely label 1 is)."""
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(net.p)

    def made(batch):
        own, scores = Network(), []
        own.p = sent.value
        own.freeze()
        for texts in common.text_slices(batch.column(batch.schema.get_field_index(text))):
            scores += own.forward([t.encode("utf-8", "surrogatepass") for t in texts])[0].tolist()
        return [pa.array(scores, pa.float64())]

    return common.add_columns(docs, made, "score double")


def op4(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels")
    scored = score_documents(docs, fit(*training.sample(docs, labels, "quality")))
    return scored.select("doc_id", training.held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
