"""Toxic spans by a linear-chain conditional random field (operator 3).

A chain of two states (clean, toxic) runs over a text's words. A word's features
are itself, its first and last three letters, its shape, how far it leans to toxic
documents, and the words before and after it; features of fewer than LEAST_CONTEXTS different contexts in the sample
aren't used. Labels name documents, so they label the tokens in part: all tokens of a
clean document are clean, and a toxic one has a toxic token somewhere. The chain is
fitted to that by gradient ascent: with P0 the probability of the path that is
clean throughout, a clean document's likelihood is P0 and a toxic one's 1 - P0,
both mixed with a chance NOISE of a wrong label. The gradient comes from
forward-backward marginals, which also say which tokens of a toxic document it
blames. Copies of a sample document count once.

A document's score is a logistic function of the log odds of P0, the highest
marginal and their sum; runs of tokens whose marginal is at least a half are its
offending spans.

Defined results: null and empty texts have no tokens and get the score of a text
without toxic tokens; without labels of both kinds every score is 0; repeated rows
are scored one by one; extra columns pass through (those named like an output are
replaced); an empty table gives an empty table.
"""

from __future__ import annotations

import re
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, training

CUT = 0.7
WORD = re.compile(r"[^\W_]+")
#: A feature stands in so many different contexts (words before and after) of the sample at least.
LEAST_CONTEXTS = 5
#: Steps of a feature that says how many standard deviations more contexts in toxic sample documents a word has than chance lets it.
SURPLUS = (2, 4, 8)
#: The chain is fitted to sample documents of so many tokens at most, and so many tokens in all.
FIT_TOKENS, FIT_TOTAL = 1500, 400_000
#: Chance that a document's label is wrong; steps of the ascent, their size and the pull to 0, of words themselves and of features that words share.
NOISE, ROUNDS, RATE, SHRINK, SHRINK_SHARED = 0.03, 40, 0.25, 0.01, 0.1
#: Words whose weights a worker remembers, and tokens of texts whose chains are worked out together.
REMEMBERED, TOGETHER = 100_000, 200_000


def tokens(text: str) -> list[str]:
    return WORD.findall(text)


def shape_of(word: str) -> str:
    kind = "a" if word.islower() else "9" if word.isdigit() else "A" if word.isupper() else "Aa" if word[:1].isupper() else "x"
    return f"{kind}{min(len(word), 9)}"


def features(word: str) -> tuple[list[str], str, str]:
    """A word's features for its own place, for the place after it and for the place before it."""
    low = word.lower()
    return ["w" + low, "p" + low[:3], "s" + low[-3:], "f" + shape_of(word)], "b" + low, "a" + low


class Chain:
    """arc: log weights of the steps clean to toxic, toxic to clean and toxic to toxic (clean to clean is 0); start: of a toxic first token."""

    def __init__(self):
        self.arc, self.start = np.array([0.0, 0.0, 0.0]), 0.0

    def messages(self, emit: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of toxic at each token: by the past and the token itself, and by the future.

        Each odds follow from those of the token before (after). All tokens are worked
        out at once from a guess, and again as long as what they follow from has
        changed; that dies away fast, since a step of the chain forgets."""
        a01, a10, a11 = np.exp(self.arc)
        odds = np.clip(np.where(first, self.start, np.log(a01)) + emit, -40, 40)
        todo = np.flatnonzero(~first)
        while len(todo):
            e = np.exp(odds[todo - 1])
            new = np.clip(np.log((a01 + a11 * e) / (1 + a10 * e)) + emit[todo], -40, 40)
            moved = todo[np.abs(new - odds[todo]) > 1e-10]
            odds[todo] = new
            todo = moved[~last[moved]] + 1
        ahead = np.where(last, 0.0, np.log(a10))
        todo = np.flatnonzero(~last)
        while len(todo):
            e = np.exp(np.clip(ahead[todo + 1] + emit[todo + 1], -40, 40))
            new = np.log((a10 + a11 * e) / (1 + a01 * e))
            moved = todo[np.abs(new - ahead[todo]) > 1e-10]
            ahead[todo] = new
            todo = moved[~first[moved]] - 1
        return odds, ahead

    def run(self, emit: np.ndarray, lens: np.ndarray, steps: bool = False):
        """P(toxic) of each token and log P0 of each text; if asked for, the expected steps of each text. emit: of all texts on end, of lens tokens each (one or more)."""
        starts = np.cumsum(lens) - lens
        first, last = np.zeros(len(emit), bool), np.zeros(len(emit), bool)
        first[starts], last[starts + lens - 1] = True, True
        odds, ahead = self.messages(emit, first, last)
        a01, a10, a11 = np.exp(self.arc)
        f = np.exp(odds)
        grown = np.log1p(np.where(last, f, a10 * f))
        log_p0 = -np.add.reduceat(grown, starts)
        p = 1 / (1 + np.exp(-(odds + ahead)))
        if not steps:
            return p, log_p0
        expected = np.zeros((len(lens), 3))
        if len(emit) > 1:
            f, g = f[:-1], np.exp(np.clip(ahead[1:] + emit[1:], -40, 40))
            joint = [a01 * g, a10 * f, a11 * f * g]
            total = 1 + joint[0] + joint[1] + joint[2]
            for k, j in enumerate(joint):
                expected[:, k] = np.add.reduceat(np.append(np.where(last[:-1], 0, j / total), 0.0), starts)
        return p, log_p0, expected


class Model:
    """weight: of each feature, the first for every token; words not seen yet get theirs from their features."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.leaning: dict[str, int] = {}
        self.weight = np.array([-30.0])
        self.chain = Chain()
        self.scale = np.array([-30.0, 0.0, 0.0, 0.0])
        self.memo: dict[str, int] = {}
        self.table = np.zeros((0, 3))
        self.by_kind: dict[str, dict] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "table": np.zeros((0, 3)), "by_kind": {}}

    def ids(self, word: str) -> tuple[list[int], int, int]:
        own, after, before = features(word)
        get = self.names.get
        return [*[get(f, 0) for f in own], get(f"l{self.leaning.get(word)}", 0)], get(after, 0), get(before, 0)

    def weights(self) -> dict[str, dict]:
        """The weights by kind of feature, for quick looks."""
        if not self.by_kind:
            self.by_kind = {k: {} for k in "wpsfbal"}
            for f, i in self.names.items():
                self.by_kind[f[0]][f[1:]] = float(self.weight[i])
            self.by_kind["l"] = {w: self.by_kind["l"].get(str(x), 0.0) for w, x in self.leaning.items()}
        return self.by_kind

    def rows(self, words) -> list[tuple[float, float, float]]:
        """The weights of words at their own place, after it and before it."""
        own, first, last, shape, after, before, leaning = (self.weights()[k].get for k in "wpsfbal")
        out = []
        for word in words:
            low = word.lower()
            out.append((own(low, 0.0) + first(low[:3], 0.0) + last(low[-3:], 0.0) + shape(shape_of(word), 0.0) + leaning(word, 0.0), after(low, 0.0), before(low, 0.0)))
        return out

    def emission(self, texts: list[list[str]]) -> np.ndarray:
        """The log weight of the toxic state at each word of texts, one behind the other. The first REMEMBERED words that come are remembered."""
        memo, lens = self.memo, np.array(list(map(len, texts)))
        new = set(chain.from_iterable(texts)).difference(memo)
        if new and len(memo) < REMEMBERED:
            keep = list(islice(new, REMEMBERED - len(memo)))
            self.table = np.concatenate([self.table, self.rows(keep)])
            memo.update(zip(keep, range(len(memo), len(memo) + len(keep))))
            new.difference_update(keep)
        rare = list(new)
        extra = dict(zip(rare, range(len(memo), len(memo) + len(rare))))
        table = np.concatenate([self.table, self.rows(rare)]) if rare else self.table
        get, other = memo.get, extra.get
        e = table[np.fromiter((get(w) if w in memo else other(w) for w in chain.from_iterable(texts)) if rare else map(get, chain.from_iterable(texts)), np.int64, lens.sum())]
        out, inside = self.weight[0] + e[:, 0], np.ones(len(e), bool)
        inside[np.cumsum(lens) - lens] = False
        out[1:] += np.where(inside[1:], e[:-1, 1], 0)
        out[:-1] += np.where(inside[1:], e[1:, 2], 0)
        return out

    def judged(self, texts: list[list[str]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """What the documents' scores are made of, and the marginals."""
        out, p = np.zeros((len(texts), 3)), [np.zeros(0)] * len(texts)
        out[:, 0] = -12.0
        full = [i for i, w in enumerate(texts) if w]
        a = 0
        while a < len(full):
            b, held = a, 0
            while b < len(full) and (b == a or held + len(texts[full[b]]) <= TOGETHER):
                held += len(texts[full[b]])
                b += 1
            at = full[a:b]
            lens = np.array([len(texts[i]) for i in at])
            m, q = self.chain.run(self.emission([texts[i] for i in at]), lens)
            starts = np.cumsum(lens) - lens
            out[at, 0] = np.clip(np.log(np.maximum(-np.expm1(q), 1e-12)) - q, -12, 12)
            out[at, 1], out[at, 2] = np.maximum.reduceat(m, starts), np.minimum(np.add.reduceat(m, starts), 8.0)
            for i, part in zip(at, np.split(m, starts[1:])):
                p[i] = part
            a = b
        return out, p

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        x, p = self.judged([tokens(t) for t in texts])
        spans = []
        for t, m in zip(texts, p):
            run: list[tuple[int, int]] = []
            if m.size and m.max() >= 0.5:
                before = False
                for hit, v in zip(WORD.finditer(t), m):
                    if v >= 0.5:
                        run[-1:] = [(run[-1][0], hit.end())] if before else [*run[-1:], (hit.start(), hit.end())]
                    before = v >= 0.5
            spans.append(run)
        return 1 / (1 + np.exp(-np.clip(x @ self.scale[1:] + self.scale[0], -30, 30))), spans


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Bias and weights by Newton's method with a small ridge."""
    z, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(len(w))
        w += np.linalg.solve(h, z.T @ (y - p) - 0.05 * w)
    return w


class Sample:
    """Sample texts as places of a vocabulary, and the gradient of the chain's likelihood."""

    def __init__(self, texts: list[list[str]], ys: list[int], model: Model):
        vocabulary: dict[str, int] = {}
        self.seqs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t]) for t in texts]
        self.y = np.array(ys)
        # Near copies repeat their words in the same surroundings, so a feature's different contexts are counted.
        bound = [np.concatenate([[-1], s, [-1]]) for s in self.seqs]
        contexts = np.unique(np.concatenate([np.stack([b[:-2], b[1:-1], b[2:], np.full(len(b) - 2, y)], axis=1) for b, y in zip(bound, ys)]), axis=0)
        every, toxic = (np.bincount(c[:, 1], minlength=len(vocabulary)) for c in (contexts, contexts[contexts[:, 3] == 1]))
        share = toxic.sum() / max(1, every.sum())
        # By chance a word of c contexts would have c * share in toxic documents, give or take the square root.
        surplus = (toxic - every * share) / np.sqrt(np.maximum(every * share * (1 - share), 0.25))
        model.leaning = {w: SURPLUS[k - 1] for w, k, n in zip(vocabulary, np.searchsorted(SURPLUS, surplus, side="right").tolist(), toxic.tolist()) if k and n >= LEAST_CONTEXTS}
        seen: dict[str, int] = {f"l{x}": LEAST_CONTEXTS for x in SURPLUS}
        for word, n in zip(vocabulary, every.tolist()):
            own, after, before = features(word)
            for f in (*own, after, before):
                seen[f] = seen.get(f, 0) + n
        for f in sorted(f for f, n in seen.items() if n >= LEAST_CONTEXTS):
            model.names[f] = len(model.names) + 1
        model.weight = np.zeros(len(model.names) + 1)
        ids = [model.ids(w) for w in vocabulary]
        self.own, self.after, self.before = np.array([i[0] for i in ids]), np.array([i[1] for i in ids]), np.array([i[2] for i in ids])
        self.model, self.flat = model, np.concatenate(self.seqs)
        self.lens = np.array(list(map(len, self.seqs)))
        ends = np.cumsum(self.lens)
        self.first, self.last = np.zeros(len(self.flat), bool), np.zeros(len(self.flat), bool)
        self.first[np.concatenate([[0], ends[:-1]])], self.last[ends - 1] = True, True

    def emissions(self) -> np.ndarray:
        w = self.model.weight.copy()
        bias, w[0] = w[0], 0.0
        own, flat = w[self.own].sum(axis=1), self.flat
        out = bias + own[flat]
        out[1:] += np.where(self.first[1:], 0, w[self.after][flat[:-1]])
        out[:-1] += np.where(self.last[:-1], 0, w[self.before][flat[1:]])
        return out

    def likelihood(self) -> tuple[float, np.ndarray, np.ndarray, float]:
        """The log likelihood, and its gradient by weight, arc and start."""
        p, log_p0, steps = self.model.chain.run(self.emissions(), self.lens, steps=True)
        p0 = np.exp(log_p0)
        chance = np.where(self.y == 1, NOISE + (1 - 2 * NOISE) * -np.expm1(log_p0), NOISE + (1 - 2 * NOISE) * p0)
        # The clean path has no features, so d P0 = - P0 E[f].
        share = (1 - 2 * NOISE) * p0 / chance * np.where(self.y == 1, 1, -1)
        g = p * np.repeat(share, self.lens)
        per = lambda v, w: np.bincount(v, weights=w, minlength=len(self.own))
        n = len(self.model.weight)
        by_word = per(self.flat, g)
        out = sum(np.bincount(self.own[:, k], weights=by_word, minlength=n) for k in range(self.own.shape[1]))
        out = out + np.bincount(self.after, weights=per(self.flat[:-1], np.where(self.first[1:], 0, g[1:])), minlength=n)
        out = out + np.bincount(self.before, weights=per(self.flat[1:], np.where(self.last[:-1], 0, g[:-1])), minlength=n)
        out[0] = g.sum()
        return float(np.log(chance).sum()), out, share @ steps, float(g[self.first].sum())


def fit(texts: list[str], ys: list[int]) -> Model:
    model, one = Model(), {}
    for t, y in zip(texts, ys):
        one.setdefault(t, y)
    words = [tokens(t) for t in one]
    y = np.array(list(one.values()))
    if not len(y) or y.min() == y.max():
        return model
    ascend(model, words, y)
    model.scale = logistic(model.judged(words)[0], y)
    return model


def ascend(model: Model, words: list[list[str]], y: np.ndarray) -> None:
    """Fit the model's features, weights and chain."""
    used, total = [], 0
    for i, w in enumerate(words):
        if 0 < len(w) <= FIT_TOKENS and total + len(w) <= FIT_TOTAL:
            used.append(i)
            total += len(w)
    if not used or len(set(y[used].tolist())) < 2:
        return
    sample = Sample([words[i] for i in used], y[used].tolist(), model)
    model.weight[0] = -5.0
    pull = np.array([0.0, *(SHRINK if f[0] in "wl" else SHRINK_SHARED for f in model.names)])
    size = len(model.weight) + 4
    m, v = np.zeros(size), np.zeros(size)
    for step in range(1, ROUNDS + 1):
        _, g, arc, start = sample.likelihood()
        g -= pull * model.weight
        g = np.concatenate([g, arc, [start]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 0.1)
        model.weight += move[: len(model.weight)]
        model.chain.arc = np.clip(model.chain.arc + move[-4:-1], -6, 6)
        model.chain.start = float(np.clip(model.chain.start + move[-1], -6, 6))


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (double, 0 to 1) and toxic_spans (array of start and end, code points)."""
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def made(batch):
        scores, spans = [], []
        for texts in common.text_slices(batch.column(batch.schema.get_field_index(text))):
            s, r = sent.value.score(texts)
            scores += s.tolist()
            spans += [[{"start": x, "end": z} for x, z in one] for one in r]
        return [pa.array(scores, pa.float64()), pa.array(spans, kind)]

    return common.add_columns(docs, made, "score double, toxic_spans array<struct<start:bigint,end:bigint>>")


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*training.sample(docs, labels, "toxic"))


def remove_toxic(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, cut: float = CUT) -> DataFrame:
    """The rows of docs whose score is under cut, all columns. The model is fitted on corpus (docs if not given)."""
    rows, back = common.packed(docs, "text")
    scored = score_documents(rows, trained(docs if corpus is None else corpus, labels))
    return scored.where(F.col("score") < cut).select(*back)


def op3(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels")
    scored = score_documents(docs, trained(docs, labels))
    return scored.select("doc_id", training.held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))
