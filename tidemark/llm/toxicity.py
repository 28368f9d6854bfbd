"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word has two kinds of inputs, both learned from the labelled sample: the log-odds of the word itself, and those of its
characters (its beginnings of 2 to 8 letters and its runs of 4; the largest and the mean of each kind). They are kept in sorted arrays of 64-bit
names. A window of ``WINDOW`` words is read forwards and backwards by gated recurrent units, the states are pooled
by attention, and a logistic unit gives the window's probability. Windows overlap by half and cover the whole
text; a logistic pooling of the largest logit, the sum of the probabilities and the number of windows is its score. Labels are of documents, so training picks the most telling
window of each toxic one, and of clean ones the most telling and others; inputs of a training window come from the other
half of the sample, so that the network doesn't learn to trust words that it has seen once.

Cases: null texts and texts without letters are one window without words and get its score, which is low. Without labelled
rows of both kinds every score is 0. Words of over ``LETTERS`` letters are read as several. Texts of any length are scored
whole. Repeated rows get equal results, one row each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare

WINDOW, STRIDE = 20, 10
LETTERS = 20
HIDDEN = 6
#: Documents of the training sample: the bound of what the driver gathers.
TOXIC_SAMPLE, CLEAN_SAMPLE = 600, 1200
#: Likelihood ratio (chi-squared with one degree of freedom) from which a feature counts: chance gives it to none of 100,000.
EVIDENCE = 20.0
#: Score from which a document is predicted toxic.
THRESHOLD = 0.3
SEED = 11
_WORDS = re.compile(rf"[^\W\d_]{{1,{LETTERS}}}")
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Columns of a word's features: the word, beginnings of 2 to 8 letters, runs of four letters.
_BEGINNINGS, _RUN = range(2, 9), 4
_KINDS = ((0, 1), (1, 1 + len(_BEGINNINGS)), (1 + len(_BEGINNINGS), 1 + len(_BEGINNINGS) + LETTERS - _RUN + 1))
_INPUTS = 5
#: Words whose features are made at a time; parts of the names counted at a time; documents that a sample may hold.
_CHUNK, _PARTS, _DOCUMENTS = 32_768, 16, 1 << 14


def _mixed(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def features(words: list[str]) -> np.ndarray:
    """64-bit names of each word's features, one column each; 0 where the word is too short."""
    if not len(words):
        return np.zeros((0, _KINDS[-1][1]), np.uint64)
    letters = np.array(words, f"U{LETTERS}").view(np.uint32).reshape(len(words), LETTERS).astype(np.uint64)
    size = (letters > 0).sum(1)
    power = np.cumprod(np.full(LETTERS, _STEP))
    begun = np.cumsum(letters * power, axis=1, dtype=np.uint64)
    cols = [_mixed(begun[:, -1], 1)]
    cols += [np.where(size >= k, _mixed(begun[:, k - 1], 2), np.uint64(0)) for k in _BEGINNINGS]
    run = np.zeros((len(words), LETTERS - _RUN + 1), np.uint64)
    for k in range(_RUN):
        run += letters[:, k : k + LETTERS - _RUN + 1] * power[k]
    run = np.where(letters[:, _RUN - 1 :] > 0, _mixed(run, 3), np.uint64(0))
    return np.column_stack([*cols, run])


def _words(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """For all texts' words in order their place among the different ones, these, and the number of words of each text."""
    each = [_WORDS.findall(x.lower()) for x in texts]
    sizes = np.array([len(x) for x in each], np.int64)
    codes, different = pd.factorize(np.array([w for x in each for w in x], object)) if sizes.sum() else (np.zeros(0, np.int64), [])
    return codes, list(different), sizes


class Lexicon:
    """Log-odds of features that toxic documents of the sample hold more often than others."""

    def __init__(self, keys: np.ndarray, odds: np.ndarray):
        self.keys, self.odds = keys, odds

    @classmethod
    def learned(cls, texts: list[str], toxic: np.ndarray) -> Lexicon:
        codes, words, sizes = _words(texts)
        n = len(texts)
        pairs = np.unique(codes.astype(np.int64) * n + np.repeat(np.arange(n), sizes))
        word, owner = pairs // n, (pairs % n).astype(np.uint64)
        names = np.concatenate([features(words[a : a + _CHUNK]) for a in range(0, len(words), _CHUNK)] or [features([])])
        n1, n0 = toxic.sum(), (~toxic).sum()
        share, low = n1 / (n1 + n0), np.uint64(_DOCUMENTS - 1)
        keys, odds = [], []
        for part in range(_PARTS):  # a part of all names at a time, so that memory stays small
            seen = []
            for k in range(names.shape[1]):
                own = names[word, k]
                pick = (own >> np.uint64(60) == part) & (own != 0)
                seen.append(own[pick] & ~low | owner[pick])  # the name's upper bits, then the document: each pair counts once
            once = np.unique(np.concatenate(seen))
            some, at = np.unique(once & ~low, return_inverse=True)
            kind = toxic[(once & low).astype(np.int64)]
            df1, df0 = np.bincount(at[kind], minlength=len(some)), np.bincount(at[~kind], minlength=len(some))
            lo = np.log((df1 + 0.5) / (n1 + 1)) - np.log((df0 + 0.5) / (n0 + 1))
            df = df1 + df0
            gain = 2 * (df1 * np.log(np.maximum(df1, 1) / (df * share)) + df0 * np.log(np.maximum(df0, 1) / (df * (1 - share))))
            keep = (df1 >= 3) & (lo >= 1.2) & (gain >= EVIDENCE)
            keys.append(some[keep])
            odds.append(lo[keep])
        keys, odds = np.concatenate(keys), np.concatenate(odds)
        order = np.argsort(keys)
        return cls(keys[order], odds[order].astype(np.float32))

    def inputs(self, words: list[str]) -> np.ndarray:
        """The network's inputs for each word."""
        if not len(self.keys) or not len(words):
            return np.zeros((len(words), _INPUTS), np.float32)
        if len(words) > _CHUNK:
            return np.concatenate([self.inputs(words[a : a + _CHUNK]) for a in range(0, len(words), _CHUNK)])
        names = features(words)
        cut = names & ~np.uint64(_DOCUMENTS - 1)
        at = np.searchsorted(self.keys, cut)
        at[at == len(self.keys)] = 0
        odds = np.where((self.keys[at] == cut) & (names != 0), self.odds[at], np.float32(0)) / np.float32(4)
        (_, a), (b, c), (d, _) = _KINDS
        filled = np.maximum(1, (names != 0)[:, b:c].sum(1)), np.maximum(1, (names != 0)[:, d:].sum(1))
        return np.column_stack([odds[:, 0], odds[:, b:c].max(1), odds[:, b:c].sum(1) / filled[0], odds[:, d:].max(1), odds[:, d:].sum(1) / filled[1]]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Two gated recurrent units, attention over their states, and a logistic output."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, hidden: int = HIDDEN, seed: int = SEED):
        if weights is None:
            rng = np.random.default_rng(seed)
            rand = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
            weights = {f"{k}{d}": v for d in "fb" for k, v in (("W", rand(_INPUTS, 3 * hidden)), ("U", rand(hidden, 3 * hidden)), ("b", np.zeros(3 * hidden, np.float32)))}
            weights |= {"att": rand(2 * hidden), "out": rand(2 * hidden), "bias": np.full(1, -1, np.float32)}
        self.w = weights
        self.h = len(weights["out"]) // 2

    def _direction(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        w, u, b, h = self.w["W" + d], self.w["U" + d], self.w["b" + d], self.h
        n, steps, _ = x.shape
        given = (x.reshape(-1, x.shape[2]) @ w + b).reshape(n, steps, 3 * h)
        out = np.empty((n, steps, h), np.float32)
        state = np.zeros((n, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            own = state @ u
            gates = _sigmoid(given[:, t, : 2 * h] + own[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(given[:, t, 2 * h :] + r * own[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, z, r, new, own[:, 2 * h :]))
            state = new + z * (state - new)
            out[:, t] = state
        return out

    def forward(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows (window, word, input)."""
        tapes = {d: [] if keep is not None else None for d in "fb"}
        states = np.concatenate([self._direction(x, d, tapes[d]) for d in "fb"], axis=2)
        shape = np.tanh(states)
        e = np.exp(shape @ self.w["att"] * 4)
        a = e / e.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", a, states)
        if keep is not None:
            keep.update(tapes=tapes, states=states, shape=shape, a=a, pooled=pooled)
        return pooled @ self.w["out"] * 4 + self.w["bias"]

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        k: dict = {}
        p = _sigmoid(self.forward(x, k))
        g = ((p - y) * weight / weight.sum()).astype(np.float32)
        out = {"bias": g.sum(keepdims=True), "out": 4 * (k["pooled"].T @ g)}
        dpool = 4 * g[:, None] * self.w["out"]
        da = np.einsum("nh,nth->nt", dpool, k["states"])
        de = 4 * k["a"] * (da - (k["a"] * da).sum(1, keepdims=True))
        out["att"] = np.einsum("nt,nth->h", de, k["shape"])
        dstates = k["a"][:, :, None] * dpool[:, None, :] + de[:, :, None] * self.w["att"] * (1 - k["shape"] ** 2)
        for d, part in (("f", slice(0, self.h)), ("b", slice(self.h, None))):
            u = self.w["U" + d]
            dw, du, db = np.zeros_like(self.w["W" + d]), np.zeros_like(u), np.zeros_like(self.w["b" + d])
            back = np.zeros((len(x), self.h), np.float32)
            for t, before, z, r, new, own in reversed(k["tapes"][d]):
                back = back + dstates[:, t, part]
                dz = back * (before - new) * z * (1 - z)
                dn = back * (1 - z) * (1 - new**2)
                dr = dn * own * r * (1 - r)
                gx, gh = np.concatenate([dz, dr, dn], 1), np.concatenate([dz, dr, dn * r], 1)
                dw += x[:, t].T @ gx
                du += before.T @ gh
                db += gx.sum(0)
                back = back * z + gh @ u.T
            out |= {"W" + d: dw, "U" + d: du, "b" + d: db}
        return out

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, rng: np.random.Generator, rate: float = 0.02, batch: int = 256) -> None:
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(v) for k, v in self.w.items()}
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        for s in range(1, steps + 1):
            pick = rng.integers(0, len(y), batch)
            for k, g in self.gradients(x[pick], y[pick], weight[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                step = rate * (1 - s / (steps + 1)) * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-6)
                self.w[k] = (self.w[k] - step).astype(np.float32)


def _windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word (among its text's) and text of all windows; a text has at least one."""
    each = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(sizes)), each)
    return (np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)) * STRIDE, owner


def _evidence(logits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """What windows say of a document: the largest logit, log of the summed probabilities, log of the number of windows."""
    best = np.full(n, -np.inf)
    np.maximum.at(best, owner, logits)
    total = np.bincount(owner, _sigmoid(logits), n)
    return np.column_stack([best, np.log(total), np.log(np.bincount(owner, minlength=n)), np.ones(n)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


class Scorer:
    def __init__(self, lexicon: Lexicon, network: Network, pooling: np.ndarray):
        self.lexicon, self.network, self.pooling = lexicon, network, pooling

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of different words, with one more of zeros; word numbers of each window; owners."""
        codes, words, sizes = _words(texts)
        x = np.concatenate([self.lexicon.inputs(words), np.zeros((1, _INPUTS), np.float32)])
        first, owner = _windows(sizes)
        begin = np.cumsum(sizes) - sizes
        place = first[:, None] + np.arange(WINDOW)
        inside = place < sizes[owner][:, None]
        at = np.where(inside, codes[np.minimum(begin[owner][:, None] + place, max(0, len(codes) - 1))] if len(codes) else 0, len(words))
        return x, at, owner

    def logits(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Every window's logit. Windows without any known feature are alike and computed once."""
        told = np.flatnonzero((x != 0).any(1)[at].any(1))
        out = np.full(len(at), self.network.forward(np.zeros((1, WINDOW, _INPUTS), np.float32))[0], float)
        for a in range(0, len(told), 8192):
            out[told[a : a + 8192]] = self.network.forward(x[at[told[a : a + 8192]]])
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of each text, from all its windows."""
        if not texts:
            return np.zeros(0)
        x, at, owner = self.windows(texts)
        return _sigmoid(_evidence(self.logits(x, at), owner, len(texts)) @ self.pooling)


def learn(texts: list[str], toxic: np.ndarray, seed: int = SEED) -> Scorer | None:
    """Lexicon and network from labelled texts; nothing without both kinds."""
    if not toxic.any() or toxic.all():
        return None
    rng = np.random.default_rng(seed)
    half = np.zeros(len(texts), bool)
    for kind in (True, False):  # the halves hold the same part of both kinds
        half[np.flatnonzero(toxic == kind)[::2]] = True
    network = Network(seed=seed)
    parts = []
    for side in (True, False):
        pick = np.flatnonzero(half != side)
        other = Lexicon.learned([texts[i] for i in np.flatnonzero(half == side)], toxic[half == side])
        parts.append((Scorer(other, network, np.zeros(4)).windows([texts[i] for i in pick]), toxic[pick]))
    for steps, model in ((400, False), (200, True)):
        xs, ys = [], []
        for (x, at, owner), t in parts:
            if not len(t):
                continue
            if model:
                strength = Scorer(None, network, None).logits(x, at)
            else:
                strength = x.sum(1)[at].max(1)
            order = np.lexsort((-strength, owner))
            top = order[np.unique(owner[order], return_index=True)[1]]
            some = rng.integers(0, len(owner), 2 * len(t))
            some = some[~t[owner[some]]]
            pick = np.concatenate([top, some])
            xs.append(x[at[pick]])
            ys.append(t[owner[pick]].astype(np.float32))
        network.train(np.concatenate(xs), np.concatenate(ys), steps, rng)
    told = [(_evidence(Scorer(None, network, None).logits(x, at), owner, len(t)), t) for (x, at, owner), t in parts if len(t)]
    return Scorer(Lexicon.learned(texts, toxic), network, _logistic(np.concatenate([e for e, _ in told]), np.concatenate([t for _, t in told]).astype(float)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", toxic_sample: int = TOXIC_SAMPLE, clean_sample: int = CLEAN_SAMPLE) -> Scorer | None:
    """Learns from a sample of labelled documents that a hash of the key picks; a key with several labels counts as toxic if one says so."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("__label"))
    sizes = {r[0]: r[1] for r in known.groupBy(F.col("__label") > 0).count().collect()}
    share = F.when(F.col("__label") > 0, min(1.0, toxic_sample / max(1, sizes.get(True, 0)))).otherwise(min(1.0, clean_sample / max(1, sizes.get(False, 0))))
    picked = known.where(F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * (toxic_sample + clean_sample))
    # at most 2 * (toxic_sample + clean_sample) keys: small enough to broadcast whatever the input
    rows = docs.select(key, text).join(F.broadcast(picked), key).select(key, text, "__label").limit(2 * (toxic_sample + clean_sample)).collect()
    rows.sort(key=lambda r: (r[0], r[1] or ""))
    return learn([r[1] or "" for r in rows], np.array([r[2] > 0 for r in rows], bool))


def score(docs: DataFrame, scorer: Scorer | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns named in keep with score of each whole text."""
    spark = docs.sparkSession
    prepare(spark)
    out, k = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text")), len(keep)
    held = spark.sparkContext.broadcast((scorer.lexicon.keys, scorer.lexicon.odds, scorer.network.w, scorer.pooling) if scorer else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(Lexicon(*held.value[:2]), Network(held.value[2]), held.value[3]) if held.value else None
        for b in batches:
            texts = [x or "" for x in b.column(k).to_pylist()]
            found = own.scores(texts) if own else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(found, pa.float64())], names=[*keep, "score"])

    return out.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema[:-1]), "score double"]))
