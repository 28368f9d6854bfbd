"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order tree of byte contexts (0 to ``ORDER`` preceding bytes). A byte costs
``-log2 p`` bits: ``p = n(context, byte) / (T + U)`` where the context has seen it, else the escape
probability ``U / (T + U)`` times the byte's probability in the next shorter context (T: bytes seen in the
context, U: different ones). A context that the tree does not hold passes on at no cost; below order 0
every byte has 1/256. Statistics are frozen after the fit, so a byte's cost depends on ``ORDER + 1`` bytes
alone: the fit resolves the escape chain for every known gram once, and a text's exact code length is a
sum of table look-ups, done in numpy for a whole batch.

Cases: null text and text without any letter give ``und`` with score 0; so does everything if no labelled
row is left to learn from. ``bits`` are those of the shortest code for each byte (NULL without bytes or languages): from
``UNIFORM`` on no language's statistics shorten the text. Ties go to the language that sorts first. Texts of any length are scored whole.
Repeated rows get equal results, one row each. Columns other than the named ones are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, raw_texts

#: Preceding bytes of the longest context.
ORDER = 3
#: Labelled documents of a language to learn from, about: the bound of the training sample.
SAMPLE_PER_LANGUAGE = 300
UND = "und"
#: Bits of a byte without any statistics.
UNIFORM = 8.0
_PAD = b"\n" * ORDER
_LETTER = re.compile(r"[^\W\d_]")
_CHUNK = 1 << 20


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """The packed n bytes that end at each place from ORDER on."""
    out = data[ORDER:].astype(np.uint64)
    for k in range(1, n):
        out |= data[ORDER - k : len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class PpmModel:
    """Frozen statistics of all languages: for each order the known grams with their cost, and contexts with their escape cost."""

    def __init__(self, langs: list[str], grams: list, contexts: list):
        self.langs, self.grams, self.contexts = langs, grams, contexts

    @classmethod
    def fit(cls, texts: dict[str, list[bytes]]) -> PpmModel:
        langs = sorted(texts)
        data = {x: np.frombuffer(_PAD + _PAD.join(texts[x]), np.uint8) for x in langs}
        counts = [[np.unique(_grams(data[x], n), return_counts=True) for x in langs] for n in range(1, ORDER + 2)]
        model = cls(langs, [], [])
        for n in range(1, ORDER + 2):
            keys = np.unique(np.concatenate([k for k, _ in counts[n - 1]]))
            ctx = np.unique(keys >> np.uint64(8)) if n > 1 else np.zeros(1, np.uint64)
            # contexts are named by their bytes without the symbol: the packed gram, its last byte shifted out
            escape = np.zeros((len(ctx), len(langs)), np.float32)
            shorter = model._cost(keys, n - 1)
            cost = shorter.copy()
            for j, (k, c) in enumerate(counts[n - 1]):
                of = np.searchsorted(ctx, k >> np.uint64(8)) if n > 1 else np.zeros(len(k), int)
                total = np.bincount(of, c, len(ctx))
                kinds = np.bincount(of, minlength=len(ctx))
                known = total > 0
                escape[known, j] = -np.log2(kinds[known] / (total[known] + kinds[known]))
                at, seen = _find(k, keys)
                mine = np.searchsorted(ctx, keys >> np.uint64(8)) if n > 1 else np.zeros(len(keys), int)
                cost[:, j] = np.where(seen, -np.log2(np.maximum(c[at], 1) / np.maximum(total[mine] + kinds[mine], 1)), escape[mine, j] + shorter[:, j])
            model.grams.append((keys, cost.astype(np.float32)))
            model.contexts.append((ctx, escape))
        return model

    def _cost(self, packed: np.ndarray, n: int) -> np.ndarray:
        """Bits of the last byte of each packed gram by its last n bytes, for each language."""
        if n == 0:
            return np.full((len(packed), len(self.langs)), 8.0, np.float32)
        keys, cost = self.grams[n - 1]
        own = packed & np.uint64((1 << 8 * n) - 1)
        at, seen = _find(keys, own)
        out = cost[at]
        if not seen.all():
            miss = ~seen
            ctx, escape = self.contexts[n - 1]
            where, held = _find(ctx, own[miss] >> np.uint64(8)) if n > 1 else (np.zeros(miss.sum(), int), np.ones(miss.sum(), bool))
            out[miss] = self._cost(own[miss], n - 1) + np.where(held[:, None], escape[where], 0)
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length in bits of each whole text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        at, n = 0, len(texts)
        while at < n:
            end, size = at, 0
            while end < n and (size == 0 or size + len(texts[end]) <= _CHUNK):
                size += len(texts[end]) + ORDER
                end += 1
            data = np.frombuffer(_PAD + _PAD.join(texts[at:end]), np.uint8)
            lengths = np.array([len(x) for x in texts[at:end]])
            starts = np.cumsum(lengths + ORDER) - lengths - ORDER
            for a in range(0, len(data) - ORDER, _CHUNK):  # one very long text takes several rounds
                part = data[a : min(len(data), a + _CHUNK + ORDER)]
                bits = self._cost(_grams(part, ORDER + 1), ORDER + 1)
                where = np.arange(a, a + len(bits))
                owner = np.searchsorted(starts, where, "right") - 1
                inside = where < starts[owner] + lengths[owner]
                for j in range(len(self.langs)):
                    out[at:end, j] += np.bincount(owner[inside], bits[inside, j], end - at)
            at = end
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, list]:
        """The language with the shortest code, its posterior under equal priors, and the code's bits for each byte."""
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts)), [None] * len(texts)
        bits = self.code_lengths(texts)
        best = bits.argmin(1)
        score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
        lettered = np.array([bool(_LETTER.search(x.decode("utf-8", "replace"))) for x in texts], bool)
        return [self.langs[b] if ok else UND for b, ok in zip(best, lettered)], np.where(lettered, score, 0.0), [float(b) / len(x) if x else None for b, x in zip(bits.min(1), texts)]


def fit(docs: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> PpmModel:
    """Learns from about ``per_language`` rows of each label, picked by a hash of the key; the driver gets that bounded sample alone.

    Every language that the label column names is learned, so the labels have to be languages: a few hundred at most."""
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    sizes = known.groupBy(label).count().collect()
    picked = F.lit(False)
    for lang, n in sizes:
        share = int(min(1.0, per_language / n) * (1 << 30))
        picked = picked | ((F.col(label) == lang) & (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(1)), F.lit(1 << 30)) < share))
    texts: dict[str, list[bytes]] = {}
    for lang, x in known.where(picked).select(label, text).collect() if sizes else []:
        texts.setdefault(lang, []).append(x.encode())
    return PpmModel.fit({k: sorted(v) for k, v in texts.items()}) if texts else PpmModel([], [], [])


def identify(docs: DataFrame, model: PpmModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns named in keep with ``lang_pred``, ``score`` and ``bits`` of each row's whole text."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast((model.langs, model.grams, model.contexts))
    out = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    names = [*keep, "lang_pred", "score", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PpmModel(*shared.value)
        for b in batches:
            langs, score, bits = own.predict(raw_texts(b.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema[:-1]), "lang_pred string, score double, bits double"])
    return out.mapInArrow(run, schema)
