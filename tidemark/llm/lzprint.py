"""Document fingerprints from Lempel-Ziv phrases.

A text's UTF-8 is parsed as LZ78 does: each phrase is the shortest run of bytes that the dictionary doesn't hold yet.
The phrases' 64-bit hashes (a polynomial of the bytes, then mixed) make a set; the ``SIZE`` smallest, cut to their upper 32
bits, are the signature. Likeness of two signatures estimates the share of phrases that both texts have among
all of theirs: of the smallest ``SIZE`` values of both together, the part that both hold. It is exact where both
texts have fewer phrases than that; two empty texts are alike (1), an empty and another one aren't (0).

``edited_pairs`` compares each document to its edited text and to the next document in descending key order. Rows
are dealt to ranges of the key; the first document of a range is also sent to the range before, so each range
is worked off as a stream that holds two documents at a time, and no document is alone in a task with all others.

Cases: null counts as the empty text. Keys are whole numbers. Rows that share a key are ordered by a hash of their text, and are one range; null keys come last. The
next of the last row is the first row, of an only row itself. Equal texts have equal fingerprints. Texts of any length are
parsed whole; the dictionary starts anew after ``DICTIONARY`` phrases so that memory stays bounded. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare

SIZE = 64
#: Phrases of a dictionary (checked once a ``ROUND`` of bytes).
DICTIONARY, ROUND = 1 << 20, 1 << 20
#: Documents of a range of keys, about, and ranges at most.
RANGE_ROWS, RANGES = 1500, 10_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWER = np.cumprod(np.full(4096, 0xD6E8FEB86659FD93, np.uint64))


def _hashes(data: bytes, begin: int, ends: list[int]) -> np.ndarray:
    """Hashes of the phrases of data that end at ends, the first one beginning at begin."""
    global _POWER
    if not ends:
        return np.zeros(0, np.uint64)
    stop = np.array(ends)
    start = np.concatenate([[begin], stop[:-1]])
    sizes = stop - start
    if sizes.max() > len(_POWER):
        _POWER = np.cumprod(np.full(2 * int(sizes.max()), 0xD6E8FEB86659FD93, np.uint64))
    own = np.frombuffer(data, np.uint8)[begin : ends[-1]]
    place = np.arange(begin, ends[-1]) - np.repeat(start, sizes)
    return _mix(np.add.reduceat(_BYTE[own] * _POWER[place], start - begin) + sizes.astype(np.uint64))


def _smallest(hashes: np.ndarray) -> np.ndarray:
    values = np.unique((hashes >> np.uint64(32)).astype(np.uint32))
    return values[:SIZE]


class Parse:
    """The LZ78 parse of a text, which can go on from a cut with another ending."""

    def __init__(self, data: bytes, cut: int | None = None):
        self.data, self.cut = data, len(data) if cut is None else cut
        self.trie: dict[int, int] = {}
        self.ends: list[int] = []
        self.node, self.next = self._run(data, 0, self.cut, 0, 1, self.ends)
        self.size = len(self.trie)
        self.head = _hashes(data, 0, self.ends)
        tail: list[int] = []
        self._run(data, self.cut, len(data), self.node, self.next, tail)
        self.signature = _smallest(np.concatenate([self.head, _hashes(data, self._begin(), tail)]))
        self.whole = len(data) <= ROUND  # else the dictionary may have started anew since the cut
        if self.whole:
            self._back()

    def _begin(self) -> int:
        return self.ends[-1] if self.ends else 0

    def _back(self) -> None:
        while len(self.trie) > self.size:
            self.trie.popitem()

    def _run(self, data: bytes, at: int, stop: int, node: int, following: int, ends: list[int]) -> tuple[int, int]:
        trie, get = self.trie, self.trie.get
        while at < stop:
            to = min(stop, at - at % ROUND + ROUND)
            for place, c in enumerate(data[at:to], at + 1):
                key = node << 8 | c
                found = get(key)
                if found is None:
                    trie[key] = following
                    following += 1
                    ends.append(place)
                    node = 0
                else:
                    node = found
            at = to
            if len(trie) >= DICTIONARY and at % ROUND == 0:
                trie.clear()
                node = 0
        return node, following

    def edited(self, data: bytes) -> np.ndarray:
        """The signature of a text that is the same up to the cut."""
        if not self.whole or len(data) > ROUND:
            return Parse(data).signature
        tail: list[int] = []
        self._run(data, self.cut, len(data), self.node, self.next, tail)
        out = _smallest(np.concatenate([self.head, _hashes(data, self._begin(), tail)]))
        self._back()
        return out


def signature(text: str | None) -> np.ndarray:
    return Parse((text or "").encode()).signature


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases, from the signatures."""
    if not len(a) and not len(b):
        return 1.0
    limit = min([len(x) for x in (a, b) if len(x) == SIZE], default=2 * SIZE)
    joined = np.union1d(a, b)[:limit]
    return float(np.isin(joined, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def spelled(x: np.ndarray) -> str:
    """The fingerprint as a string: eight hexadecimal digits a value, in ascending order."""
    return x.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns named in keep with the fingerprint of each whole text."""
    prepare(docs.sparkSession)
    out, k = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text")), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spelled(signature(x.as_py())) for x in b.column(k)]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(found, pa.string())], names=[*keep, "fingerprint"])

    return out.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema[:-1]), "fingerprint string"]))


class _Document:
    def __init__(self, key, text: str | None):
        self.key, self.text = key, text or ""
        self.n = len(self.text)
        self.kept = self.text[: self.n - self.n // 3]
        head = self.kept.encode()
        self.parse = Parse(head + self.text[len(self.kept) :].encode(), len(head))

    def row(self, following: _Document) -> tuple:
        edited = (self.kept + following.text[: self.n // 3]).encode()
        mine, other = self.parse.signature, self.parse.edited(edited)
        return (self.key, self.n, hashlib.sha256(edited).hexdigest(), spelled(mine), spelled(other), likeness(mine, other), likeness(mine, following.parse.signature))


_OUT = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third (code points, rounded down) replaced by as many of the next document's first ones."""
    prepare(docs.sparkSession)
    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{key} has to be a whole number: documents are put in order by it")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = rows.select("key", F.coalesce("key", F.lit(-(1 << 63))).alias("place"), "text")
    n = docs.count()
    parts = max(1, min(RANGES, n // RANGE_ROWS))
    cuts = rows.agg(F.max("place").alias("top"), F.percentile_approx("place", [k / parts for k in range(1, parts)] or [0.5], 100 * RANGES if parts > 1000 else 10_000).alias("cuts")).first()
    tops = np.array(sorted({cuts["top"], *(cuts["cuts"] if parts > 1 else [])}) if n else [0], np.int64)  # each is a key that exists
    last = len(tops) - 1

    @F.pandas_udf("range int, head boolean")
    def placed(places: pd.Series) -> pd.DataFrame:
        x = places.to_numpy(np.int64)
        at = np.searchsorted(tops, x)  # range k ends with the key tops[k]; ranges run upwards, rows down
        return pd.DataFrame({"range": at.astype(np.int32), "head": tops[at] == x})

    split = rows.withColumn("at", placed("place")).select("*", "at.range", "at.head").drop("at")
    before = F.when(F.col("range") < last, F.col("range") + 1).otherwise(0)  # the first row of a range is also sent to the range before
    own = F.struct("range", F.lit(False).alias("first"))
    sent = F.when(F.col("head"), F.array(own, F.struct(before.alias("range"), F.lit(True).alias("first")))).otherwise(F.array(own))
    dealt = split.withColumn("to", F.explode(sent)).select("to.range", F.col("to.first").alias("first"), "place", F.xxhash64("text").alias("tie"), "key", "text")
    dealt = dealt.repartition("range").sortWithinPartitions("range", "first", F.desc("place"), "tie")
    names, kinds = [key, *[x for x, _ in _OUT]], [pa.int64(), *[t for _, t in _OUT]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None
        for b in batches:
            found = []
            for k, first, doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist(), b.column(5)):
                if k != at:
                    held, at = None, k
                if first and held is None:  # the range is finished
                    continue
                new = _Document(doc, t.as_py())
                if held is not None:
                    found.append(held.row(new))
                held = None if first else new
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), kinds)], names=names)

    return dealt.mapInArrow(run, f"`{key}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
