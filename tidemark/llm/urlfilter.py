"""URL filters: glob rules in one bit-parallel wildcard automaton, host rules with the longest fit on top.

All glob rules are packed into one multiword Shift-And automaton: each pattern character owns a bit, ``*`` is a
self-loop of the state before it and ``?`` fits any one character (the first byte of its UTF-8, with a self-loop over the others). A batch of canonical URLs is simulated together, one
character place at a time, in numpy: ``D = (D << 1) & mask[c] | D & loop[c]``; a URL that has ended keeps its last
states, and a rule fits if its final bit is set at the end. Verdict of a URL: that of the longest host rule that
fits (host or subdomain of it, path begins with the rule's); without any, ``block`` if a glob rule fits, else
``allow``.

The canonical URL that globs see is ``host + path`` with A-Z of the host lower-cased. Cases: null URLs and URLs without
``://`` have empty host and path; they fit no host rule and no glob but one that fits the empty text, so they are
allowed. URLs of any length are simulated whole. Of host rules of the same length the one that sorts first wins.
Repeated rows get equal results, one row each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare

#: (host, path prefix, verdict).
HOST_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Globs over host and path; a URL without a host rule that fits one is blocked.
BLOCK_GLOBS = ("*casino*", "*spam-farm.*", "*cheap-pills.*", "*/ads/*", "*.exe", "*.zip", "adserver.*", "*tracker?.*")

_WORD = 63  # bits used of each word, so that a shift never loses the carry


class WildcardAutomaton:
    """All patterns in one bit vector of several words."""

    def __init__(self, patterns: Sequence[str]):
        self.patterns = list(patterns)
        # one bit for "nothing read yet" and one for each literal or ? of each pattern
        layout: list[tuple[int, bytes | None]] = []
        first, final, loops, single = [], [], [], []
        for p in self.patterns:
            first.append(len(layout))
            layout.append((len(layout), None))
            for c in p:
                if c == "*":
                    loops.append(len(layout) - 1)
                elif c == "?":
                    single.append(len(layout))
                    layout.append((len(layout), b""))
                else:
                    for b in c.encode():
                        layout.append((len(layout), bytes([b])))
            final.append(len(layout) - 1)
        self.bits = max(1, len(layout))
        self.words = -(-self.bits // _WORD)
        self.masks = np.zeros((256, self.words), np.uint64)
        for at, c in layout:
            if c is None:
                continue
            w, bit = at // _WORD, np.uint64(1 << (at % _WORD))
            if c == b"":
                self.masks[:0x80, w] |= bit
                self.masks[0xC0:, w] |= bit
            else:
                self.masks[c[0], w] |= bit
        self.start = self._set(first)
        self.loop = np.broadcast_to(self._set(loops), (256, self.words)).copy()
        self.loop[0x80:0xC0] |= self._set(single)
        self.final = final

    def _set(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // _WORD] |= np.uint64(1 << (b % _WORD))
        return out

    def run(self, texts: list[bytes]) -> np.ndarray:
        """For each text and pattern, whether the pattern fits the whole text."""
        n = len(texts)
        if not n or not self.patterns:
            return np.zeros((n, len(self.patterns)), bool)
        order = np.argsort([-len(x) for x in texts], kind="stable")
        sizes = np.array([len(texts[i]) for i in order])
        flat = np.frombuffer(b"".join(texts[i] for i in order) or b"\0", np.uint8)
        begin = np.cumsum(sizes) - sizes
        state = np.broadcast_to(self.start, (n, self.words)).copy()
        low, carry = np.uint64((1 << _WORD) - 1), np.uint64(_WORD - 1)
        for k in range(int(sizes[0]) if n else 0):
            live = int(np.searchsorted(-sizes, -k, "left"))  # texts longer than k stand first
            d = state[:live]
            moved = (d << np.uint64(1)) & low
            moved[:, 1:] |= d[:, :-1] >> carry
            c = flat[begin[:live] + k]
            state[:live] = moved & self.masks[c] | d & self.loop[c]
        out = np.empty((n, len(self.patterns)), bool)
        for j, f in enumerate(self.final):
            out[order, j] = (state[:, f // _WORD] >> np.uint64(f % _WORD)) & np.uint64(1) != 0
        return out


def host_and_path(url):
    """Host (A-Z lower-cased) and path of a URL column; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr("substring(__u, instr(__u, '://') + 3)"), "#", 1)).otherwise("")
    rest = F.substring_index(rest, "?", 1)
    host = F.substring_index(rest, "/", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.substring(rest, F.length(host) + 1, F.length(rest))


def longest_rule(host_rules: Sequence[tuple[str, str, str]]):
    """Rule and verdict of the longest host rule that fits the columns host and path, or NULLs.

    The rules are a map from host to its paths; a URL looks up the ends of its own host, so its cost doesn't grow with the rules."""
    of: dict[str, list] = {}
    for h, p, v in host_rules:
        of.setdefault(h, []).append(F.struct(F.lit(-len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(p).alias("path"), F.lit(v).alias("verdict")))
    if not of:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    rules = F.create_map(*[x for h, each in sorted(of.items()) for x in (F.lit(h), F.array(*each))])
    labels = F.size(F.split("host", r"\."))
    ends = F.transform(F.sequence(F.lit(1), labels), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    held = F.filter(F.transform(ends, lambda e: F.try_element_at(rules, e)), lambda x: x.isNotNull())
    best = F.array_min(F.filter(F.flatten(held), lambda r: F.startswith(F.col("path"), r["path"])))
    return best["rule"], best["verdict"]


def judge(pages: DataFrame, keep: list[str], url: str = "url", host_rules: Sequence[tuple[str, str, str]] = HOST_RULES, globs: Sequence[str] = BLOCK_GLOBS) -> DataFrame:
    """The columns named in keep with host, path, rule, verdict and globs (the glob rules that fit)."""
    prepare(pages.sparkSession)
    named = pages.select(*[F.col(c) for c in keep], F.coalesce(F.col(url), F.lit("")).alias("__u"))
    host, path = host_and_path(F.col("__u"))
    parts = named.withColumns({"host": host, "path": path}).drop("__u")
    rule, verdict = longest_rule(host_rules)
    names = [*keep, "host", "path", "rule", "verdict", "globs"]
    out = parts.withColumns({"rule": rule, "verdict": verdict})
    automaton, k = WildcardAutomaton(globs), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, paths = b.column(k).to_pylist(), b.column(k + 1).to_pylist()
            hit = automaton.run([(h + p).encode() for h, p in zip(hosts, paths)])
            fits = [[automaton.patterns[j] for j in np.flatnonzero(row)] for row in hit]
            verdicts = [v or ("block" if f else "allow") for v, f in zip(b.column(k + 3).to_pylist(), fits)]
            yield pa.RecordBatch.from_arrays([*b.columns[: k + 3], pa.array(verdicts, pa.string()), pa.array(fits, pa.list_(pa.string()))], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema[:-1]), "verdict string, globs array<string>"])
    return out.mapInArrow(run, schema)
