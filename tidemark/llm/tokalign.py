"""Alignment of two tokenizers by an event sweep.

Every text is encoded by a byte-level BPE vocabulary (A) with a space put first, and by a sentencepiece model (B), which puts one
itself; both lists of tokens then spell the same bytes. Each token is an event at the byte offset where it ends. The events of both
lists are put in one table, dealt by document and sorted by (document, offset, list) within partitions, and go through a machine
that holds the one group that is still open: where an A and a B token end together it closes the group (its A ids and its B
ids) and emits the link of those two tokens. Events travel packed, ``SPAN`` bytes of text to a row for each list, so an id
costs two bytes and not a row.

The machine counts linked pairs of ids while it goes; a task's counts leave it once. The table of pairs is bounded by the vocabularies
alone: of two tokens that end together the shorter one's bytes end the longer one, so there are at most as many pairs as both vocabularies'
tokens have bytes (about 0.6 million here). Therefore it may be broadcast, and a second pass over the stored links marks those
whose pair is its B id's most frequent one.

A document is named by a digest of its text and kept columns and by the partition that encodes it, so a task that runs again makes the same events in
whatever order its rows come; rows that are equal in all of these share one name and are counted. Links are written to the shared folder once. Texts
are cut at single spaces between two other characters, where neither tokenizer merges across; the chunks are encoded by the libraries and
remembered (bounded), and very long texts are taken ``PART`` code points at a time.

Cases: null and empty texts, and texts whose joined tokens differ from space + text (such as one that holds U+2581), have no tokens:
zeros and an empty ``groups_sha256``. Strings of special tokens are plain text. Repeated rows are rows of their own and count
each time. Ties for a B id's most frequent pair all count. Other columns are ignored or carried as asked; names that begin with
``__al_`` are reserved. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, stored

#: Bytes of text whose events share a row; code points that are encoded at a time, and of all texts that are.
SPAN, PART, GATHERED = 1 << 16, 1 << 18, 1 << 20
#: Chunks that a worker remembers, and the longest one that it does.
KNOWN, LONGEST = 600_000, 48
_CUT = re.compile(r" (?=[^\s▁])(?<=[^\s▁] )")


class Pair:
    """Both tokenizers from the bytes of their files, and the bytes of their tokens."""

    def __init__(self, json: bytes, proto: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_str(json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=proto)
        # the byte that each character of a byte-level entry stands for: found by putting every byte through the same step
        alphabet = {c: i for i, c in enumerate(_byte_alphabet(ByteLevel))}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for word, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(alphabet[c] for c in word) if all(c in alphabet for c in word) else word.encode()
        n = self.b.get_piece_size()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(n)))]
        self.sizes = [np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b)]
        pieces = map(self.b.id_to_piece, range(n))
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)  # no piece holds a space after another character
        self.kinds = [_width(len(x)) for x in self.sizes]
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}

    def parts(self, text: str) -> list[str]:
        """The text cut at single spaces between other characters, which go; but for the last, parts have ``PART`` code points or more."""
        out, at = [], 0
        while self.cuts and len(text) - at > PART:
            cut = _CUT.search(text, at + PART)
            if not cut:
                break
            out.append(text[at : cut.start()])
            at = cut.end()
        return [*out, text[at:]]

    def _learn(self, chunks: list[str]) -> dict[str, tuple[bytes, bytes, bool]]:
        """Of each chunk the ids of both lists, packed, and whether they spell it. Chunks that stand between single spaces are encoded side by side
        in one text, and told apart by the bytes that their tokens spell."""
        made = {}
        between = [c for c in chunks if self.cuts and c and not (c[0].isspace() or c[-1].isspace() or "▁" in c)]
        if between:
            text = " ".join(between)
            both = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode([text], num_threads=1)[0]
            if all(b"".join([t[i] for i in ids]) == (" " + text).encode() for ids, t in zip(both, (self.bytes_a, self.bytes_b))):
                stops = np.cumsum([len(c.encode()) + 1 for c in between])
                cut = []
                for ids, sizes, kind in zip(both, self.sizes, self.kinds):
                    ids = np.array(ids, kind)
                    at = (np.searchsorted(np.cumsum(sizes[ids]), stops) + 1) * ids.itemsize
                    data, at = ids.tobytes(), at.tolist()
                    cut.append([data[x:y] for x, y in zip([0, *at], at)])
                made = {c: (a, b, True) for c, a, b in zip(between, *cut)}
        rest = [c for c in chunks if c not in made]
        for c, a, b in zip(rest, self.a.encode_batch_fast([" " + c for c in rest], add_special_tokens=False), self.b.encode(rest, num_threads=1)):
            a, want = a.ids, (" " + c).encode()
            ok = b"".join([self.bytes_a[i] for i in a]) == want == b"".join([self.bytes_b[i] for i in b])
            made[c] = np.array(a, self.kinds[0]).tobytes(), np.array(b, self.kinds[1]).tobytes(), ok
        if len(self.known) + len(made) > KNOWN:
            self.known.clear()
        self.known.update((c, x) for c, x in made.items() if len(c) <= LONGEST)
        return made

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both lists for each text; none where they don't spell it."""
        packed: list[tuple[list[bytes], list[bytes]]] = [([], []) for _ in texts]
        good, batch, held = [True] * len(texts), [], 0

        def flush() -> None:
            cut = [(i, _CUT.split(p) if self.cuts else [p]) for i, p in batch]
            known = self.known
            new = list({c for _, chunks in cut for c in chunks if c not in known})
            known = dict(known) if len(known) + len(new) > KNOWN else known  # what is known now outlives a clearing
            made = self._learn(new)
            for i, chunks in cut:
                found = [known.get(c) or made[c] for c in chunks]
                packed[i][0].append(b"".join([x[0] for x in found]))
                packed[i][1].append(b"".join([x[1] for x in found]))
                good[i] = good[i] and all([x[2] for x in found])
            batch.clear()

        for i, text in enumerate(texts):
            for part in self.parts(text) if text else ():
                batch.append((i, part))
                held += len(part)
                if held >= GATHERED:
                    flush()
                    held = 0
        flush()
        return [tuple(np.frombuffer(b"".join(x) if ok else b"", k) for x, k in zip(two, self.kinds)) for two, ok in zip(packed, good)]


def _byte_alphabet(byte_level) -> str:
    """The characters of the bytes 0 to 255: printable Latin-1 characters stand for themselves, other bytes, in order, for those from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    found = "".join(chr(b) if b in set(plain) else chr(next(rest)) for b in range(256))
    if set(found) != set(byte_level.alphabet()):
        raise ValueError("the library's byte alphabet is another one")
    return found


_HELD: dict[bytes, Pair] = {}


def _pair(files: tuple[bytes, bytes]) -> Pair:
    key = hashlib.sha256(files[0]).digest() + hashlib.sha256(files[1]).digest()
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Pair(*files)
    return _HELD[key]


def _width(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Rising whole numbers as differences by byte planes, which compress better."""
    steps = np.diff(values, prepend=0).astype(kind)
    return steps.view(np.uint8).reshape(-1, steps.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)
    return np.cumsum(steps, dtype=np.int64)


def events(docs: DataFrame, files: tuple[bytes, bytes], keep: list[str], text: str = "text") -> DataFrame:
    """Packed end events: __al_row (name of a document), __al_at (span), __al_list (0: A, 1: B), __al_ids (compressed); a document's last B row
    carries keep. A row that is equal to an earlier one of its partition has a single event, of span -1."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(files)
    own = docs.select(F.col(text).cast("string").alias("__al_text"), *[F.col(c) for c in keep])
    names = ["__al_row", "__al_at", "__al_list", "__al_last", "__al_ids", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _pair(shared.value)
        packer, here, seen = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId().to_bytes(4, "big"), set()
        for batch in batches:
            rows, ats, lists, lasts, packed, from_ = [], [], [], [], [], []
            texts = [x or "" for x in batch.column(0).to_pylist()]
            kept = [repr(v).encode() for v in zip(*[c.to_pylist() for c in batch.columns[1:]])] if keep else [b""] * len(texts)
            named = [hashlib.blake2b(t.encode(), digest_size=16, key=hashlib.blake2b(k, digest_size=32).digest()).digest() + here for t, k in zip(texts, kept)]
            first = []
            for i, row in enumerate(named):
                if row in seen:
                    for column, v in zip((rows, ats, lists, lasts, packed, from_), (row, -1, 0, False, b"", None)):
                        column.append(v)
                else:
                    seen.add(row)
                    first.append(i)
            for i, two in zip(first, both.encode([texts[i] for i in first])):
                ends = [np.cumsum(s[x]) for s, x in zip(both.sizes, two)]
                spans = max(1, -(-int(ends[0][-1]) // SPAN) if len(ends[0]) else 1)
                bounds = [np.searchsorted(e, np.arange(1, spans) * SPAN, "right") for e in ends]
                cut = [np.split(x, b) for x, b in zip(two, bounds)]
                for at in range(spans):
                    for which in (0, 1):
                        last = which == 1 and at == spans - 1
                        rows.append(named[i])
                        ats.append(at)
                        lists.append(which)
                        lasts.append(last)
                        packed.append(packer.compress(cut[which][at].tobytes()))
                        from_.append(i if last else None)
            index = pa.array(from_, pa.int64())
            columns = [pa.array(rows, pa.binary()), pa.array(ats, pa.int32()), pa.array(lists, pa.int8()), pa.array(lasts, pa.bool_()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *[c.take(index) for c in batch.columns[1:]]], names=names)

    kinds = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in keep)
    return own.mapInArrow(run, "__al_row binary, __al_at int, __al_list tinyint, __al_last boolean, __al_ids binary" + (f", {kinds}" if keep else ""))


class Machine:
    """One document at a time: spans of events in, closed groups and links out. It holds the group that is open, and running totals."""

    def __init__(self, sizes: list[np.ndarray]):
        self.sizes = sizes
        top = max(map(len, sizes))
        digits = [str(i).encode() for i in range(top)]
        self.width = max(map(len, digits))
        self.length = np.array([len(d) for d in digits], np.int64)
        self.digits = np.frombuffer(b"".join(d.ljust(self.width + 1) for d in digits), np.uint8).reshape(top, self.width + 1)
        self.pairs = len(sizes[1])
        self.start()

    def start(self) -> None:
        self.hash, self.counts, self.groups = hashlib.sha256(), [0, 0], 0
        self.reached = [0, 0]
        self.open: list[list[np.ndarray]] = [[], []]

    def span(self, at: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Takes both lists' ids that end in a span; gives the numbers of linked pairs and the text of closed groups."""
        ids, ends, flags = [a.astype(np.int64), b.astype(np.int64)], [], np.zeros(SPAN + 1, np.uint8)
        for k in (0, 1):
            self.counts[k] += len(ids[k])
            e = self.reached[k] + np.cumsum(self.sizes[k][ids[k]])
            if len(e):
                self.reached[k] = int(e[-1])
            ends.append(e - at * SPAN)
        flags[ends[0]] = 1
        flags[ends[1][flags[ends[1]] == 1]] = 2
        shared = [flags[ends[0]] == 2, flags[ends[1]] == 2]
        links = ids[0][shared[0]] * self.pairs + ids[1][shared[1]]
        if not len(links):
            for k in (0, 1):
                self.open[k].append(ids[k])
            return links, b""
        closed, last = [], []
        for k in (0, 1):
            before = sum(map(len, self.open[k]))
            stop = int(np.flatnonzero(shared[k])[-1]) + 1
            closed.append(np.concatenate([*self.open[k], ids[k][:stop]]))
            last.append(np.concatenate([np.zeros(before, bool), shared[k][:stop]]))
            self.open[k] = [ids[k][stop:]]
        said = self._said(closed, last)
        self.hash.update((b";" if self.groups else b"") + said)
        said = (b";" if self.groups else b"") + said
        self.groups += len(links)
        return links, said

    def _said(self, ids: list[np.ndarray], last: list[np.ndarray]) -> bytes:
        """``a1,a2|b1;a3|b2``: each id with the mark that follows it, in the order of groups."""
        group = [np.cumsum(x) - x for x in last]
        stops = [np.flatnonzero(x) + 1 for x in last]
        starts_b = np.concatenate([[0], stops[1]])
        place = [np.arange(len(ids[0])) + starts_b[group[0]], np.arange(len(ids[1])) + stops[0][group[1]]]
        n = len(ids[0]) + len(ids[1])
        order, marks = np.empty(n, np.int64), np.empty(n, np.uint8)
        for k, mark in ((0, b"|"), (1, b";")):
            order[place[k]] = ids[k]
            marks[place[k]] = np.where(last[k], mark[0], b","[0])
        chars, length = self.digits[order], self.length[order]
        chars[np.arange(n), length] = marks
        return chars[np.arange(self.width + 1) <= length[:, None]].tobytes()[:-1]


def sweep(table: DataFrame, files: tuple[bytes, bytes], keep: list[str], spelled: bool = False) -> DataFrame:
    """Rows of two kinds from events. Spans: __al_row, __al_at, __al_times (rows that share the name), __al_links (different pair numbers, packed), __al_met (how often each is linked) and, if ``spelled``, groups as text; a document's last
    one also has keep, n_a, n_b, n_groups, n_links and groups_sha256. Counts: __al_pair and __al_count of each task."""
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast(files)
    dealt = table.repartition("__al_row").sortWithinPartitions("__al_row", "__al_at", "__al_list")
    own = [("__al_row", "binary", pa.binary()), ("__al_at", "int", pa.int32()), ("__al_times", "bigint", pa.int64()), ("__al_links", "binary", pa.binary()), ("__al_met", "binary", pa.binary()), ("n_a", "bigint", pa.int64()), ("n_b", "bigint", pa.int64()), ("n_groups", "bigint", pa.int64()), ("n_links", "bigint", pa.int64()), ("groups_sha256", "string", pa.string()), ("__al_pair", "bigint", pa.int64()), ("__al_count", "bigint", pa.int64())]
    if spelled:
        own.append(("groups", "string", pa.string()))
    names = [x[0] for x in own] + keep
    dealt = dealt.select("__al_row", "__al_at", "__al_list", "__al_last", "__al_ids", *[F.col(c) for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _pair(shared.value)
        machine, widths = Machine(both.sizes), both.kinds
        wide = _link_width(both)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        loose, n_loose, first, times, at_row = [], 0, None, 1, None
        kinds, unpacker = [pa.null()] * len(keep), zstandard.ZstdDecompressor()
        for batch in batches:
            kinds = [c.type for c in batch.columns[5:]]
            out: list[list] = [[] for _ in own]
            from_ = []
            rows, ats, lists, lasts, packed = (batch.column(k).to_pylist() for k in range(5))
            for i in range(batch.num_rows):
                if rows[i] != at_row:
                    at_row, times = rows[i], 1
                if ats[i] < 0:
                    times += 1
                    continue
                ids = np.frombuffer(unpacker.decompress(packed[i]), widths[lists[i]])
                if lists[i] == 0:
                    first = ids
                    continue
                if ats[i] == 0:
                    machine.start()
                links, said = machine.span(ats[i], first, ids)
                pairs, met = np.unique(links, return_counts=True)
                loose.append((pairs, met * times))
                n_loose += len(pairs)
                if n_loose >= 1 << 20:
                    keys, counts = _merged([(keys, counts), *loose])
                    loose, n_loose = [], 0
                last = lasts[i]
                values = [rows[i], ats[i], times, _planes(pairs, wide), met.astype("<u4").tobytes(), *((*machine.counts, machine.groups, machine.groups, machine.hash.hexdigest() if machine.groups else "") if last else (None,) * 5), None, None]
                for column, v in zip(out, values + ([said.decode()] if spelled else [])):
                    column.append(v)
                from_.append(i if last else None)
            index = pa.array(from_, pa.int64())
            yield pa.RecordBatch.from_arrays([*[pa.array(v, t) for v, (_, _, t) in zip(out, own)], *[c.take(index) for c in batch.columns[5:]]], names=names)
        keys, counts = _merged([(keys, counts), *loose])
        for k in range(0, len(keys), 1 << 16):
            part = {"__al_pair": pa.array(keys[k : k + (1 << 16)], pa.int64()), "__al_count": pa.array(counts[k : k + (1 << 16)], pa.int64())}
            n = len(part["__al_pair"])
            yield pa.RecordBatch.from_arrays([*[part.get(x, pa.nulls(n, t)) for x, _, t in own], *[pa.nulls(n, t) for t in kinds]], names=names)

    return dealt.mapInArrow(run, ", ".join([*(f"{n} {s}" for n, s, _ in own), *(f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in keep)]))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different pair numbers, sorted, with the sums of their counts; at most as many as there are possible pairs."""
    pairs, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return pairs, np.bincount(at, np.concatenate([c for _, c in parts]), len(pairs)).astype(np.int64)


def _link_width(both: Pair) -> str:
    return "<u4" if len(both.bytes_a) * len(both.bytes_b) <= 1 << 32 else "<u8"


def pair_counts(swept: DataFrame, n_b: int) -> DataFrame:
    """pair, a, b, count (links of the pair over all documents) and best (no other pair of its B id has more). n_b: size of B's vocabulary."""
    table = swept.where("__al_pair is not null").groupBy(F.col("__al_pair").alias("pair")).agg(F.sum("__al_count").alias("count"))
    table = table.select("pair", F.expr(f"pair div {n_b}").alias("a"), (F.col("pair") % n_b).alias("b"), "count")
    return table.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def align(docs: DataFrame, path_a: str, path_b: str, keep: list[str], text: str = "text") -> DataFrame:
    """keep with n_a, n_b, n_groups, n_links, n_best (links of a pair that is its B id's most frequent), count_sum (of links' counts) and groups_sha256."""
    spark = docs.sparkSession
    files = tuple(_read(p) for p in (path_a, path_b))
    shared = spark.sparkContext.broadcast(files)
    swept = stored(sweep(events(docs, files, keep, text), files, keep), "links")
    both = _pair(files)
    found = pair_counts(swept, len(both.bytes_b)).select("pair", "count", "best").toArrow()  # bounded by the vocabularies
    order = np.argsort(found.column("pair").to_numpy())
    counted = spark.sparkContext.broadcast(tuple(found.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "count", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = counted.value
        wide = _link_width(_pair(shared.value))
        for b in batches:
            n_best, total = [], []
            for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                at, met = np.searchsorted(keys, _from_planes(x, wide)), np.frombuffer(y, "<u4").astype(np.int64)
                n_best.append(int((met * best[at]).sum()))
                total.append(int((met * counts[at]).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), *b.columns[3:]], names=["__al_row", "__al_best", "__al_sum", *names])

    names = ["__al_times", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *keep]
    spans = swept.where("__al_row is not null").select("__al_row", "__al_links", "__al_met", *[F.col(c) for c in names])
    kinds = ", ".join(f"`{c}` {spans.schema[c].dataType.simpleString()}" for c in names)
    rows = spans.mapInArrow(run, f"__al_row binary, __al_best bigint, __al_sum bigint, {kinds}").groupBy("__al_row")
    # keep and the totals stand in a document's last span alone
    rows = rows.agg(F.sum("__al_best").alias("__al_best"), F.sum("__al_sum").alias("__al_sum"), F.max_by(F.struct(*[F.col(c) for c in names]), F.col("groups_sha256").isNotNull()).alias("__al_doc"))
    rows = rows.withColumn("__al_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__al_doc")["__al_times"])))
    return rows.select(*[F.col("__al_doc")[c].alias(c) for c in (*keep, "n_a", "n_b", "n_groups", "n_links")], F.col("__al_best").alias("n_best"), F.col("__al_sum").alias("count_sum"), F.col("__al_doc")["groups_sha256"].alias("groups_sha256"))


def groups(docs: DataFrame, path_a: str, path_b: str, keep: list[str], text: str = "text") -> DataFrame:
    """keep and ``groups`` (text, as hashed in groups_sha256) of each document, from the same sweep."""
    files = tuple(_read(p) for p in (path_a, path_b))
    swept = sweep(events(docs, files, keep, text), files, keep, spelled=True).where("__al_row is not null")
    one = F.struct(F.col("__al_times"), *[F.col(c) for c in keep])
    rows = swept.groupBy("__al_row").agg(F.sort_array(F.collect_list(F.struct("__al_at", "groups"))).alias("__al_groups"), F.max_by(one, F.col("groups_sha256").isNotNull()).alias("__al_doc"))
    rows = rows.withColumn("__al_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__al_doc")["__al_times"])))
    return rows.select(*[F.col("__al_doc")[c].alias(c) for c in keep], F.array_join(F.transform("__al_groups", lambda x: x["groups"]), "").alias("groups"))


def _read(path: str) -> bytes:
    """The driver reads a vocabulary file; executors get its bytes (under 3 MB)."""
    with open(path, "rb") as f:
        return f.read()
