"""SentencePiece (BPE) encoding and decoding with a table of prefixes.

Byte-pair merging has this property: a sequence of pieces is the encoding of a text exactly if every piece
encodes to itself and every adjacent pair of pieces encodes to that pair. So each prefix of a text has one
last piece. The encoder walks the text with an Aho-Corasick automaton of all pieces; at each end it takes
the match whose pair with the last piece of the prefix before it is compatible, stores it, and at the end
recovers the ids backwards through the table. Whether a pair is compatible is settled once by merging that
pair's characters, and remembered.

Texts are cut before that where no piece of the vocabulary holds the two characters side by side: merges
never cross such a place, so parts are encoded alone and remembered (bounded caches). Characters
without a piece become their UTF-8 bytes' pieces.

A model with other rules is refused: probes are encoded and decoded by the library when a codec is made.

Cases: null and empty texts have no ids, the hash of an empty string, and decode to an empty text. Texts of
any length are encoded whole. Repeated rows get equal results, one row each; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare

SPACE = "▁"
#: Parts that are remembered, pairs that are remembered, and the longest part that is.
PARTS, PAIRS, LONGEST = 400_000, 1_000_000, 48
#: Stands for the place before the first piece in a pair's key (20 bits for each of both).
_START = (1 << 20) - 1
#: Texts that models with other rules than these (a space put first, no normalisation, bytes for unknown characters) encode otherwise.
_PROBES = ("a", " a", "a  b ", "\ta\n", "Ａ ﬁ", "e\u0301 é", "ͼ\U000F0000", "\u00a0x")


class PieceCodec:
    """Encoder and decoder of one serialized sentencepiece model of the BPE type with byte fallback."""

    def __init__(self, proto: bytes):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        self.bytes, self.score, self.ids = {}, {}, {}
        joined: set[str] = set()
        automaton = ahocorasick.Automaton()
        for i, p in enumerate(self.pieces):
            if lib.is_byte(i):
                self.bytes[i] = int(p[3:5], 16)
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.ids[p], self.score[p] = i, lib.get_score(i)
                automaton.add_word(p, (i, len(p)))
                joined.update(map("".join, zip(p, p[1:])))
        automaton.make_automaton()
        self.automaton, self.joined = automaton, joined
        letter, other = r"[^\W\d_]", rf"(?:(?![{SPACE}\n])[\W\d_])"
        ends = not any(p[0].isalpha() and not p[1].isalpha() and p[1] != SPACE for p in joined) and "\n" not in "".join(joined)
        # the first cut, by one pattern: before a run of spaces (no piece holds a space after another character) and, where
        # the vocabulary allows it, after a run of letters and at line ends
        self.chunked = re.compile(rf"\n|{SPACE}*{other}*{letter}+|{SPACE}+{other}*|{other}+" if ends else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        if any(p[1] == SPACE != p[0] for p in joined):
            raise ValueError("a piece holds a space after another character: texts can't be cut at spaces")
        self.byte_id = {b: i for i, b in self.bytes.items()}
        self.sizes = [len(p) for p in self.pieces]
        self.digits = [str(i) for i in range(len(self.pieces))]
        self.plain = [None if i in self.bytes else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.pair: dict[int, bool] = {}
        self.known: dict[str, tuple[str, int, str]] = {}
        for x in _PROBES:
            ids = lib.encode(x)
            if self.encode(x) != ids or self.decode(ids) != lib.decode(ids):
                raise ValueError(f"the model encodes {x!r} by other rules (normalisation, first space or unknown characters)")

    def merged(self, text: str) -> list[str]:
        """The merge procedure itself: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _settle(self, key: int) -> bool:
        """Whether the two pieces of a pair's key encode to themselves side by side; remembered."""
        if len(self.pair) >= PAIRS:
            self.pair.clear()
        a, b = key >> 20, key & _START
        if key < 0:  # the prefix before has no encoding
            ok = False
        elif a == _START:
            ok = self.merged(self.pieces[b]) == [self.pieces[b]]
        else:
            x, y = self.pieces[a], self.pieces[b]
            ok = self.merged(x + y) == [x, y]
        self.pair[key] = ok
        return ok

    def _walk(self, part: str) -> list[int]:
        """Ids of a part: the table of each prefix's last piece, then back through it."""
        if len(part) == 1 and part not in self.ids:
            return [self.byte_id[b] for b in part.encode()]
        last = [-1] * (len(part) + 1)
        last[0], done, pair = _START << 20, -1, self.pair
        for end, (i, size) in self.automaton.iter(part):
            if end == done:
                continue
            key = last[end + 1 - size] | i
            ok = pair.get(key)
            if ok or ok is None and self._settle(key):
                last[end + 1], done = i << 20, end
        out, at, sizes = [], len(part), self.sizes
        while at:
            i = last[at] >> 20
            if i < 0:
                raise ValueError(f"no encoding of {part!r} in this vocabulary")
            out.append(i)
            at -= sizes[i]
        out.reverse()
        return out

    def _cut(self, chunk: str) -> list[str]:
        """Parts between which no merge can happen."""
        joined, out, at = self.joined, [], 0
        for k in range(1, len(chunk)):
            if chunk[k - 1 : k + 1] not in joined:
                out.append(chunk[at:k])
                at = k
        out.append(chunk[at:])
        return out

    def _part(self, part: str) -> tuple[str, int, str]:
        if (found := self.known.get(part)) is not None:
            return found
        ids = self._walk(part)
        digits = self.digits
        found = (",".join([digits[i] for i in ids]), len(ids), self.spelled(ids))
        if len(part) <= LONGEST:
            if len(self.known) >= PARTS:
                self.known.clear()
            self.known[part] = found
        return found

    def _chunk(self, chunk: str) -> tuple[str, int, str]:
        if (found := self.known.get(chunk)) is not None:
            return found
        parts = self._cut(chunk)
        if len(parts) == 1:
            return self._part(chunk)
        each = [self._part(p) for p in parts]
        found = (",".join([x[0] for x in each]), sum([x[1] for x in each]), "".join([x[2] for x in each]))
        if len(chunk) <= LONGEST:
            if len(self.known) >= PARTS:
                self.known.clear()
            self.known[chunk] = found
        return found

    def _chunks(self, text: str) -> list[tuple[str, int, str]]:
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        found, known = [], self.known
        for c in self.chunked.findall(text):
            x = known.get(c)
            found.append(x if x is not None else self._chunk(c))
        return found

    def spelled(self, ids: list[int]) -> str:
        """The text of ids without regard to where they stand: byte pieces become characters, marks become spaces."""
        plain = self.plain
        out = [plain[i] for i in ids]
        if None not in out:
            return "".join(out)
        out, held = [], bytearray()
        for i in ids:
            if i in self.bytes:
                held.append(self.bytes[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(plain[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for x in self._chunks(text or "") for i in x[0].split(",")]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding puts first is taken off."""
        return self.spelled(ids).removeprefix(" ")

    def both(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and the decoded text."""
        found = self._chunks(text or "")
        return sum([x[1] for x in found]), ",".join([x[0] for x in found]), "".join([x[2] for x in found]).removeprefix(" ")


_HELD: dict[bytes, PieceCodec] = {}


def codec(proto: bytes) -> PieceCodec:
    """The codec of a model, one for each worker process and model."""
    key = hashlib.sha256(proto).digest()
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = PieceCodec(proto)
    return _HELD[key]


def model_bytes(path: str) -> bytes:
    """The driver reads the vocabulary file; executors get its bytes (well under 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


def _text_columns(docs: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, str]:
    out = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    return out, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema[:-1])


def digests(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns named in keep with n_tokens, ids_sha256 and decoded_sha256 of each whole text."""
    spark = docs.sparkSession
    prepare(spark)
    proto = spark.sparkContext.broadcast(model_bytes(path))
    out, kept = _text_columns(docs, keep, text)
    names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(proto.value)
        for b in batches:
            n, ids, texts = [], [], []
            for x in b.column(len(keep)):
                k, joined, spelled = own.both(x.as_py())
                n.append(k)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                texts.append(hashlib.sha256(spelled.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=names)

    return out.mapInArrow(run, ", ".join([kept, "n_tokens bigint, ids_sha256 string, decoded_sha256 string"]))


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns named in keep with ``ids``, the array of a whole text's ids."""
    return _mapped(docs, path, keep, text, "ids", pa.list_(pa.int32()), "array<int>", lambda own, x: own.encode(x))


def decode(docs: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """The columns named in keep with ``text`` decoded from ids; null ids give an empty text."""
    return _mapped(docs, path, keep, ids, "text", pa.string(), "string", lambda own, x: own.decode(x or []))


def _mapped(docs, path, keep, col, name, kind, sql, f):
    spark = docs.sparkSession
    prepare(spark)
    proto = spark.sparkContext.broadcast(model_bytes(path))
    out, kept = _text_columns(docs, keep, col)

    def run(batches):
        own = codec(proto.value)
        for b in batches:
            values = pa.array([f(own, x.as_py()) for x in b.column(len(keep))], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], values], names=[*keep, name])

    return out.mapInArrow(run, f"{kept}, `{name}` {sql}")
