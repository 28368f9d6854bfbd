"""Filter audit, token alignment and secret scans against brute force: nulls, empty and long texts, ties, repeated rows,
empty tables, and extra columns with clashing names."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import public_tokenizers
import pytest

pytest.importorskip("tidemark.llm")

from tidemark.llm import credentials, filteraudit, tokalign  # noqa: E402

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPACE = r"[^\x20\x09-\x0D]+"

# -- filter audit


def plain_audit(docs, labels):
    """docs: (id, text, part); labels: (id, quality, toxic)."""
    good, toxic = ({x[0] for x in labels if x[k] == 1 and x[0] is not None} for k in (1, 2))
    failed = []
    for i, text, part in docs:
        x = text or ""
        ws = re.findall(SPACE, x)
        smaller = i is not None and any(j is not None and j < i and (u or "") == x for j, u, _ in docs)
        failed.append({"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", x)) > 10 * len(x), "D": bool(re.search(r"[#$%&*|]", x)), "E": smaller})
    out = {}
    for part in {p or "" for _, _, p in docs}:
        own = [(i, f) for (i, _, p), f in zip(docs, failed) if (p or "") == part]
        total = Counter()
        for o in permutations("ABCDE"):
            left = own
            for k, letter in enumerate(o):
                gone = [x for x in left if x[1][letter]]
                stay = [x for x in left if not x[1][letter]]
                total[letter] += len(gone)
                unique = sum(f[letter] and sum(f.values()) == 1 for _, f in own)
                out[part, "".join(o), k + 1] = [len(stay), len(gone), sum(f[letter] for _, f in own) - len(gone), unique, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), letter]
                left = stay
        for key, row in out.items():
            if key[0] == part:
                row[6] = total[row[6]]
    return {k: tuple(v) for k, v in out.items()}


def audit_docs():
    rng = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "delta", "it's", "x#y", "$5", "漢字", "é"]
    texts = [None, "", " \t ", "A" * 50_000, " ".join(f"w{k}" for k in range(150)), " ".join(f"W{k}" for k in range(150)), " ".join(["same"] * 120)]
    texts += [" ".join(rng.choice(words) + str(rng.randint(0, rng.choice((3, 400)))) for _ in range(rng.randint(1, 260))) for _ in range(25)]
    rows = [(i, t, rng.choice(["en", "de", "", None])) for i, t in enumerate(texts)]
    rows += [(100 + i, t, p) for i, t, p in rows[:20]]  # copies
    rows += [rows[5], rows[5], (None, texts[8], "en"), (None, texts[8], "de"), (5, texts[9], "en"), (-4, texts[9], None)]  # repeated rows, null and repeated ids
    return rows


def test_filter_audit_brute_force(spark):
    rows = audit_docs()
    labels = [(i, i % 3 % 2, i % 4 % 3 % 2) for i in range(-4, 120)] + [(7, 1, None), (7, 0, 1), (None, 1, 1), (8, None, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, part string, step int").repartition(3)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filteraudit.audit(docs, told)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r[0], r[1], r[2]): tuple(r[3:]) for r in got.collect()} == plain_audit(rows, labels)
    assert filteraudit.audit(docs.where("doc_id = 12345"), told).count() == 0
    unlabelled = {(r[0], r[1], r[2]): tuple(r[3:]) for r in filteraudit.audit(docs, told.where("doc_id = 12345")).collect()}
    assert unlabelled == plain_audit(rows, [])


def test_filter_audit_takes_other_filters(spark):
    docs = spark.createDataFrame([(1, "aa", "p"), (2, "ab", "p"), (3, "b", "p")], "id long, body string, kind string")
    labels = spark.createDataFrame([(2, 1, 0)], "id long, quality int, toxic int")
    got = filteraudit.audit(docs, labels, lambda t: {"X": t.contains("a"), "Y": t.contains("b")}, key="id", text="body", part="kind")
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in got.collect()} == {
        ("XY", 1): (1, 2, 0, 1, 1, 3), ("XY", 2): (0, 1, 1, 1, 0, 3), ("YX", 1): (1, 2, 0, 1, 1, 3), ("YX", 2): (0, 1, 1, 1, 0, 3)}


# -- token alignment


def plain_alignment(texts):
    """One (n_a, n_b, links, groups text) for each text, by sets of end offsets."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
    assert set(alphabet) == set(ByteLevel.alphabet())
    vocab = {i: w for w, i in a.get_vocab().items()}
    out = []
    for t in texts:
        x = t or ""
        ia, ib = a.encode(" " + x, add_special_tokens=False).ids, b.encode(x)
        ta = [bytes(alphabet[c] for c in vocab[i]) for i in ia]
        tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        want = (" " + x).encode()
        if not x or b"".join(ta) != want or b"".join(tb) != want:
            out.append((0, 0, [], ""))
            continue
        ends = []
        for parts in (ta, tb):
            at, found = 0, []
            for p in parts:
                at += len(p)
                found.append(at)
            ends.append(found)
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, low = [], 0
        for s in shared:
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, es) if low < e <= s) for ids, es in ((ia, ends[0]), (ib, ends[1]))))
            low = s
        links = [(i, j) for s in shared for i, e in zip(ia, ends[0]) if e == s for j, f in zip(ib, ends[1]) if f == s]
        out.append((len(ia), len(ib), links, ";".join(groups)))
    return out


def alignment_texts():
    rng = random.Random(11)
    words = "the quick brown fox don't 123 4567 naïve café 漢字 😀 <|endoftext|> </s> <unk> x=1; \t \n  end ñandú été".split(" ")
    texts = [None, "", " ", "   a", "a  b ", "holds ▁ here", "<|endoftext|>", " x y", "tail \n\n", "0" * 400, "é" * 300, "é Ａ ﬁ", "the the the", "\x00 zero"]
    texts += [" ".join(rng.choice(words) + rng.choice(["", "s", "?"]) for _ in range(rng.randint(1, 80))) for _ in range(25)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FF), rng.randint(0x4E00, 0x4E80), 0x1F600])) for _ in range(rng.randint(1, 60))) for _ in range(25)]
    return texts + texts[20:26] + [" ".join(rng.choice(words) for _ in range(3000))]


@pytest.mark.parametrize("span, part", [(tokalign.SPAN, tokalign.PART), (40, 64)])
def test_alignment_brute_force(spark, monkeypatch, span, part):
    monkeypatch.setattr(tokalign, "SPAN", span)
    monkeypatch.setattr(tokalign, "PART", part)
    texts = alignment_texts()
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    rows += [rows[-3], rows[-3], (None, texts[16], "y", 0)]  # repeated rows, a null id
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, groups long").repartition(3)
    if span == 40:  # workers read the module's bounds anew: the machine is run here
        files = tokalign._read(BYTES), tokalign._read(PIECES)
        both = tokalign.Pair(*files)
        got = []
        for ids in both.encode([t or "" for t in texts]):
            machine, links, said = tokalign.Machine(both.sizes), [], b""
            arrays = [tokalign.np.array(x, tokalign.np.int64) for x in ids]
            ends = [tokalign.np.cumsum(s[x]) for s, x in zip(both.sizes, arrays)]
            for at in range(max(1, -(-int(ends[0][-1]) // span)) if len(ends[0]) else 1):
                own = [x[(e > at * span) & (e <= (at + 1) * span)] for x, e in zip(arrays, ends)]
                new, more = machine.span(at, *own)
                links += [divmod(int(x), machine.pairs) for x in new]
                said += more
            assert machine.groups == 0 or machine.hash.hexdigest() == hashlib.sha256(said).hexdigest()
            got.append((*machine.counts, links, said.decode()))
        assert got == plain_alignment(texts)
        return
    want = plain_alignment([r[1] for r in rows])
    counts = Counter(x for _, _, links, _ in want for x in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    expected = sorted(
        ((r[0] is None, r[0] or 0), n_a, n_b, len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if said else "")
        for r, (n_a, n_b, links, said) in zip(rows, want))
    found = tokalign.align(docs, BYTES, PIECES, ["doc_id"])
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in found.collect()) == expected
    said = tokalign.groups(docs, BYTES, PIECES, ["doc_id"]).where("doc_id is not null").collect()
    assert {r.doc_id: r.groups for r in said} == {r[0]: w[3] for r, w in zip(rows, want) if r[0] is not None}
    assert tokalign.align(docs.where("doc_id = 99999"), BYTES, PIECES, ["doc_id"]).count() == 0


def test_alignment_parts_join():
    both = tokalign.Pair(tokalign._read(BYTES), tokalign._read(PIECES))
    text = ("lorem ipsum, dolor's  sit 12 amet\n" * 40_000)
    assert len(text) > tokalign.GATHERED and len(both.parts(text)) > 4 and " ".join(both.parts(text)) == text
    a, b = both.encode([text])[0]
    assert a.tolist() == both.a.encode(" " + text, add_special_tokens=False).ids and b.tolist() == both.b.encode(text)


def test_alignment_chunks_equal_whole_texts():
    rng = random.Random(2)
    both = tokalign.Pair(tokalign._read(BYTES), tokalign._read(PIECES))
    odd = [" ", "  ", "\n", "\t", "\xa0", "\u2003", "\u0085", "\u180e", "\u200b", "\x1c", "▁", "'s", "'", "a", "Z", "9", "é", "漢", "😀", ".", "<unk>", "\x00", "½", "ǅ", "\u0301"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(1, 25))) for _ in range(4000)]
    for text, (a, b) in zip(texts, both.encode(texts)):
        ia, ib = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
        spelled = all(b"".join(t[x] for x in ids) == (" " + text).encode() for ids, t in ((ia, both.bytes_a), (ib, both.bytes_b)))
        assert (a.tolist(), b.tolist()) == ((ia, ib) if spelled else ([], [])), repr(text)


# -- secret scans

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEY = "wJalrXUtnFEMI7K7MDENGbPxRfiCYEXAMPLEKEY01"


def plain_base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def plain_scan(text):
    base = plain_base(text)
    weak = [(m.start(), 3, m.end()) for m in re.finditer(r"""(access_?key(?:_?id)?|client_?id|account(?:_?id)?|user(?:_?name|_?id)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", text, re.I | re.A) if len(m[2]) >= 3]
    for m in re.finditer(r"""(pwd|pass(?:phrase|code)?|credential|private_?key|signature|auth)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)|[A-Za-z0-9+/]{40,}={0,2}""", text, re.I | re.A):
        bare = re.fullmatch(r"[A-Za-z0-9+/]{40,}={0,2}", m[0])
        if len(m[0]) >= 10 and (not bare or all(re.search(c, m[0]) for c in ("[A-Z]", "[a-z]", "[0-9]"))):
            weak.append((m.start(), 4, m.end()))
    weak += [(m.start(), 5, m.end()) for m in re.finditer(r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+""", text) if len(m[0]) >= 8]
    parts = base + [w for w in weak if not any(s < w[2] and w[0] < e for s, _, e in base)]
    out = list(base)
    for s, k, e in parts:
        if k >= 3:
            near = 0
            for s2, k2, e2 in parts:
                if credentials.ROLES[k2] != credentials.ROLES[k] and s2 - e <= credentials.SCOPE and s - e2 <= credentials.SCOPE:
                    near |= credentials.ROLES[k2]
            if near & credentials.NEEDS[k] == credentials.NEEDS[k]:
                out.append((s, k, e))
    return base, sorted(out)


def listed(found):
    return ",".join(f"{credentials.KINDS[k]}:{s}:{e}" for s, k, e in found)


def secret_texts():
    rng = random.Random(9)
    bits = ["password: hunter22", "PassWd='abc'", "token=token = \"abcdef12\"", "secret=", "api-key:zzzzzz", "API_KEY = a/b+c.d=", "apikey:'x1y2z3q'", "AKIA" + "A1B2" * 4, "AKIAAKIA" + "ZZZZ" * 4, "AKIASHORT", "24be64439e3e49cf46b2d7c9", "deadbeef",
            "user = alice", "client_id: 99-abc", "login:bo", "pass: hunter2xyz", "pwd=q", "signature = abcdefghijk", KEY, "a" * 45, "https://db.example.com/x?y=1", "s3://bucket", "ſecret: abcdefgh", "toKen: abcdefgh", "é😀漢", "\n", "\t", "x" * 350, "plain words here", '"', "'"]
    texts = [None, "", " ", "é" * 10 + "password=abcdefgh", "user: bob\npass = hunter2xyz\n", "user: bob " + "w " * 400 + "pass = hunter2xyz", "https://api.example.org/v1 alone", "user: bob https://api.example.org/v1 " + KEY, f"AKIA{'Q' * 16} {KEY}", "x" * 200_000 + " token=abcdef", "f" * 5000 + " user=alice",
             "token=abcdef " * 3000]
    texts += [rng.choice(["", " ", ", "]).join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(120)]
    return texts


def test_secret_scan_brute_force(spark):
    texts = secret_texts()
    rows = [(i, t, i, "x") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], 0, "y"), (500, texts[4], 0, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, kind string").repartition(3)
    found = credentials.scan(docs, ["doc_id"])
    assert found.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    want = []
    for i, t, *_ in rows:
        base, spans = plain_scan(t or "")
        want.append(((i is None, i or 0), *(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
    assert sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in found.collect()) == sorted(want)
    by = {r.doc_id: r.spans for r in found.collect()}
    assert "ident" in by[4] and "secret" in by[4] and by[5] == "" and by[6] == "" and by[7].count(":") == 6 and "secret" in by[8]
    assert credentials.scan(docs.where("doc_id = 12345"), ["doc_id", "kind"]).count() == 0


def test_secret_scan_is_native(spark):
    docs = spark.createDataFrame([(1, "token=abcdef12")], "doc_id long, text string")
    plan = credentials.scan(docs, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan.replace("Scan ExistingRDD", ""))
