"""The training-data operators against brute force, exact round trips and edge cases: nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns with clashing names."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

pytest.importorskip("tidemark.llm")

from pyspark.sql import functions as F  # noqa: E402

from tidemark.llm import exactdedup, htmltext, langid, lzprint, mixing, piece, simhash, toxicity, urlfilter, warc  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
EN = "the cat sat on the mat and the dog ran to the house with a ball in the rain"
DE = "der hund und die katze sind nicht in dem haus aber auf der strasse mit einem ball"
WORDS = (EN + " " + DE).split()


def lower(x):
    return (x or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    out = [None, "", "", "   ", "12 34 !!", "é", "x" * 70_000, EN * 900, EN.upper(), EN, EN] + base + base[:5]
    out += [b + " end" for b in base[:5]] + ["naïve ﬁ 漢字 😀 \t\n tab"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ("en" if i % 2 else "de") if t and i > 8 else None, f"s{i % 3}" if i % 7 else None, len(t or ""), "extra", i) for i, t in texts]
    rows += [rows[-1], rows[-1]]  # repeated rows
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, fp long").repartition(4)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


# -- language ID


def test_langid_scores_exact_code_lengths():
    model = langid.PpmModel.fit({"de": [DE.encode()], "en": [EN.encode()]})

    def cost(lang, data):
        text = b"\n\n\n" + lang.encode()
        counts = [Counter() for _ in range(5)]
        for n in range(1, 5):
            for i in range(3, len(text)):
                counts[n][text[i - n + 1 : i + 1]] += 1
        total, x = 0.0, b"\n\n\n" + data
        for i in range(3, len(x)):
            p = 1.0
            for n in range(4, 0, -1):
                ctx = x[i - n + 1 : i]
                seen = {g: c for g, c in counts[n].items() if g[:-1] == ctx}
                if not seen:
                    continue
                t, u = sum(seen.values()), len(seen)
                if ctx + x[i : i + 1] in seen:
                    p *= seen[ctx + x[i : i + 1]] / (t + u)
                    break
                p *= u / (t + u)
            else:
                p /= 256
            total -= np.log2(p)
        return total

    samples = [b"the haus", b"", b"zzz \xff", DE.encode()[:40]]
    got = model.code_lengths(samples)
    for s, row in zip(samples, got):
        assert row == pytest.approx([cost(DE, s), cost(EN, s)], abs=1e-3)
    one, two, long = (model.code_lengths([(EN * n).encode()])[0] for n in (1, 2, 30_000))  # the last is over one chunk
    assert list(long) == pytest.approx([a + 29_999 * (b - a) for a, b in zip(one, two)], rel=1e-4)
    same = langid.PpmModel.fit({"zz": [EN.encode()], "aa": [EN.encode()]})
    assert same.predict([EN.encode()])[0] == ["aa"]  # a tie goes to the language that sorts first
    assert model.predict([EN.encode(), DE.encode(), b"", b"1 2"])[0] == ["en", "de", "und", "und"]


def test_langid_query_shape(docs, empty):
    model = langid.fit(docs)
    rows = langid.identify(docs, model, ["doc_id"]).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[0].lang_pred == by[1].lang_pred == by[4].lang_pred == "und" and by[0].score == 0
    assert all(0 <= r.score <= 1 for r in rows)
    nothing = langid.fit(empty)
    assert langid.identify(empty, nothing, ["doc_id"]).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, nothing, ["doc_id"]).collect()} == {"und"}


# -- pieces


def test_piece_equals_library(docs, texts, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    by = {r.doc_id: r for r in piece.digests(docs, MODEL, ["doc_id"]).collect()}
    for i, t in texts:
        ids = lib.encode(t or "")
        assert by[i].n_tokens == len(ids)
        assert by[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert piece.digests(empty, MODEL, ["doc_id"]).count() == 0
    back = piece.decode(piece.encode(docs, MODEL, ["doc_id"]), MODEL, ["doc_id"])
    assert {r.doc_id: r.text for r in back.collect()} == {i: lib.decode(lib.encode(t or "")) for i, t in texts}


def test_piece_fuzz():
    import sentencepiece

    lib, own, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece.codec(piece.model_bytes(MODEL)), random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "é", "▁", "\0", "<s>", "<0x0A>", "ing", "漢", "😀", "％", "1", ".", "’", "\xa0"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = lib.encode(s)
        assert own.encode(s) == ids and own.decode(ids) == lib.decode(ids), s


# -- pages


def test_html_text(spark):
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a>Menu</a></li></ul></nav>
    <div class="cookie-notice">We use cookies and like to tell you at length about it, truly at length.</div><header><h2>Site</h2></header>
    <article><h1>Head &amp; line</h1><p>First <b>bold</b>text&nbsp;here.<br>next<p>Short.<aside>side</aside><form>name <input></form><p>Last paragraph of the page, which is a longer one.
    <section class="comments"><p>I disagree with all of that, said a reader at length.</p></section></article><footer>&copy; x</footer></body></html>"""
    assert htmltext.main_text(page) == "Head & line First boldtext here. next Short. Last paragraph of the page, which is a longer one."
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<p></p>") == ""
    assert htmltext.main_text("plain words only") == "plain words only"
    assert htmltext.main_text("<article><p>open") == "open"
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (1, "u", page, "x"), (3, "v", "<p>" + "w " * 100_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(tuple(r) for r in htmltext.extract(df, ["page_id"]).collect())
    assert [g[0] for g in got] == [1, 1, 2, 3] and got[2][1:] == ("", 0) and got[3][2] == 199_999
    assert htmltext.extract(df.limit(0), ["page_id"]).count() == 0


def _plain_density(lines):
    """Lines (text, tags) -> the text from the first to the last dense line, by sums as they are defined."""
    import math

    own = [len(t) / max(1, n) for t, n in lines]
    smooth = []
    for i in range(len(own)):
        w = [math.exp(-0.5 * ((i - j) / htmltext.SIGMA) ** 2) if abs(i - j) <= math.ceil(3 * htmltext.SIGMA) else 0.0 for j in range(len(own))]
        smooth.append(sum(a * b for a, b in zip(w, own)) / sum(w))
    mean = sum(smooth) / len(smooth)
    limit = min(mean, math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth)))
    at = [i for i, x in enumerate(smooth) if x >= limit]
    return " ".join(t for t, _ in lines[at[0] : at[-1] + 1])


def test_html_density_decides():
    """Pages without any element or class that tells content: the smoothed ratio alone chooses, as a plain version does."""
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    changed = 0
    for _ in range(60):
        menu = [say(rng.randint(1, 2)) for _ in range(rng.randint(8, 15))]
        body = [say(rng.randint(30, 90)) for _ in range(rng.randint(4, 12))]
        foot = [say(rng.randint(1, 2)) for _ in range(rng.randint(8, 15))]
        html = "".join(f"<div class='x1'><a href='/'><i><b>{t}</b></i></a></div>" for t in menu) + "".join(f"<div>{t}</div>" for t in body) + "".join(f"<div class='x2'><a><i><b>{t}</b></i></a></div>" for t in foot)
        parser = htmltext._Lines()
        parser.feed(html)
        parser.flush()
        got = htmltext.main_text(html)
        assert got == _plain_density([(t, n) for t, n, _, _ in parser.lines])
        assert all(t in got for t in body) and not got.startswith(menu[0] + " " + menu[1] + " ") and not got.endswith(foot[-2] + " " + foot[-1])
        changed += got != " ".join(menu + body + foot)
    assert changed == 60


def test_html_class_words_are_a_prior():
    long = "A paragraph that goes on and on about the matter of the page, " * 6
    page = f"<main class='content with-sidebar'><div class='article-header'><h1>Title</h1></div><p>{long}</p><div class='search'>find it</div><div class='review'><p>{long * 3}</p></div></main><article class='comment'><p>{long}</p></article><article><p>{long}</p></article>"
    got = htmltext.main_text(page)
    one = " ".join(long.split())
    assert got == " ".join(["Title", one, " ".join((long * 3).split()), one]) and "find it" not in got


def test_url_filter(spark):
    auto = urlfilter.WildcardAutomaton(["*", "a*b", "?x*", "", "abc", "*" + "k" * 80 + "*"])
    import fnmatch

    words = ["", "ab", "axxb", "xb", "ax", "abc", "k" * 80, "z" + "k" * 200, "a" + "k" * 63 + "b"]
    got = auto.run([w.encode() for w in words])
    for w, row in zip(words, got):
        assert list(row) == [fnmatch.fnmatchcase(w, p) for p in auto.patterns], w
    rows = [(1, "https://Sub.Example.COM/en/x?y"), (2, "http://www.example.com/en/"), (3, "ftp://a.net/fr/q"), (4, "nothing"), (5, None), (6, "http://example.com"), (7, "http://spam-farm.example.org/a"), (8, "http://notexample.com/en/"), (1, "https://Sub.Example.COM/en/x?y")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, ["page_id"]).collect()}
    assert by[1] == ("sub.example.com", "/en/x", "example.com/en/", "block") and by[2][2:] == ("www.example.com/en/", "allow")
    assert by[3][2:] == ("net/fr/", "block") and by[4] == ("", "", None, "allow") == by[5] and by[6][2:] == (None, "allow")
    assert by[7][2:] == (None, "block") and by[8][2:] == ("com/", "allow")
    assert urlfilter.judge(df.limit(0), ["page_id"]).count() == 0
    long = "http://h.org/" + "a" * 500_000
    odd = spark.createDataFrame([(1, long), (2, long + ".zip"), (3, "http://tracker1.org/x"), (4, "http://träcker.org/é")], "page_id long, url string")
    by = {r.page_id: (len(r.path), r.verdict) for r in urlfilter.judge(odd, ["page_id"]).collect()}
    assert by[1] == (500_001, "allow") and by[2] == (500_005, "block") and by[3][1] == "block" and by[4] == (2, "allow")
    # ``?`` stands for one character, whatever its bytes
    assert [list(r) for r in urlfilter.WildcardAutomaton(["a?b", "a??b"]).run(["aéb".encode(), b"axb"])] == [[True, False], [True, False]]


# -- deduplication


@pytest.mark.parametrize("block", [4, exactdedup.BLOCK])
def test_exact_dedup(docs, empty, block):
    rows = [(r.doc_id, lower(r.text)) for r in docs.select("doc_id", "text").collect()]
    groups = {}
    for i, x in rows:
        groups.setdefault(x, []).append(i)
    small = docs.where("length(text) < 5000 or text is null") if block == 4 else docs
    got = exactdedup.decisions(small, "doc_id", block=block).collect()
    assert len(got) == small.count()
    kept = Counter()
    text = dict(rows)
    for r in got:
        assert (r.keep_id, r.group_size, r.text_sha256) == (max(groups[text[r.doc_id]]), len(groups[text[r.doc_id]]), hashlib.sha256(text[r.doc_id]).hexdigest())
        kept[text[r.doc_id]] += r.kept
    assert set(kept.values()) == {1}
    assert exactdedup.decisions(empty, "doc_id").count() == 0


def test_exact_dedup_deep_texts(spark):
    """Twelve levels of names, with texts that differ in one byte at either end."""
    long = "ab c" * 4096
    rows = [(1, long), (2, "x" + long[1:]), (3, long[:-1] + "x"), (4, long.upper()), (None, long), (5, long + "a")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exactdedup.decisions(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", block=4).collect()}
    assert got == {(1, 4, 3, False), (4, 4, 3, True), (None, 4, 3, False), (2, 2, 1, True), (3, 3, 1, True), (5, 5, 1, True)}


def test_exact_dedup_carries_columns(docs):
    out = exactdedup.unique(docs, "doc_id")
    assert out.columns == docs.columns and out.count() == len({lower(r.text) for r in docs.select("text").collect()})


def test_simhash_brute_force(docs, texts, empty):
    import xxhash

    def fp(t):
        w = lower(t).split()
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))

    want = {i: fp(t) for i, t in texts}
    got = simhash.components(simhash.fingerprints(docs, ["doc_id"]), "doc_id").collect()
    assert len(got) == docs.count()
    comp = {r.doc_id: r.component_id for r in got}
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == want
    todo, seen = set(want), {}
    while todo:
        reach, edge = set(), [min(todo)]
        while edge:
            a = edge.pop()
            if a in reach:
                continue
            reach.add(a)
            edge += [b for b in todo if (want[a] ^ want[b]).bit_count() <= 4]
        for a in reach:
            seen[a] = min(reach)
        todo -= reach
    assert comp == seen
    assert simhash.components(simhash.fingerprints(empty, ["doc_id"]), "doc_id").count() == 0


def test_simhash_links_every_radius(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for x in list(fps):
        for k in range(1, 7):
            y = x
            for b in rng.sample(range(64), k):
                y ^= 1 << b
            fps.add(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "doc_id long, fp long")
    comp = {r.fp & (1 << 64) - 1: r.component_id for r in simhash.components(rows, "doc_id").collect()}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                assert comp[a] == comp[b]
    old = simhash.SHARD
    try:
        simhash.SHARD = 2  # every bucket becomes pairs of shards
        again = {r.fp & (1 << 64) - 1: r.component_id for r in simhash.components(rows, "doc_id").collect()}
    finally:
        simhash.SHARD = old
    assert again == comp


def test_near_copies_brute_force(spark):
    rng = random.Random(9)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "one  TWO"), (4, "x y z")]
    for _ in range(25):
        w = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(rng.randint(120, 400))]
        rows.append((len(rows), " ".join(w)))
        for k in (1, 2, 4, 30):  # words that are changed
            v = list(w)
            for i in rng.sample(range(len(w)), k):
                v[i] = "changed"
            rows.append((len(rows), " ".join(v)))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    sets = {i: set(simhash.shingle_hashes(lower(t), 5).tolist()) for i, t in rows}

    def alike(a, b):
        x, y = sets[a], sets[b]
        return len(x & y) / len(x | y) if x | y else 1.0

    for shard in (simhash.SHARD, 2):  # 2: all buckets of three or more become pairs of shards
        old, simhash.SHARD = simhash.SHARD, shard
        try:
            comp = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
        finally:
            simhash.SHARD = old
        assert len(comp) == len(rows) and comp[0] == comp[1] == 0 and comp[2] == comp[3] == 2 and comp[4] == 4
        lost = sum(alike(a, b) >= 0.8 and comp[a] != comp[b] for a, _ in rows for b, _ in rows if a < b)
        assert lost == 0
        for a, _ in rows:  # nobody is linked without anyone alike
            if comp[a] != a:
                assert max(alike(a, b) for b, _ in rows if b != a) >= 0.8
    assert simhash.near_copies(df.limit(0)).count() == 0
    assert simhash.near_copies(df.union(df)).count() == 2 * len(rows)


def test_near_copies_repeated_lines(spark):
    """Pairs that repeat a passage differently, and short texts: links follow the sets of shingles, not how often they come."""
    rng = random.Random(31)
    rows = []
    for k in range(60):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([6, 9, 14, 60]))]
        line = " ".join(f"l{rng.randint(0, 10**6)}" for _ in range(9))
        rows += [(len(rows), " ".join(w) + f" {line}" * 60), (len(rows) + 1, " ".join(w) + f" {line}" * 2)]
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join([*w, "end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(simhash.shingle_hashes(lower(t), 5).tolist()) for _, t in rows]
    comp = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
    for i in range(0, len(rows), 2):
        near = len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8
        assert (comp[i] == comp[i + 1]) == near, i


def test_distinct_texts_keeps_rows_of_shared_and_null_ids(spark):
    a = " ".join(f"w{i}" for i in range(100))
    near, u, v = a + " end", " ".join(f"u{i}" for i in range(100)), " ".join(f"v{i}" for i in range(100))
    rows = [(1, a, "x"), (7, near, "y"), (7, u, "z"), (None, v, "p"), (None, v + " end", "q"), (None, near + " end", "r"), (9, u, "s"), (9, u, "s"), (3, None, "n"), (4, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    out = simhash.distinct_texts(df)
    got = sorted((r.doc_id or 0, r.text, r.row) for r in out.collect())
    assert out.columns == df.columns
    assert got[1:] == sorted([(1, a, "x"), (7, u, "z"), (3, None, "n")]) and got[0] in ((0, v, "p"), (0, v + " end", "q"))
    assert simhash.distinct_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("n,kind", [(10, "sorted"), (10, "reversed"), (10, "random"), (100_000, "sorted"), (100_000, "random")])
def test_contracted_chains(spark, monkeypatch, n, kind):
    """Chains end within a logarithmic number of written tables, whatever their order."""
    ids = list(range(n))
    if kind == "random":
        random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([(max(a, b), min(a, b)) for a, b in zip(ids, ids[1:])][:: -1 if kind == "reversed" else 1], "a long, b long")
    made = []
    held = simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: made.append(1) or held(df))
    got = simhash.contracted(edges).agg(F.count(F.lit(1)), F.max("root")).first()
    assert tuple(got) == (n, 0) and len(made) <= 100


def test_near_copies_large_group(spark):
    """Several hundred different copies, in twos that are each other's nearest, are one group; with small shards too."""
    rng = random.Random(21)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    rows = []
    for k in range(150):
        v = list(base)
        v[rng.randrange(10, 290)] = f"own{k}"
        rows += [(len(rows), " ".join(v)), (len(rows) + 1, " ".join([*v[:-1], f"end{k}"]))]
    other = [f"v{rng.randint(0, 10**6)}" for _ in range(300)]
    rows.append((len(rows), " ".join(base[:180] + other[:120])))  # shares a passage only
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old = simhash.SHARD
    for shard in (old, 40):
        simhash.SHARD = shard
        try:
            comp = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
        finally:
            simhash.SHARD = old
        assert comp == {i: 0 if i < 300 else 300 for i, _ in rows}


def test_near_copies_at_the_limit(spark):
    """Pairs of exactly 0.8 are linked and pairs of 0.79 aren't, whatever their fingerprints count."""
    rng = random.Random(22)
    rows = []
    for k in range(80):
        base = [f"w{rng.randint(0, 10**9)}" for _ in range(184)]
        gone = 20 + k % 2  # of 180 shingles: 160 of 200, or 159 of 201
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:-gone] + [f"v{rng.randint(0, 10**9)}" for _ in range(gone)]))]
    passage = " ".join(f"p{i}" for i in range(40))  # a repeated passage moves the fingerprint, not the set of shingles
    rows += [(160, rows[0][1] + " " + passage), (161, rows[0][1] + f" {passage}" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(simhash.shingle_hashes(lower(t), 5).tolist()) for _, t in rows]
    want = {}
    for i, s in enumerate(sets):
        near = {want[j] for j in range(i) if len(s & sets[j]) / len(s | sets[j]) >= 0.8}
        assert len(near) <= 1
        want[i] = near.pop() if near else i
    assert [want[2 * k + 1] == 2 * k for k in range(80)] == [k % 2 == 0 for k in range(80)] and want[161] == want[160]
    assert {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()} == want


# -- mixing


def test_mixing_weights_and_copies(spark):
    rows = [(i, "a" if i < 600 else "b" if i < 750 else None if i < 770 else "c", "x" * (40 if i % 2 else 9)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    size = {i: max(1, -(-len(t) // 4)) for i, _, t in rows}
    tokens = Counter()
    for i, s, _ in rows:
        tokens[s] += size[i]
    share = {s: n / sum(tokens.values()) for s, n in tokens.items()}
    for options in ({}, {"repetition_limit": 3.0}, {"target_entropy": 1.2}, {"target_entropy": 99.0}, {"target_entropy": 0.0}):
        w = {(None if r["__mx_source"] == "null" else r["__mx_source"][1:]): r for r in mixing.weights(df, **options).collect()}
        a = w["a"]["exponent"]
        p = {s: share[s] ** a for s in share}
        assert all(w[s]["weight"] == pytest.approx(p[s] / sum(p.values())) for s in share)
        if "target_entropy" in options:
            h = -sum(r["weight"] * np.log(r["weight"]) for r in w.values())
            low = -sum(x * np.log(x) for x in share.values())
            assert h == pytest.approx(min(max(options["target_entropy"], low), np.log(4)), abs=1e-6)
        else:
            reps = [r["weight"] / share[s] for s, r in w.items()]
            assert max(reps) / min(reps) <= options.get("repetition_limit", 2.0) * (1 + 1e-9)
            assert max(reps) / min(reps) == pytest.approx(options.get("repetition_limit", 2.0))
        rest = [(r.source, r.doc_id, r["__mx_copies"], r["__mx_budget"]) for r in mixing.copies(df, **options).collect()]
        assert len(rest) == 800
        for s in tokens:
            got = sum(size[i] * c for x, i, c, _ in rest if x == s)
            budget = next(b for x, _, _, b in rest if x == s)
            assert budget - 1e-3 <= got <= budget + max(size.values())
            n = {c for x, _, c, _ in rest if x == s}
            assert max(n) - min(n) <= 1
    assert mixing.mixed(df).count() == sum(c for _, _, c, _ in ((r.source, r.doc_id, r["__mx_copies"], 0) for r in mixing.copies(df).collect()))
    assert mixing.mixed(df.limit(0)).count() == 0 and mixing.mixed(df).columns == df.columns
    half = mixing.copies(df, total=sum(tokens.values()) / 2).agg(F.sum(F.col("__mx_tokens") * F.col("__mx_copies"))).first()[0]
    assert half == pytest.approx(sum(tokens.values()) / 2, rel=0.05)


# -- fingerprints


def test_mixing_edge_rows(spark):
    rows = [(1, None, "a", "x"), (2, "", "a", "x"), (3, "w" * 100_000, None, "x"), (4, "one two", "", "y"), (4, "one two", "", "y"), (None, "z", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")
    found = mixing.copies(docs).collect()
    assert len(found) == len(rows) and all(r["__mx_copies"] >= 1 for r in found) and docs.columns == ["doc_id", "text", "source", "tokens"]
    assert {r.doc_id: r["__mx_tokens"] for r in found} == {1: 1, 2: 1, 3: 25_000, 4: 2, None: 1}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.where("doc_id = 4").count() >= 2 and out.where("doc_id is null").count() >= 1
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_lz_pairs_brute_force(docs, texts, empty):
    def phrases(t):
        seen, w = set(), b""
        for c in t.encode():
            w += bytes([c])
            if w not in seen:
                seen.add(w)
                w = b""
        return seen

    unique = docs.dropDuplicates(["doc_id"])
    old, lzprint.RANGE_ROWS = lzprint.RANGE_ROWS, 7
    try:
        got = {r.doc_id: r for r in lzprint.edited_pairs(unique).collect()}
    finally:
        lzprint.RANGE_ROWS = old
    assert len(got) == len(texts)
    order = sorted(((i, t or "") for i, t in texts), reverse=True)
    for k, (i, t) in enumerate(order):
        _, following = order[(k + 1) % len(order)]
        n = len(t)
        edited = t[: n - n // 3] + following[: n // 3]
        r = got[i]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == lzprint.spelled(lzprint.signature(t)) and r.edited_fingerprint == lzprint.spelled(lzprint.signature(edited))
        a, b, c = phrases(t), phrases(edited), phrases(following)
        exact = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        if len(a | b) <= lzprint.SIZE:
            assert r.near_edited == pytest.approx(exact(a, b))
        else:
            assert abs(r.near_edited - exact(a, b)) < 0.25
        if len(a | c) <= lzprint.SIZE:
            assert r.near_next == pytest.approx(exact(a, c))
    assert lzprint.edited_pairs(empty).count() == 0
    assert lzprint.edited_pairs(docs).count() == docs.count()  # repeated keys
    one = lzprint.edited_pairs(docs.where("doc_id = 9").limit(1)).first()
    assert one.near_next == 1.0
    assert lzprint.fingerprints(docs, ["doc_id"]).where("doc_id in (9, 10)").select("fingerprint").distinct().count() == 1


def test_lz_dictionary_starts_anew():
    old = lzprint.ROUND, lzprint.DICTIONARY
    try:
        lzprint.ROUND, lzprint.DICTIONARY = 64, 8
        text = (EN * 20).encode()
        p = lzprint.Parse(text, 100)
        assert p.signature.tolist() == lzprint.Parse(text).signature.tolist()
        assert p.edited(text[:100] + b"other" * 9).tolist() == lzprint.Parse(text[:100] + b"other" * 9).signature.tolist()
    finally:
        lzprint.ROUND, lzprint.DICTIONARY = old


# -- toxicity


def test_toxicity_learns_and_gradients_hold(spark):
    rng = random.Random(4)
    texts, bad = [], []
    for i in range(400):
        w = [rng.choice(WORDS) + rng.choice(["", "er", "le"]) for _ in range(rng.randint(5, 90))]
        t = i % 4 == 0
        for _ in range(3 if t else 0):
            w.insert(rng.randint(0, len(w)), rng.choice(["scoundrel", "grmpf" + rng.choice("abcdefgh")]))
        texts.append(" ".join(w))
        bad.append(t)
    bad = np.array(bad)
    scorer = toxicity.learn(texts[:300], bad[:300])
    s = scorer.scores(texts[300:])
    assert s[bad[300:]].min() > s[~bad[300:]].max()
    assert scorer.scores(["", EN, "grmpfz scoundrel"])[2] > 0.3 > scorer.scores([""])[0]
    net = toxicity.Network(seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = np.random.default_rng(0).normal(size=(3, 6, toxicity._INPUTS)), np.array([1.0, 0, 1])
    g = net.gradients(x, y, np.ones(3))
    loss = lambda: float(np.mean(np.logaddexp(0, net.forward(x)) - y * net.forward(x)))
    for k in ("Wf", "Ub", "att", "out", "bb", "bias"):
        at = (0,) * net.w[k].ndim
        net.w[k][at] += 1e-3
        up = loss()
        net.w[k][at] -= 2e-3
        assert g[k][at] == pytest.approx((up - loss()) / 2e-3, rel=0.05, abs=1e-4), k
        net.w[k][at] += 1e-3
    assert toxicity.learn(texts[:5], np.zeros(5, bool)) is None
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None, "", EN * 3000])] + [(0, texts[0], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bad.tolist())] + [(None, 1), (7, None), (0, 1)], "doc_id long, toxic int")
    rows = toxicity.score(df, toxicity.fit(df, labels), ["doc_id"]).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, labels.limit(0)), ["doc_id"]).collect()} == {0.0}
    assert toxicity.score(df.limit(0), scorer, ["doc_id"]).count() == 0


# -- WARC


def test_warc_round_trip(spark):
    big = "<p>" + "w " * 400_000
    rows = [(5, "http://b.com/x", "a" * 100), (3, "http://www.a.com/y?q", "a" * 100), (9, None, "a" * 100), (4, "http://a.com/", "short"), (2, "http://a.com/", "short"), (7, "x\ny", None), (8, "http://A.com/", "é" * 60), (1, "http://a.com/z", big), (3, "http://www.a.com/y?q", "a" * 100), (None, "u", "n" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    archives = warc.write(df)
    got = warc.merged(warc.read(archives)).collect()
    assert len(got) == len(rows)
    keys = [(r.url_key, r.captured) for r in got]
    assert keys == sorted(keys)
    html = {(i, u): (h or "").encode() for i, u, h in rows}
    for r in got:
        data = next(v for (i, _), v in html.items() if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 3) if r.page_id in (5, 9) else ("response", None))
    name = archives.select("archive").first()[0]
    whole = warc.archive_file(archives, name)
    found = list(warc.records(whole))
    assert sum(n for _, n, _, _ in found) == len(whole) and zlib.decompressobj(31).decompress(whole).startswith(b"WARC/1.1\r\nWARC-Type: ")
    assert warc.merged(warc.read(warc.write(df.limit(0)))).count() == 0


def test_loser_tree():
    rng = random.Random(6)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.choices(range(50), k=rng.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


# -- the pipeline


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as cp

    own = docs.select(*cp.COLUMNS)
    own.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [r.asDict() for r in own.collect()]
    kept = [r for r in rows if r["text"] and any(c.isalpha() for c in r["text"])]
    one = cp.language_id(spark, own, "")
    assert sorted(r.doc_id for r in one.collect()) == sorted(r["doc_id"] for r in kept) and one.columns == list(cp.COLUMNS)
    best = {}
    for r in kept:
        best[lower(r["text"])] = max(best.get(lower(r["text"]), -1), r["doc_id"])
    two = cp.exact_dedup(spark, one, "")
    assert sorted(r.doc_id for r in two.collect()) == sorted(best.values()) and two.columns == list(cp.COLUMNS)
    comp = {r.doc_id: r.component_id for r in simhash.near_copies(two).collect()}
    three = cp.near_dedup(spark, two, "")
    assert sorted(r.doc_id for r in three.collect()) == sorted(set(comp.values())) and three.columns == list(cp.COLUMNS)
    four = cp.mix(spark, three, "")
    assert {r.doc_id for r in four.collect()} == set(comp.values()) and four.columns == list(cp.COLUMNS)
    final = cp.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in final) == Counter(r.doc_id for r in four.collect())
    nothing = own.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, nothing, "").count() == 0
