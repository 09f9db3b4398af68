"""p6 to p8 against whole-text encoding, brute force and exact round trips."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.leaks import Finder, leaks, located, normalise
from tidemark.llm.pieces import Cuts, greedy_cuts, split, split_corpus, successors
from tidemark.llm.tokens import TOKENIZERS, _pre_tokens, boundaries, certain, chunks, decode_corpus, encode_corpus, tokenizer

ODD = list("ab c'sdt  \n\n\t.,;12\x1c\x85\xa0é漢字。​ﬁ'''") + ["don't", "  ", "\r\n", "    ", "𝒳", "a" * 60, "\\section{A}", "\n\n", "\\end{equation}", "漢" * 30, " " * 40, "'s'll"]


def texts(n, most, seed=0):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def tok(name="byte_bpe_50k"):
    return tokenizer(TOKENIZERS, name)


# --- p6


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_stitched_ids_are_those_of_the_whole_text(spark, name):
    rows = [(i, t) for i, t in enumerate([*texts(60, 120), "x" * 5000, " " * 3000 + "y", "", None, "ab " * 2000])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    enc = encode_corpus(df, name=name, chunk=64, overlap=16)
    got = {r.doc_id: r.ids for r in enc.collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i] == tok(name).encoding.encode_ordinary(t or ""), i
    back = {r.doc_id: r.text for r in decode_corpus(enc, name=name).collect()}
    assert back == {i: t or "" for i, t in rows}


def test_equal_keys_come_out_each(spark):
    long_a, long_b = "ab c " * 100, "de f " * 100
    rows = [(1, long_a), (1, long_a), (1, long_b), (None, long_b), (2, "x"), (2, "x")]
    got = [(r.doc_id, tuple(r.ids)) for r in encode_corpus(spark.createDataFrame(rows, "doc_id long, text string"), chunk=64, overlap=16).collect()]
    assert sorted(got, key=repr) == sorted(((k, tuple(tok().encoding.encode_ordinary(t))) for k, t in rows), key=repr)


def test_chunks_cover_and_overlap():
    for t in texts(200, 300, 1):
        cs = chunks(t, 40, 8)
        assert cs[0][0] == 0 and cs[-1][2] == len(t)
        for (_, b, e), (a, _, _) in zip(cs, cs[1:]):
            assert a == b < e


def test_boundaries_are_those_of_the_tokenizer():
    for t in texts(100, 60, 2):
        ends = {0, *(int(e) for e in tok().ends(tok().encode(t)))}
        assert {len(t[:p].encode()) for p in boundaries(t, 0, len(t), True)} <= ends


def test_chunks_meet_without_white_space():
    text = "漢字かな交じり文。" * 27_000  # 243,000 characters
    cut = chunks(text)
    assert len(cut) == 8 and max(e - a for a, _, e in cut) < 34_000
    assert len(chunks("x1" * 100_000)) == 7 and len(chunks("x" * 200_000)) == 1
    for t in texts(200, 60, 5):
        # a tokenisation from any earlier place has a boundary where one is certain
        for m in certain().finditer(t):
            for start in range(m.start()):
                ends = {start + x.end() for x in _pre_tokens().finditer(t[start:])}
                assert m.start() in ends, (t, start, m.start())


def test_encode_nothing(spark):
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- p7

ITEM = "If one phase stabilises, then Navrátov must be data-driven and its wave keeps more than 363 ampliﬁed signals in \"x\"; both mesh"


def test_markup_is_no_obstacle():
    tex = (
        "\\newcommand{\\myA}{one phase\\xspace}\\def\\myB{wave keeps}\\newcommand\\C[1]{no #1}\n"
        "%% IF \\myA{} stabil\\-ises\\label{x y}, {\\it then} Navr\\'{a}tov~\\cite[see][]{a1,b} must\\,be data-driven and\n% its \\myB\\ \\textbf{more} than 363 amplified\\\\ si{g}nals in ``x''; both m\\\"esh"
    )
    assert normalise(ITEM) in normalise(tex)
    f = Finder([(7, ITEM)])
    (found,) = f.find(tex)
    assert found[0] == 7 and found[3] == len(normalise(ITEM).split())
    w, places = located(tex)
    assert " ".join(w) == normalise(tex)
    assert tex[places[found[2]][0] :].startswith("IF")


@pytest.mark.parametrize("how", ["\\newcommand", "\\renewcommand", "\\providecommand", "\\DeclareRobustCommand", "\\DeclareMathOperator", "\\def", "\\gdef", "\\edef", "\\xdef"])
def test_own_macros_of_one_kind(how):
    tex = f"{how}\\m{{one phase}}\n" + ITEM.replace("one phase", "\\m{}")
    assert normalise(ITEM) in normalise(tex)
    assert " ".join(located(tex)[0]) == normalise(tex)
    (found,) = Finder([(7, ITEM)]).find(tex)
    assert found[3] == len(normalise(ITEM).split())


@pytest.mark.parametrize("space", ["\\hspace{1em}", "\\hspace*{-2pt}", "\\vspace {3ex}", "\\hspace{\\stretch{1}}", "\\hskip{1em}", "\\hskip 1em ", "\\hskip1em", "\\vskip -.5\\baselineskip ", "\\hskip 2,5 true cm plus 1fil minus 2pt ", "\\hskip\\parindent ", "\\def\\gap{\\hspace{1em}}\\gap "])
def test_spacing_parts_words(space):
    assert normalise(f"foo{space}bar") == "foo bar"
    assert located(f"foo{space}bar")[0] == ["foo", "bar"]
    tex = ITEM.replace(" ", space)
    assert [x[3] for x in Finder([(7, ITEM)]).find(tex)] == [len(normalise(ITEM).split())]


def test_located_agrees_with_normalise():
    rnd = random.Random(4)
    bits = ["\\emph{", "}", "\\v C", "\\'e", "\\ss ", "\\o", "ß", "é", "e\u0301", "ﬁ", "Æ", "\\-", "\\,", "\\\\", "%", "\n", " ", "a", "B", "7", "_", "\\cite{k}", "\\citep[a][b]{k}", "\\label{l}", "\\hspace{1em}", "\\let\\q\\emph", "\\def\\m{x \\n}", "\\m", "\\newcommand{\\n}{y}", "\\n{}", "\\", "\\renewcommand*{\\m}[0]{zz}", "\\m\\m", "\\DeclareMathOperator{\\p}{p\\,q}", "\\p"]
    for _ in range(1500):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))
        w, places = located(t)
        assert " ".join(w) == normalise(t), t
        assert all(0 <= a < b <= len(t) for a, b in places)


def test_runs_against_brute_force(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 30)))) for i in range(12)] + [(90, None), (91, "")]
    docs = []
    for d in range(60):
        t = []
        for _ in range(rnd.randint(0, 4)):
            src = rnd.choice(items[:12])[1].split()
            a = rnd.randrange(len(src))
            t += src[a : a + rnd.randint(1, 20)] + [rnd.choice(words) for _ in range(rnd.randint(0, 3))]
        docs.append((d, " ".join(t)))
    docs += [(100, None), (101, "")]
    n = 6
    want = set()
    for d, t in docs:
        w = (t or "").split()
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, s in items:
            v = (s or "").split()
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                want.add((d, i))
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (10**6, 100):  # one automaton, several ones
        got = {(r.doc_id, r.item_id) for r in leaks(dd, ii, words=n, block_chars=block).collect()}
        assert got == want
    r = leaks(dd, ii, words=n).first()
    text = dict(docs)[r.doc_id]
    assert text[r.start : r.end].split() == dict(items)[r.item_id].split()[r.item_word : r.item_word + r.n_words]


def test_every_maximal_run_comes_once():
    """Against all pairs of places, with few words, so that blocks repeat and overlap."""
    rnd = random.Random(11)
    for n in range(300):
        words = "ab" if n % 2 else "abcd"
        items = [(i, " ".join(rnd.choice(words) * rnd.choice([1, 1, 5]) if n % 3 else rnd.choice(words) for _ in range(rnd.randint(1, 25)))) for i in range(3)]
        w = [rnd.choice(words) for _ in range(rnd.randint(0, 40))]
        want = []
        for i, t in items:
            v = t.split()
            for a in range(len(v)):
                for b in range(len(w)):
                    if v[a] == w[b] and not (a and b and v[a - 1] == w[b - 1]):
                        size = 0
                        while a + size < len(v) and b + size < len(w) and v[a + size] == w[b + size]:
                            size += 1
                        if size >= 5:
                            want.append((i, a, b, size))
        assert sorted(Finder(items, 5).find(" ".join(w))) == sorted(want), (items, w)


def test_long_and_repeated_passages_take_linear_time():
    import time

    def seconds(item, text):
        f = Finder([(1, " ".join(item))])
        f.find("a")
        best = min(_timed(time, f, " ".join(text)) for _ in range(3))
        return best

    words = [f"w{i}" for i in range(8000)]
    assert seconds(words, ["x", *words, "y"]) < 0.1 and seconds(["a"] * 1000, ["a"] * 1000) < 0.1


def _timed(time, f, text):
    began = time.perf_counter()
    assert f.find(text)
    return time.perf_counter() - began


def test_leaks_of_nothing(spark):
    e = spark.createDataFrame([], "doc_id long, item_id long, text string")
    one = spark.createDataFrame([(1, 1, "a b c")], e.schema)
    assert leaks(e, one).count() == leaks(one, e).count() == leaks(one, one).count() == 0


# --- p8


def verify(t, pieces, limit, overlap):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(t)
    for i, (s, e, n, o, _) in enumerate(pieces):
        assert len(tok().encode(t[s:e])) == n <= limit
        if i:
            ps, pe = pieces[i - 1][:2]
            assert ps <= s <= pe < e
            assert len(tok().encode(t[s:pe])) == o and (o >= overlap or s == 0)


def test_pieces_of_odd_texts():
    rnd = random.Random(2)
    for t in texts(250, 200, 3):
        overlap = rnd.randint(0, 20)
        limit = overlap + rnd.randint(16, 80)
        pieces = split(t, tok(), limit, overlap)
        if len(tok().encode(t)) <= limit:
            assert pieces is None
        else:
            verify(t, pieces, limit, overlap)


def test_doubling_is_following():
    t = " ".join(f"Sentence number {i} is here. And\n\nmore{'' if i % 7 else '\\section{S}'}" for i in range(400))
    c = Cuts(t, tok(), tok().encode(t), 20)
    _, end = successors(c.cost, c.kind, 60, 10)
    at, want = 0, [0]
    while at != len(end) - 1:
        at = int(end[at])
        want.append(at)
    assert list(greedy_cuts(end)) == want


def test_stretches_are_encoded_only_where_cuts_are():
    import time

    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefghij") for _ in range(400_000))
    tok().encode("warm")
    began = time.perf_counter()
    pieces = split(text, tok(), 512, 64)
    assert time.perf_counter() - began < 3
    verify(text, pieces, 512, 64)


def test_cuts_are_natural():
    para = "This is a sentence of the paragraph. " * 6
    t = "\n\n".join(f"\\section{{S{i}}}\n\n{para.strip()}\n\n{para.strip()}" for i in range(5))
    pieces = split(t, tok(), 130, 8)
    assert {p[4] for p in pieces} <= {"section", "paragraph", "end"}
    verify(t, pieces, 130, 8)


def test_long_texts_are_cut_alike_by_many_tasks(spark):
    """Chunks, blocks and squared tables against the local way, with stretches and repeated rows."""
    rnd = random.Random(12)
    words = ["alpha", "beta,", "don't", "gamma.", "delta? ", "x1", "漢字。", "\n\n", "\\section{A}", "\\end{equation}", "é", "'quoted'", "%", "   "]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1500, 3000)))) for i in range(4)]
    rows += [(0, rows[0][1]), (9, rows[1][1] + "z" * 3000 + rows[2][1]), (10, "ab" * 2000), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = split_corpus(df, limit=40, overlap=8, long_chars=1000, chunk=900)
    by = {}
    for r in got.collect():
        by.setdefault((r.doc_id, r.piece_no), []).append((r.start, r.end, r.n_tokens, r.overlap_tokens, r.cut))
    want = {}
    for k, t in rows:
        for i, p in enumerate(split(t, tok(), 40, 8)):
            want.setdefault((k, i), []).append(p)
    assert {k for k, _ in by} == {k for k, _ in want} == {0, 1, 2, 3, 9, 10, None}
    assert {k: v for k, v in by.items() if k[0] not in (9, 10)} == {k: v for k, v in want.items() if k[0] not in (9, 10)}
    for k, t in rows:
        mine = [by[k, i][0] for i in range(sum(1 for x in by if x[0] == k))]
        verify(t, mine, 40, 8)
    text = dict(rows)
    assert all(r.piece == text[r.doc_id][r.start : r.end] and r.n_pieces == sum(1 for x in by if x[0] == r.doc_id) for r in got.collect())


def test_split_corpus(spark):
    rows = [(1, "word " * 3000), (2, "short"), (3, None), (4, ""), (5, "z" * 20_000), (5, "z" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit(0))
    got = split_corpus(df, limit=256, overlap=32).collect()
    assert {r.doc_id for r in got} == {1, 5}
    assert sum(r.piece_no == 0 for r in got if r.doc_id == 5) == 2
    for r in got:
        assert r.piece == dict(rows)[r.doc_id][r.start : r.end] and r.n_tokens <= 256
    with pytest.raises(ValueError):
        split_corpus(df, limit=40, overlap=32)
    assert split_corpus(df.limit(0)).count() == 0
