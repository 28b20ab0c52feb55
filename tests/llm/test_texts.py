import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from figmill.llm import bpe, leaks, lookalikes

VOCAB = f"{bpe.FOLDER}/byte_bpe_50k.tiktoken"
needs_vocab = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary file")


@pytest.fixture(scope="module")
def encoders():
    tiktoken = pytest.importorskip("tiktoken")
    tokens = bpe.read_ranks(VOCAB)
    ranks = {t.encode("latin-1"): i for i, t in enumerate(tokens)}
    return bpe.Encoder(tokens), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@needs_vocab
@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(), st.sampled_from("aeiou thsn\n\t'é漢🔬12_=- "))))
def test_encoding_equals_merges(encoders, text):
    text = text.encode("utf-8", "ignore").decode("utf-8")
    mine, theirs = encoders
    ids = mine.encode(text)
    assert ids == theirs.encode_ordinary(text) and "".join(mine.tokens[i] for i in ids).encode("latin-1").decode("utf-8") == text


@needs_vocab
def test_encode_corpus(spark, encoders):
    long = "abc déjà 漢字 " * 20_000 + "z" * 30_000
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Hello <|endoftext|> you", 0), (3, "Hello <|endoftext|> you", 0), (4, long, 0), (5, "   ", 0)], "doc_id long, text string, ids int")
    got = bpe.encode_corpus(df, VOCAB).collect()
    assert len(got) == 6 and [r.ids for r in got if r.doc_id in (1, 2)] == [[], []]
    for r in got:
        if r.doc_id > 2:
            assert r.ids == encoders[1].encode_ordinary(long if r.doc_id == 4 else {3: "Hello <|endoftext|> you", 5: "   "}[r.doc_id])
    assert bpe.encode_corpus(df.where("false"), VOCAB).count() == 0


SAME = [("ＡＢ１ ％", "AB1 %"), ("déjà", "de\u0301ja\u0300"), ("ﬁne ﬀ ﬄ", "fine ff ffl"), ("a\u00a0b\u2007c\u202fd", "a b c d"), ("x\u2011y", "x-y"), ("wo\u200brd\u00ad\ufeff\u2060", "word"), ("раѕѕ", "pass"), ("ΑΒΕ", "ABE"), ("\u212a", "K"), ("µm", "μm"),
        ("ﾊﾞﾝﾄﾞ", "バンド"), ("ё", "ë"), ("ԁоɡ", "dog")]
DIFFERENT = [("a", "A"), ("dejà", "déjà"), ("m²", "m2"), ("9", "⁹"), ("a b", "ab"), ("-", "—"), ("\U0001f469\u200d\U0001f52c", "\U0001f469\U0001f52c"), ("\n", " "), ("½", "1/2"), ("n", "ñ")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_form(a, b):
    c = lookalikes.Canonical([("pass", 3), ("dog", 2), ("раѕѕ", 9), ("word", 1)])
    assert lookalikes.by_table(a) == lookalikes.by_table(b) and c.text(a) == c.text(b) and c.text(f"x {a}, {a}") == c.text(f"x {b}, {b}")


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_other_form(a, b):
    c = lookalikes.Canonical([("pass", 3)])
    assert lookalikes.by_table(a) != lookalikes.by_table(b) and c.text(a) != c.text(b)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_form_is_stable(text):
    t = lookalikes.by_table(text)
    assert lookalikes.by_table(t) == t
    c = lookalikes.Canonical([("abc", 1), ("Рецензент", 4)])
    assert c.text(c.text(text)) == c.text(text)
    two = set(lookalikes.TWO_SHAPES) & set(text)
    assert (c.text(text) == c.text(t)) or "\u200d" in text or two


def test_trie():
    t = lookalikes.SpellingTrie([("pane", 1), ("panel", 5), ("раnеl", 7), ("ﬁne", 2), ("сок", 3), ("cок", 4)])
    assert t.spell("panel") == "panel" and t.spell("p\u200banеl") == "panel" and t.spell("panle") is None and t.spell("panle", 2) == "pane" and t.spell("panxl", 1) == "panel" and t.spell("pan", 1) == "pane" and t.spell("zzz", 1) is None
    assert t.spell("coк") == "cок"  # the most frequent of two that are not plain


def test_the_automaton_reads_a_letter_of_two_shapes(spark):
    # a palochka and a Cyrillic I stand for l or I; the table knows one shape at most, the vocabulary which word there is
    t = lookalikes.SpellingTrie([("Illumina", 3), ("label", 2), ("Iabe", 1)])
    assert t.spell("\u04c0llumina") == "Illumina" and t.spell("\u0406abel") == "label" and t.spell("\u0406abe") == "Iabe"
    assert t.spell("\u0406abel", 0) is None and lookalikes.by_table("\u04c0llumina") != "Illumina" and lookalikes.by_table("\u0406abel") == "Iabel"
    docs = [(1, "by Illumina"), (2, "by \u04c0llumina"), (3, "a label"), (4, "a \u0406abel"), (5, "by lllumina"), (6, "a Iabel\u0301"), (7, "Россия"), (8, "Pоссия"), (9, "Россия Россия")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in lookalikes.same_to_the_eye(df).collect()) == [(1, 2), (3, 4), (7, 8)]
    c = {r.doc_id: r.canonical for r in lookalikes.canonical_texts(df).collect()}
    assert c[2] == "by Illumina" and c[4] == "a label" and c[8] == "Россия"


def test_hot_texts_are_split(spark):
    docs = [(i, "déjà" if i % 3 else f"t{i}é") for i in range(6000)] + [(9000, "de\u0301jà"), (9001, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(r) for r in lookalikes.same_to_the_eye(df).collect()]
    assert sorted(got) == [(i, 9000) for i in range(6000) if i % 3]


def test_foreign_tokens_are_the_tokens():
    for text in ["abc déf ab\u200bc x", "a1_é b é_ \u0301ab 漢字x y漢", "\u200babc\u00ad d", "plain only 1_2"]:
        assert lookalikes._foreign_tokens().findall(text) == [t for t in lookalikes._tokens().findall(text) if not t.isascii()]


def test_same_to_the_eye(spark):
    docs = [(1, "déjà vu"), (2, "de\u0301jà vu"), (3, "déjà vu"), (4, "deja vu"), (5, None), (6, ""), (7, "\u200b"), (8, ""), (9, "déj\u200bà\u00a0vu"), (10, "\u2060"), (11, "x" * 300_000 + "а"), (12, "x" * 300_000 + "a")]
    df = spark.createDataFrame([(*d, "f", "s") for d in docs], "doc_id long, text string, form string, stored string")
    got = sorted(tuple(r) for r in lookalikes.same_to_the_eye(df).collect())
    assert got == [(1, 2), (1, 9), (2, 3), (2, 9), (3, 9), (7, 10), (11, 12)]
    assert lookalikes.same_to_the_eye(df.where("false")).count() == 0
    c = {r.doc_id: r.canonical for r in lookalikes.canonical_texts(df).collect()}
    assert c[5] is None and c[6] == "" and c[7] == "" and c[1] == c[2]


ITEM = "Why must panel seven be rejected when the western blot of VIM-7 appears uneven within the third lane of figure nine? Explain the answer with two words."


def test_word_forms():
    assert leaks.words("> Why  MUST\n> panel-7, “ｂｅ” r\u200bejected\\u0430?") == ["why", "must", "panel", "7", "be", "rejecteda"]
    assert leaks.words(None) == [] and leaks.words("...") == []


def test_passages_hold_every_run(monkeypatch):
    import pyarrow as pa

    for n in range(1, 120):
        s = leaks.starts(n, leaks.ITEM_PASSAGE, leaks.ITEM_STRIDE)
        e = np.minimum(s + leaks.ITEM_PASSAGE, n)
        assert e[-1] == n and (np.diff(s) > 0).all()
        for a in range(n - leaks.RUN + 1):
            assert ((s <= a) & (e >= a + leaks.RUN)).any()
    lengths = [0, 5, 12, 13, 24, 25, 300, 0, 7, 1000]
    texts = [[1000 * i + j for j in range(n)] for i, n in enumerate(lengths)]
    for chunk in (24, 60, 100_000):
        monkeypatch.setattr(leaks, "CHUNK", chunk)
        seen, count = set(), 0
        for c in leaks._chunks(pa.array(texts, pa.list_(pa.int64()))):
            w, there = c.windows(np.arange(len(c.first)))
            for x, ok, r in zip(w, there, c.row):
                x = x[ok].tolist()
                assert x == list(range(x[0], x[0] + len(x))) and x[0] // 1000 == r
                seen |= {(x[i], x[i] + 11) for i in range(len(x) - 11)}
                count += 1
        assert seen == {(1000 * i + j, 1000 * i + j + 11) for i, n in enumerate(lengths) for j in range(n - 11)}
        assert count == sum(max(1, -(-n // 12) - 1) for n in lengths if n)


def test_sketch_is_the_matrix_product():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 50, n).tolist() for n in (0, 3, 30, 200, 61)]
    weight, omega = rng.random(leaks.FEATURES) + 1, rng.standard_normal((leaks.FEATURES, 4))
    got, rows = np.zeros(omega.shape), []
    for c in leaks._chunks(pa.array(texts, pa.list_(pa.int64()))):
        at, share = leaks._sketch(c, weight, (weight[:, None] * omega))
        got[at] += share
    for t in texts:
        for i in range(max(1, -(-len(t) // 12) - 1) if t else 0):
            a = np.zeros(leaks.FEATURES)
            for w in t[12 * i:12 * i + 24]:
                a[w] += weight[w]
            rows.append(a)
    a = np.array(rows)
    assert np.allclose(got, a.T @ (a @ omega))


def test_common_runs():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 3, (400, 24)), rng.integers(0, 3, (400, 18))
    for i in range(0, 400, 2):
        n, s, t = int(rng.integers(10, 15)), int(rng.integers(0, 10)), int(rng.integers(0, 4))
        a[i, s:s + n] = b[i, t:t + n]
    there, also = np.arange(24) < rng.integers(10, 25, 400)[:, None], np.arange(18) < rng.integers(12, 19, 400)[:, None]
    got = leaks.common_runs(a, there, b, also)
    want = [leaks.longest_run(x[m].tolist(), y[k].tolist()) >= 12 for x, m, y, k in zip(a, there, b, also)]
    assert got.tolist() == want and any(want) and not all(want)


def test_subsequence_and_run():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(0, 25)).tolist(), rng.integers(0, 5, rng.integers(0, 25)).tolist()
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        r = np.zeros_like(t)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
                r[i + 1, j + 1] = r[i, j] + 1 if x == y else 0
        assert leaks.common_subsequence(a, b) == t[-1, -1] and leaks.longest_run(a, b) == r.max()


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, text(40) + ".", "no" if i % 2 else None) for i in range(30)] + [(30, ITEM, "reuse"), (31, "too short to leak", None), (32, None, None), (30, ITEM, "reuse")]
    docs, want = [(0, None), (1, ""), (2, "   ")], set()
    for d in range(3, 160):
        body = text(int(rng.integers(0, 120)))
        if d % 3 == 0:
            k = int(rng.integers(0, 31))
            w = leaks.words(items[k][1])
            n = int(rng.integers(8, 20))
            s = int(rng.integers(0, max(1, len(w) - n)))
            body += "\n> " + ",\u00a0".join(x.upper() for x in w[s:s + n]) + "\n" + text(5)
        docs.append((d, body))
    docs.append((200, text(30_000) + " " + ITEM + " " + text(3000)))
    docs.append((200, docs[-1][1]))
    grams = {}
    for i, t, _ in items:
        w = leaks.words(t)
        for j in range(len(w) - 11):
            grams.setdefault(tuple(w[j:j + 12]), set()).add(i)
    for d, t in docs:
        w = leaks.words(t)
        for j in range(len(w) - 11):
            want |= {(d, i) for i in grams.get(tuple(w[j:j + 12]), ())}
    dd = spark.createDataFrame([(*x, 1, "clash") for x in docs], "doc_id long, text string, run int, kind string")
    ii = spark.createDataFrame(items, "item_id long, text string, answer string")
    got = leaks.leaks(dd, ii)
    rows = got.where("kind = 'verbatim'").collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(want) > 20
    assert sum(r.doc_id == 200 for r in rows) == 2 and all(r.run >= 12 for r in rows)
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(dd, ii, paraphrases=False).collect()} == want
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 7)
    assert {tuple(r) for r in leaks.leaks(dd, ii).collect()} == {tuple(r) for r in got.collect()}
    assert leaks.leaks(dd.where("false"), ii).count() == 0 and leaks.leaks(dd, ii.where("false")).count() == 0


def test_paraphrase_needs_the_answer(spark):
    w = ITEM.split()
    changed = " ".join("x" if i % 9 == 4 else x for i, x in enumerate(w))
    dd = spark.createDataFrame([(1, changed + " It is reuse."), (2, changed)], "doc_id long, text string")
    ii = spark.createDataFrame([(1, ITEM, "reuse")], "item_id long, text string, answer string")
    got = {r.doc_id: r.kind for r in leaks.leaks(dd, ii).collect()}
    assert got == {1: "paraphrase"}
