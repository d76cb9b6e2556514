"""Token counts, decontamination, near copies, language, toxicity and pages, with odd inputs and brute force."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkwing.llm import jaccard_join, language_id, toxicity
from larkwing.llm.decontaminate import contamination, drop_contaminated
from larkwing.llm.html_text import DomModel, _order, default_model, html_text, labelled_pages, parse
from larkwing.llm.jaccard_join import STARTS, block_keys, drop_near_copies, jaccard_components, narrow_sketch
from larkwing.llm.textops import pieces, separators, string_bytes, word_hashes
from larkwing.llm.token_counts import _counter, batches, token_counts

from .test_native import FOLD, docs

ALNUM, SPACE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")


@given(st.lists(st.text(alphabet="aZ é.\n\t1'", max_size=30) | st.none(), max_size=8))
@settings(max_examples=60, deadline=None)
def test_word_hashes_are_those_of_the_words(texts):
    raw, offsets = string_bytes(pa.array(texts, pa.string()))
    for kind, pattern in (("alnum", ALNUM), ("space", SPACE)):
        seen, names = {}, {}
        for a, b in pieces(offsets, 16):
            h, n = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], separators(kind))
            words = [pattern.findall((t or "").translate(FOLD)) for t in texts[a:b]]
            assert [len(w) for w in words] == n.tolist()
            for w, x in zip((w for ws in words for w in ws), h.tolist(), strict=True):
                assert seen.setdefault(w, x) == x and names.setdefault(x, w) == w


TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
HARD = ["", "Hello world", "a <|endoftext|> b", "<|endoftext|>", "it's\t\ttabs \n\n x", "x  y   z \n", " lead", "trail  ", "naïve… 世界 مرحبا", "a b c \x1d d", "1234 5678.9,", "word. word, (x). \"q.\"", "é. ,. a.b.c", "z" * 5000, "ab " * 3000, "\n \n  \n"]


@pytest.mark.parametrize("text", HARD)
def test_pieces_count_as_the_whole(text):
    counter = _counter(str(TOKENIZER))
    assert counter.count([text, text]) == [len(counter.tokenizer.encode(text, add_special_tokens=False).ids)] * 2


@given(st.text(alphabet="aB é.,'1 \n\t(|<>", max_size=60) | st.text(alphabet="a.1 \n\t\r\x0b\x1c\x85\xa0\u180e\u200b\u2003\u2028\u3000世の。，、", max_size=40) | st.text(max_size=40))
@settings(max_examples=600, deadline=None)
def test_pieces_count_as_the_whole_for_any_text(text):
    counter = _counter(str(TOKENIZER))
    assert counter.count([text]) == [len(counter.tokenizer.encode(text, add_special_tokens=False).ids)]


def test_long_texts_are_cut_and_the_table_is_bounded(monkeypatch):
    from larkwing.llm import token_counts as module

    counter, seen = module._Counter(str(TOKENIZER)), []
    monkeypatch.setattr(module, "TABLE_CHARS", 2000)
    encode = counter.encode
    monkeypatch.setattr(counter, "encode", lambda texts: (seen.extend(texts), encode(texts))[1])
    for text in ["\tint x\t= y;\r\n" * 4000, "a\xa0b c\u2003d " * 4000, "世界の道、" * 4000, *(f"\tword{i} " * 30 + "x" * i for i in range(60))]:
        assert counter.count([text]) == [len(counter.tokenizer.encode(text, add_special_tokens=False).ids)]
        assert counter.chars <= 4000 and len(counter.known) <= 4000
    assert max(map(len, seen)) < 100


def test_token_counts(spark):
    rows = {r["doc_id"]: r for r in token_counts(docs(spark, [(i, t) for i, t in enumerate([*HARD, None])]), str(TOKENIZER), limit=5).collect()}
    assert len(rows) == len(HARD) + 1 and rows[len(HARD)]["n_tokens"] == 0 and rows[1]["n_bytes"] == 11 and not rows[1]["over_limit"] and rows[13]["over_limit"]
    assert token_counts(docs(spark, []), str(TOKENIZER)).count() == 0
    assert list(batches([5, 5, 20, 1], 10)) == [slice(0, 2), slice(2, 3), slice(3, 4)]


def brute_contamination(texts, items, n=10):
    index = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(FOLD))
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            index.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    out = {}
    for d, t in texts:
        w, hit, found = ALNUM.findall((t or "").translate(FOLD)), set(), set()
        for k in {len(x) for x in index}:
            for a in range(len(w) - k + 1):
                if (x := index.get(tuple(w[a : a + k]))) is not None:
                    hit.update(range(a, a + k))
                    found |= x
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_contamination(spark):
    r = np.random.default_rng(1)
    word = lambda: r.choice(list("abcdefg"))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((12, 14, 10, 11, 30))] + [(8, "a b"), (9, None), (10, "..."), (8, "g")]
    texts = [(i, " ".join(word() for _ in range(60))) for i in range(30)] + [(40, "Q " + items[0][1].upper() + ". q"), (41, items[4][1] + " " + items[4][1]), (42, None), (43, "a"), (44, "zz"), (45, (items[1][1] + " ") * 400)]
    got = {x["doc_id"]: tuple(x)[1:6] for x in contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_contamination(texts, items)
    clean = drop_contaminated(docs(spark, texts), spark.createDataFrame(items[:5], "item_id long, text string"))
    assert {x["doc_id"] for x in clean.collect()} == {d for d, v in brute_contamination(texts, items[:5]).items() if not v[4]}
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs(spark, texts), nothing).filter("contaminated").count() == 0 and contamination(docs(spark, []), nothing).count() == 0


def test_longest_matches_and_long_items(spark, monkeypatch):
    """An item of 20,000 words, several blocks, a match of many windows."""
    from larkwing.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 64)
    r = np.random.default_rng(6)
    long = [f"v{r.integers(10**6)}" for _ in range(20_000)]
    items = [("long", " ".join(long)), ("b", "one two three four five six seven eight nine ten eleven"), ("c", "two three four five six seven eight nine ten eleven twelve")]
    texts = [(1, "x y " + " ".join(long[500:900]) + " z"), (2, "q one two three four five six seven eight nine ten eleven twelve"), (3, "no"), (4, " ".join(long * 2))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {x["doc_id"]: tuple(x) for x in contamination(docs(spark, texts), bench).collect()}
    assert {d: v[1:6] for d, v in got.items()} == brute_contamination(texts, items)
    assert got[1][6:] == (400, "long", 2) and got[2][6:] == (11, "b", 1) and got[3][6:] == (None, None, None) and got[4][6:] == (20_000, "long", 0)


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = SPACE.findall((t or "").translate(FOLD))
        sets[i] = frozenset(tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if w else frozenset()
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_texts():
    r = np.random.default_rng(3)
    base = [[f"w{r.integers(3000)}" for _ in range(n)] for n in (3, 6, 9, 40, 120, 300, 700)]
    out, passage = [], [f"p{i}" for i in range(60)]
    for k, b in enumerate(base):
        for c in range(8):
            w = list(b)
            for _ in range(c * len(w) // 60):
                w[r.integers(len(w))] = f"x{r.integers(10**6)}"
            out.append((100 * k + c, " ".join(w)))
    out += [(1000 + i, " ".join([f"u{r.integers(10**6)}" for _ in range(40)] + passage)) for i in range(30)]
    return [*out, (2000, None), (2001, ""), (2002, " \n"), (2003, out[30][1].upper()), (2004, "one"), (2005, "ONE")]


def hot_texts():
    """A large family of near copies, and a passage that makes up a third to nine tenths of many texts."""
    r = np.random.default_rng(5)
    base, passage, out = [f"b{i}" for i in range(150)], [f"q{i}" for i in range(70)], []
    for i in range(160):
        w = list(base)
        for _ in range(i % 7):
            w[r.integers(len(w))] = f"y{r.integers(10**6)}"
        out.append((3000 + i, " ".join(w)))
    out += [(4000 + i, " ".join([f"z{r.integers(10**6)}" for _ in range(5 + i % 120)] + passage)) for i in range(160)]
    return out


@pytest.mark.parametrize(("family", "hot"), [(256, 64), (2, 64), (2, 3), (20, 10)])
def test_near_copies(spark, monkeypatch, family, hot):
    for name, value in (("FAMILY", family), ("HOT", hot), ("BLOCK", 16)):
        monkeypatch.setattr(jaccard_join, name, value)
    texts = [*near_texts(), *hot_texts(), (None, "a b c d e f g"), (5000, "h a b c d e f g")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs(spark, texts)).collect()}
    want = brute_components([(10**9 if i is None else i, t) for i, t in texts])
    want[None] = want.pop(10**9)
    assert got == want


def test_clashing_halves_of_fingerprints_are_told_apart(spark, monkeypatch):
    real = jaccard_join._fingerprints

    def weak(tokens, n):
        hi, lo = real(tokens, n)
        return hi, lo % np.uint64(3)

    rows = near_texts()[:24]
    hi, lo = real(*(lambda x: (x[2], x[1]))(next(jaccard_join._sets(pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], names=["t"]), 0, 5))))
    ids = jaccard_join._ids(hi, lo % np.uint64(3), np.arange(3, dtype=np.uint64))
    assert len(set(ids.tolist())) == len(set(zip(hi.tolist(), lo.tolist(), strict=True))) and set(weak(np.arange(9, dtype=np.uint64), np.array([4, 5]))[1].tolist()) <= {0, 1, 2}


def test_near_copies_of_nothing_and_dropping(spark):
    assert jaccard_components(docs(spark, [])).count() == 0
    kept = drop_near_copies(docs(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (3, None), (4, "q")]))
    assert {r["doc_id"] for r in kept.collect()} == {1, 3, 4} and kept.columns == docs(spark, []).columns


def test_linked_sets_share_a_key_and_sketches_bound_the_difference():
    r = np.random.default_rng(7)
    frequency = r.integers(0, 100, 1 << jaccard_join.TABLE_BITS).astype(np.uint8)
    token = lambda k: r.integers(0, 2**64, k, dtype=np.uint64)
    for size in [1, 2, 3, 4, 5, 8, 13, 20, 40, 63, 70, 200, 511, 900, 5000]:
        for hot_from in (0, 3, 20, 50, 90, 99, 200):  # all tokens hot, to none
            for _ in range(6):
                a = np.unique(token(size))
                lost, new = sorted(r.integers(0, size // 7 + 1, 2))
                b = np.unique(np.concatenate([a[lost:], token(new - lost if size > 6 else 0)]))
                common, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
                assert jaccard_join.sketch_distance(narrow_sketch(a), narrow_sketch(b)) <= union - common
                if 100 * common >= 75 * union:
                    k = block_keys(np.concatenate([a, b, token(50)]), np.array([len(a), len(b), 50]), frequency, hot_from)
                    cold = np.intersect1d(k.cold[k.cold_set == 0], k.cold[k.cold_set == 1])
                    hot = np.intersect1d(k.hot[k.hot_set == 0], k.hot[k.hot_set == 1])
                    spare = [(k.hot_rank[k.hot_set == i][:1] >> 32, k.hot_rank[k.hot_set == i][:1] & 0xFFFFFFFF) for i in (0, 1)]
                    assert len(cold) or len(hot) and spare[0][0] <= spare[1][1] and spare[1][0] <= spare[0][1]
    assert STARTS[:7].tolist() == [1, 2, 3, 5, 7, 10, 14] and (STARTS[2:] * 4 // 3 >= STARTS[2:]).all()
    assert all((n * 4 // 3) < STARTS[np.searchsorted(STARTS, n, "right") + 1] for n in range(1, 3000))


def test_words_hash_apart():
    """Texts on which polynomials modulo 2^64 fail, words of every length around the steps of eight bytes, long words."""
    morse = "a"
    for _ in range(12):
        morse += morse.translate(str.maketrans("ab", "ba"))
    words = [morse[:1024], morse[:1024].translate(str.maketrans("ab", "ba")), morse, morse.translate(str.maketrans("ab", "ba")), *("x" * n for n in range(1, 600)), *("x" * n + "y" for n in range(600))]
    raw, offsets = string_bytes(pa.array([" ".join(words)]))
    h, n = word_hashes(raw, offsets, separators("space"))
    assert n[0] == len(words) == len(set(h.tolist()))


LANGUAGES = {"en": "the quick brown fox is not here and was there with this", "de": "der schnelle braune fuchs ist nicht hier und war dort mit dieser", "fr": "le rapide renard brun est pas ici avec cette une dans", "es": "el zorro rápido no está aquí con esta una pero había"}


def test_language(spark):
    r = np.random.default_rng(2)
    rows = [(i, " ".join(r.choice(LANGUAGES[lang].split(), 12)), lang) for i in range(240) for lang in [("en", "de", "fr", "es")[i % 4]]]
    table = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows] + [(900, None, "en", "s", 0), (901, "12 34!", "de", "s", 0), (902, "der fuchs ist hier", None, "s", 0)], "doc_id long, text string, lang string, source string, score long")
    got = {x["doc_id"]: x for x in language_id.language_id(table, language_id.fit(table, per_language=40)).collect()}
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, x in got.items())
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows if got[i]["held_out"]]) > 0.95
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "de" and all(0 <= x["score"] <= 1 for x in got.values())
    empty = table.limit(0)
    assert language_id.language_id(empty, language_id.fit(empty)).count() == 0


def test_toxicity(spark):
    r = np.random.default_rng(4)
    syllables = ["ta", "ren", "mo", "li", "ves", "kor", "una", "dis"]
    clean = lambda n: " ".join("".join(r.choice(syllables, r.integers(1, 5))) for _ in range(n))
    bad = ["grumplewort", "snivelgob", "blatherskite"]
    rows = [(i, clean(60) + (f" {r.choice(bad)}, " + clean(20) if i % 4 == 0 else "")) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows] + [(0, 1, 1), (7777, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    table = docs(spark, [*rows, (900, None), (901, ""), (902, "123")])
    model = toxicity.fit(table, labels)
    got = {x["doc_id"]: x for x in toxicity.toxicity(table, model).collect()}
    held = [i for i, _ in rows if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == int(i % 4 == 0) for i in held]) > 0.97
    assert got[900]["score"] == got[901]["score"] == got[902]["score"] == 0 and all(0 <= x["score"] <= 1 for x in got.values())
    assert 440 < toxicity.drop_toxic(table, model).count() < 470
    none = toxicity.fit(table, labels.limit(0))
    assert toxicity.toxicity(table, none).filter("predicted = 1").count() == 0 and toxicity.toxicity(table.limit(0), none).count() == 0


def test_pages(spark):
    page = '<html><body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies.</div><article><h1>T &amp; x</h1><p>First  para\n<b>bold</b>.<p>Second<br>line &eacute;.</article><section id="comments"><p>Nice post, thanks for it.</p></section><footer>&copy; me</footer></body></html>'
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p>cut off he"), (5, "u", "<"), (6, "u", "<div>" * 300 + "deep enough, I think so.")]
    got = {r["page_id"]: r for r in html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "T & x\nFirst para bold.\nSecond line é." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == got[5]["text"] == ""
    assert html_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(("page", "runs"), [
    ("<p data-x=it's>one</p><p>two</p><p>three's</p>", ["one", "two", "three's"]),
    ("<script src='a.js'/>var x = 1;</script><p>t", ["t"]), ("<p>x</p><script>cut off", ["x"]), ("<SCRIPT>a</scripty></script ><p>x", ["x"]),
    ("<p>a <math><mi>x</mi><annotation>tex</annotation></math> b", ["a x b"]), ("<p>a<object>b</object> <map><a>c</a></map> <button>d</button>", ["ab c d"]),
    ("<svg><svg><text>q</text></svg><text>z</text></svg><p>t", ["t"]), ("<svg><foreignObject><p>q</p></foreignObject></svg>t", ["t"]), ("<svg><g><p>t", ["t"]), ("<svg/>t", ["t"]),
    ("<select><option>a<select><option>b</select><p>t", ["t"]), ("<div><video><p>q</p></div>t", ["t"]), ("<template><div>a<template>b</template>c</div>d</template>t", ["t"]),
    ("<head><title>q</title><p>t", ["t"]), ("<p>k<!-->l<!-- a --!>m</ x>n</>o", ["klmno"]), ('<p class="a>" = b=">" c>t', ["t"]), ("a < b <i>c", ["a < b c"]), ("&am<b>p;</b>", ["&amp;"]),
])
def test_tokens_of_html(page, runs):
    found = [n for n in default_model().marginals(parse(page)) if n.tag == "#text"]
    assert [n.text for n in found] == runs


def test_very_long_pages():
    model = default_model()
    for page in ["<p a='" + "x " * 200_000, "<p " * 100_000, "<p" + " a=" * 200_000, "<svg>" * 20_000, "<!--" * 50_000, "<div>" * 20_000 + "t", "<p>" + "word " * 200_000 + "."]:
        model.text(page)
    assert model.text("<article>" + "<p>Some words stand here, and more of them follow.</p>" * 20_000 + "</article>").count("\n") == 19_999


def test_marginals_on_held_out_layouts():
    right = wrong = 0
    for p in labelled_pages(120, seed=77):
        root = parse(p)
        for n in _order(root):
            n.label = int(n.label) if n.label is not None else 0 if n.parent is None else n.parent.label
        for n in default_model().marginals(root):
            if n.tag == "#text":
                right, wrong = right + ((n.posterior >= 0.5) == n.label), wrong + ((n.posterior >= 0.5) != n.label)
    assert right / (right + wrong) > 0.98


def test_messages_are_exact():
    """Marginals by messages are those of summing over all states of a small tree."""
    from itertools import product

    import math

    model = DomModel.train(labelled_pages(50))
    root = parse("<body><div class=ad><p>x y z</p></div><p>A longer text, as it is.</p></body>")
    nodes = model.marginals(root)
    from larkwing.llm.html_text import _features, _under

    total, on = 0.0, [0.0] * len(nodes)
    for states in product((0, 1), repeat=len(nodes)):
        y = dict(zip(map(id, nodes), states, strict=True))
        p = 0.05 if states[0] else 0.95
        for n in nodes:
            p *= math.exp(sum(model.emit.get((n.kind, f, v), (0, 0))[y[id(n)]] for f, v in _features(n)))
            if n.parent is not None:
                q = model.edge[n.kind, _under(n), y[id(n.parent)]]
                p *= q if y[id(n)] else 1 - q
        total += p
        on = [o + p * s for o, s in zip(on, states, strict=True)]
    assert np.allclose([n.posterior for n in nodes], [o / total for o in on])
