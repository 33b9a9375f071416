"""The training-data operators against brute force, exact round trips and held-out rows."""

import hashlib
import math
import os
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import decontaminate, html_text, images, langid, near_dup, ngram_lm, packing, quality, queries, subword, toxicity, url_filter
from factloom.llm.graph import components

DIR = "/root/testdata/sf0.001"
ODD = [(1, "one two three four five six seven eight nine ten eleven"), (1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, ""), (None, "zero one two three four five six seven eight nine ten"), (4, "..."), (5, "naïve 日本語 ½ x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", 7.5, "k") for i, t in ODD], "doc_id bigint, text string, lang string, score double, class_id string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def test_globs():
    patterns = ["*.com#/en/*", "a?c", "*", "", "x*y*z", "\\*", "*" + "q" * 150]
    texts = [".a.com#/en/x", "abc", "", "xyz", "xayaz", "*", "z" * 70 + "q" * 150, "aéc"]
    rule = lambda p: re.compile("(?s)" + re.sub(r"\\\\\*", "§", re.escape(p)).replace(r"\*", ".*").replace(r"\?", ".").replace("§", r"\*"))
    got = url_filter.GlobAutomaton(patterns).match(texts)
    for i, t in enumerate(texts):
        for j, p in enumerate(patterns):
            if p != "\\*":
                assert got[i, j] == bool(rule(p).fullmatch(t)), (t, p)
    assert got[5, 5] and not got[1, 5]


def test_urls(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "HTTP://WWW.Example.COM/en/a?b"), (4, "http://example.com"), (5, "http://notexample.com/en/"), (6, "http://a.net/fr/#x"), (7, "s://spam-farm.example.org/"), (8, "s://o.org/x.example.com/en/")], "page_id int, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, queries.RULES, queries.GLOBS).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), 4: ("example.com", "", None, "allow"), 5: ("notexample.com", "/en/", "com/", "allow"), 6: ("a.net", "/fr/", "net/fr/", "block"), 7: ("spam-farm.example.org", "/", None, "block"), 8: ("o.org", "/x.example.com/en/", None, "allow")}


def test_encoder_is_exact():
    path = public_tokenizers.path(packing.TOKENIZER)
    plain, encode = Tokenizer.from_file(path), packing.TextEncoder(path)
    texts = ["it's a test, isn't it? <|endoftext|>abc <|ENDOFTEXT|> I'LL", "naïve étude Å Å İ ß ² Ⅷ ×÷ a×b", "日本語 テスト,abc.def", "", "x y\x1cz\x85w  \xa0", "don't'ss 12abc34 _x_ é,è.ü!Ö?", "ßà í Àß ÍÀ \u212a \u212bb µª", "a\x85b\xa0c\u2003d", "x" * 60 + " é" * 600 + " " + " ".join(f"w{n}í" for n in range(1500))]
    assert [np.frombuffer(b, "<u4").tolist() for b in encode([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_of_another_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.TextEncoder._lean_of(Tokenizer.from_file(path)) is None
    assert packing.TextEncoder._lean_of(Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))) is not None


def test_language_cache_changes_no_result():
    trees = {k: langid.PpmTree(Counter(w.encode() for w in words.split()), 4) for k, words in (("de", "der die das und nicht ein haus"), ("en", "the and not a house of words"))}
    texts = [b"the house and words", b"das haus und die worte", b"", b"12 34", b"houses " * 50 + b"haus"]
    small, large = langid.LanguageScorer(trees, 1), langid.LanguageScorer(trees)
    assert [small.predict(t) for t in texts] == [large.predict(t) for t in texts]


def test_packing(spark, odd, empty):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = packing.pack(docs, capacity=256, keep_ids=True).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    expected = Counter((r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0])) for r in docs.collect())
    sequences, whole = {}, {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 256 and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["start"] == r["piece"] * 256
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        whole.setdefault((r["doc_id"], r["piece"]), []).append(tuple(ids))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r["length"] for r in got) == sum(len(k[1]) * n for k, n in expected.items())
    assert len(sequences) <= math.ceil(sum(r["length"] for r in got) / 256) * 1.02 + 1
    assert packing.pack(empty).count() == 0


def test_plan_takes_all():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = np.bincount(rng.integers(1, 65, rng.integers(1, 200)), minlength=65)
        bins = packing.plan_bins(counts, 64)
        held = Counter()
        for lengths, times in bins:
            assert sum(lengths) <= 64
            for k in lengths:
                held[k] += times
        assert held == Counter({k: int(n) for k, n in enumerate(counts) if n})


def brute_hits(text, tests):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, items = set(), set()
    for item, t in tests:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        m = min(10, len(w))
        windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(words) - m + 1):
            if tuple(words[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                items.add(str(item))
    return len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 40])
def test_decontamination(spark, odd, empty, block):
    tests = [(7, "One two three four five six seven eight nine TEN eleven twelve"), (10, "日本語 ½"), (11, "seven eight"), (None, "one"), (12, None), (13, "")]
    bench = spark.createDataFrame(tests, "item_id bigint, text string")
    got = decontaminate.decontaminate(odd, bench, block_bytes=block).collect()
    expected = Counter((i, *brute_hits(t, [x for x in tests if x[0] is not None])) for i, t in ODD)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got) == expected
    assert decontaminate.decontaminate(empty, bench).count() == 0
    kept = decontaminate.uncontaminated(odd, bench, block_bytes=block)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {2, 3, 4}


@pytest.mark.parametrize("piece", [decontaminate.PIECE, 7, 40, 300])
def test_search_equals_brute_force(piece, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    monkeypatch.setattr(decontaminate, "SEGMENT", 5)
    rng = np.random.default_rng(piece)
    some = lambda n: " ".join(rng.choice(["a", "b", "cc", "d" * 50, "é"], n, p=[0.4, 0.3, 0.1, 0.1, 0.1]))
    tests = [(f"i{k}", some(rng.integers(1, 14))) for k in range(30)] + [("i0", some(11)), ("x", "...")]
    made = [decontaminate.Automata.built([(i, t.encode()) for i, t in part], 10) for part in (tests[:9], tests[9:], [])]
    texts = [some(n).replace(" ", sep) for n in (0, 1, 5, 90, 300) for sep in (" ", ",\n ")]
    for run in (texts, *([t] for t in texts)):
        data = [t.encode() for t in run]
        n_words, spans, items = decontaminate.find(np.frombuffer(b"".join(data) or b"\0", np.uint8)[: sum(map(len, data))], np.cumsum([0, *map(len, data)]), made, 10)
        for t, n, s, i in zip(run, n_words, spans, items, strict=True):
            assert (n, int((s[:, 1] - s[:, 0]).sum()), len(i), hashlib.sha256(",".join(i).encode()).hexdigest()) == brute_hits(t, tests)
            assert all(a < b for a, b in s) and all(x[1] < y[0] for x, y in zip(s, s[1:], strict=False))


def bag(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    items = rng.integers(1, 2**63, 60).astype(np.uint64)
    x, y = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    row = np.r_[np.zeros((x > 0).sum(), int), np.ones((y > 0).sum(), int)]
    sig = near_dup.bag_minhash(row, np.r_[items[x > 0], items[y > 0]], np.r_[x[x > 0], y[y > 0]], 2, 4096)
    truth = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((sig[0] == sig[1]).mean() - truth) < 4 * math.sqrt(truth * (1 - truth) / 4096)


def test_near_duplicates(spark, odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(400)]
    for i in range(40):  # a group of varied copies
        w = list(base)
        for k in rng.integers(0, 400, 6):
            w[k] = f"v{i}x{k}"
        docs.append((10_000 + i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bags = [bag(t) for _, t in docs]
    top = list(range(len(docs)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = bags[i], bags[j]
            n, m = sum(a.values()), sum(b.values())
            if a and b and min(n, m) >= 0.8 * max(n, m):
                same = sum((a & b).values())
                if same >= 0.8 * (n + m - same):
                    p, q = find(i), find(j)
                    top[max(p, q)] = min(p, q)
    expected = {docs[i][0]: docs[find(i)][0] for i in range(len(docs))}
    got = near_dup.near_duplicates(df).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == expected
    assert sum(r["kept"] for r in got) == len(set(expected.values()))
    few = near_dup.near_duplicates(odd).collect()
    assert len(few) == len(ODD) and sum(r["kept"] for r in few) == len(ODD) - 1
    clash = odd.selectExpr("*", "'x' AS UID", "'y' AS c1")
    kept = near_dup.deduplicate(clash)
    assert kept.columns == clash.columns and {r["UID"] + r["c1"] for r in kept.collect()} == {"xy"} and near_dup.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 60), (60, 50), (70, 70)], "u bigint, v bigint")
    got = {r["id"]: r["label"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 60: 50}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a>Menu</a></nav><div class="ad">Buy</div>
<article><h1>Title &amp; more</h1><p>One <b>two.<br><p>Three&nbsp;&lt;b&gt;  four</p><div id="comments"><p>reader</p></div><aside>side</aside><form>f</form><p class="cookie-notice">n</p><ul><li>x<li>y</ul></article><footer>&copy;</footer>"""


def test_html(spark):
    assert html_text.blocks_of(PAGE) == (True, ["Title & more", "One two.", "Three <b> four", "x", "y"])
    for odd_html in (None, "", "<", "<p", "a < b", "<p title='x>y'>z", "<!-- x", "<script>", "<b" * 2000, "</p></div>"):
        html_text.blocks_of(odd_html)
    shell = "<html><body><p>Home of all the good things that we have to sell here</p><p>{}</p></body>"
    rows = [(i, f"http://h.com/{i}", shell.format(f"page {i} says something of its own")) for i in range(4)] + [(9, "http://h.com/9", PAGE), (10, None, None)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[1] == "page 1 says something of its own" and got[9].startswith("Title & more\nOne two.") and got[10] == ""


SHELL = "<html><body><p>Home of all the good things that we have to sell here</p><p>page {} says something of its own</p>{}</body>"


def test_html_marks_that_open_no_main_part(spark):
    tails = ["<!-- <main> -->", "<script>var a = '<article >'</script>", "<style>[role=main] {}</style>", "<main></main>", "<nav><article>x</article></nav>"]
    rows = [(i, f"http://h.com/{i}", SHELL.format(i, t)) for i, t in enumerate(tails)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {i: f"page {i} says something of its own" for i in range(len(tails))}


def test_html_of_a_large_host(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 10**9, n))
    shared = [words(12) for _ in range(20)]
    rows = [(i, f"http://h.com/{i}", f"<body><p>{words(150)}</p><p>{shared[i % 20] if i < 100 else words(9)}</p></body>") for i in range(1200)]
    rows += [(2000 + i, f"http://g.com/{i}", f"<body><p>{shared[0]}</p></body>") for i in range(2)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    text = lambda: {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert sum(len(h) for _, _, h in rows) > html_text.GROUP_CHARS
    large = text()
    assert not any("\n" in large[i] for i in range(100)) and all("\n" in large[i] for i in range(100, 1200)) and large[2000] == shared[0]
    monkeypatch.setattr(html_text, "GROUP_CHARS", 1 << 40)
    assert text() == large


@pytest.mark.parametrize("most", [html_text.GROUP_CHARS, 10])
def test_html_copies_keep_their_text(spark, monkeypatch, most):
    monkeypatch.setattr(html_text, "GROUP_CHARS", most)
    own = "this very page has these eleven words all of its own"
    rows = [(i, "http://h.com/", SHELL.format("x", f"<p>{own}</p>")) for i in range(5)] + [(10 + i, "http://h.com/", SHELL.format(i, "")) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {i: f"page x says something of its own\n{own}" for i in range(5)} | {10 + i: f"page {i} says something of its own" for i in range(3)}


def test_counts_beyond_four_bytes(spark, odd, monkeypatch):
    score = lambda: sorted((r["doc_id"] or -1, r["score"]) for r in ngram_lm.score(odd, ngram_lm.fit(ngram_lm.training_rows(odd))).collect())
    usual = score()
    monkeypatch.setattr(ngram_lm, "MANY", 2)
    assert score() == usual


def test_repeated_runs():
    rng = np.random.default_rng(2)
    pages = [np.r_[rng.integers(0, 50, 30), np.arange(100, 112), rng.integers(0, 50, 5)] for _ in range(4)]
    for p, cover in zip(pages, html_text.repeated(pages, 8, 3), strict=True):
        grams = Counter(g for q in pages for g in {tuple(q[i : i + 8]) for i in range(len(q) - 7)})
        want = np.zeros(len(p), bool)
        for i in range(len(p) - 7):
            if grams[tuple(p[i : i + 8])] >= 3:
                want[i : i + 8] = True
        assert (cover == want).all()


def test_long_labelled_texts_leave_the_others_in(spark):
    rows = [(i, f"text {i}") for i in range(100)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id bigint, toxic int")
    sample = lambda texts: subword.labelled(spark.createDataFrame(texts, "doc_id bigint, text string"), labels, "toxic", (100, 100), 4000)
    usual = sample(rows)[0]
    assert 60 < len(usual) < 100
    for long in (5000, 3900):  # never fits; fits, but not with the others
        for k in range(0, 100, 9):
            got = sample([(i, "x" * long if i == k else t) for i, t in rows])[0]
            assert set(got) == set(usual) - {f"text {k}".encode()}
    assert [len(t) for t in sample([(i, "x" * 3900) for i in range(5)])[0]] == [3900]


_FITTED = """
import re
import tracemalloc

import numpy as np

from factloom.llm import subword, toxicity

held = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) << 10
letters = np.random.default_rng(0).integers(97, 123, (300, 10000), dtype=np.uint8)
letters[:, ::8] = 32
texts = [x.tobytes() for x in letters]
subword.labelled = lambda *_: (list(texts), np.arange(300) % 2)
before = held()
toxicity.fit(None, None)
after = held()
tracemalloc.start()
toxicity.fit(None, None)
print((after - before) / letters.size, tracemalloc.get_traced_memory()[1] / letters.size)
"""


def test_a_fit_gives_the_drivers_memory_back():
    """Bytes a byte of text that stay in the process, and that the fit takes at once."""
    said = subprocess.run([sys.executable, "-c", _FITTED], capture_output=True, text=True, check=True, timeout=300, cwd=os.path.dirname(corpus_pipeline.__file__)).stdout
    stays, taken = map(float, said.split())
    assert stays < 15 and taken < 30, said


def test_packed_features():
    bucket, times = np.array([0, 5, 262143]), np.array([1, 7, 16383])
    for most, kind in ((16383, np.uint32), (16384, np.uint64)):  # the largest that fits beside 18 bits, and one more
        times[2] = most
        packed = subword._packed(bucket, times, 18)
        got, share = subword._shares(packed, 18, np.full(3, float(times.sum())))
        assert packed.dtype == kind and (got == bucket).all() and (share == (times / times.sum()).astype(np.float32)).all()


def test_subwords_generalise():
    rng = np.random.default_rng(0)
    common = ["the", "river", "house", "green", "walked", "slowly", "market", "music"]
    texts, y = [], []
    for i in range(400):
        w = list(rng.choice(common, 60))
        if i % 3 == 0:
            w[rng.integers(60)] = str(rng.choice(["pathetic", "worthless", "disgusting"]))
        texts.append(" ".join(w).encode())
        y.append(int(i % 3 == 0))
    model = subword.train(texts, np.array(y), toxicity.FEATURES, epochs=20, rate=5.0, batch=64, warm=4)
    cases = [b"the river walked slowly", b"a pathettic house by the river", b"so worthlesss", b""]
    s = model.scores(np.frombuffer(b"".join(cases), np.uint8), np.cumsum([0, *map(len, cases)]))
    assert s[0] < 0.5 < min(s[1], s[2]) and s[3] < 0.5


def test_classifiers(spark, odd, empty):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for module, run in ((toxicity, toxicity.score_toxicity), (quality, quality.score_quality)):
        model = module.fit(docs, labels)
        got = run(odd, model, keep=("lang", "score")).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got) and got[0]["lang"] == "en"
        assert run(empty, model).count() == 0
        assert run(odd, module.fit(docs, labels.limit(0))).count() == len(ODD)


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees = langid.fit(langid.training_rows(docs))
    held = docs.where("crc32(cast(doc_id as string)) % 4 = 2 and lang is not null")
    got = langid.identify(held, trees, keep=("lang",)).where("lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    by_id = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, trees).collect()}
    assert by_id[2] == by_id[3] == by_id[4] == "und" and by_id[5] != "und"
    assert langid.identify(empty, trees).count() == 0 and langid.fit(langid.training_rows(empty)) == {}
    tree = trees["en"]
    assert abs(sum(2 ** -tree.bits(b" th", b) for b in range(256)) - 1) < 1e-9


def brute_lm(train, texts):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    uni, bi = Counter(), Counter()
    for t in train:
        w = split(t)
        uni.update(w)
        bi.update(zip(["<s>", *w], w, strict=False))
    n, v = sum(uni.values()), len(uni)

    def discounts(c):
        k = [sum(x == i for x in c) for i in (1, 2, 3, 4)]
        if min(k[:3]) <= 0:
            return [0, 0.5, 1.0, 1.5]
        y = k[0] / (k[0] + 2 * k[1])
        return [0, *(min(i, max(0, i - (i + 1) * y * k[i] / k[i - 1])) for i in (1, 2, 3))]

    into = Counter(w for _, w in bi)
    d1, d2 = discounts(into.values()), discounts(bi.values())
    uniform = sum(d1[min(c, 3)] for c in into.values()) / sum(into.values())
    low = lambda w: max(into[w] - d1[min(into[w], 3)], 0) / sum(into.values()) + uniform / (v + 1)
    out = []
    for t in texts:
        w = split(t)
        s = base = 0.0
        for a, b in zip(["<s>", *w], w, strict=False):
            base += math.log10((uni[b] + 0.5) / (n + 0.5 * (v + 1)))
            total = len(train) if a == "<s>" else uni[a]
            p = low(b)
            if total:
                follow = {k: c for k, c in bi.items() if k[0] == a}
                p = max(bi[a, b] - d2[min(bi[a, b], 3)], 0) / total + sum(d2[min(c, 3)] for c in follow.values()) / total * low(b)
            s += math.log10(p)
        out.append((len(w), sum(uni[x] > 0 for x in w), n, base, s))
    return out


def test_language_model(spark, odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").where("n_chars < 700").limit(40).collect()] + ODD
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    train = [t for i, t in docs if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    got = ngram_lm.score(df.coalesce(1), ngram_lm.fit(ngram_lm.training_rows(df))).collect()
    for r, e in zip(got, brute_lm(train, [t for _, t in docs]), strict=True):
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == e[:3]
        assert abs(r["base_score"] - e[3]) < 1e-6 * (1 + abs(e[3])) and abs(r["score"] - e[4]) < 1e-6 * (1 + abs(e[4]))
    assert ngram_lm.score(empty, ngram_lm.fit(ngram_lm.training_rows(odd))).count() == 0
    assert all(r["score"] == 0 for r in ngram_lm.score(odd, ngram_lm.fit(empty.select(F.col("doc_id").alias("id"), "text"))).collect())


def test_mixing_is_a_bijection():
    x = np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64)
    assert (ngram_lm.unmix(ngram_lm.mix(x)) == x).all()
    assert (ngram_lm.unpacked(ngram_lm.packed(x), len(x)) == x).all()


def test_images(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(30)]
    vectors += [(100 + i, [x + float(e) for x, e in zip(vectors[i][1], rng.normal(0, 0.03, 64), strict=True)]) for i in range(10)]
    vectors += [(200, vectors[20][1]), (201, None), (202, []), (203, [1.0] * 64), (None, vectors[21][1])]
    pictures = images.rendered(spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>"))
    got = {r["vec_id"]: r["class_id"] for r in images.edited_copies(pictures).collect()}
    assert sum(got[100 + i] == i for i in range(10)) >= 9 and got[200] == 20 and got[201] == 201
    assert all(got[i] == i for i in range(30)) and images.edited_copies(pictures.limit(0)).count() == 0
    # a cropped, brightened copy
    whole = images.decode(pictures.first()["image"])
    crop = np.clip(whole[8:, 8:] * 0.9 + 12, 0, 255)
    assert images.inliers(*images.describe(whole), *images.describe(crop)) >= images.MIN_INLIERS
    assert images.decode(b"P5 2 2 255\n\x01\x02\x03\x04").tolist() == [[1, 2], [3, 4]] and images.decode(b"junk") is None


@pytest.mark.parametrize("side", [256, 1024])
def test_scaled_and_cropped_copies(side):
    rng = np.random.default_rng(side)
    grown = lambda n: images._resized(rng.uniform(-60, 60, (n, n)).astype(np.float32), side, side)
    first, other = (np.clip(127 + grown(side // 4) + grown(side // 8), 0, 255) for _ in range(2))
    half = first.reshape(side // 2, 2, side // 2, 2).mean((1, 3))
    quarter = half.reshape(side // 4, 2, side // 4, 2).mean((1, 3))
    at = side // 4 + 3
    crop = first[at : at + side // 2, at : at + side // 2]
    whole = images.describe(first)
    for copy in (half, quarter, crop):
        found = images.describe(np.rint(copy))
        assert images.inliers(*whole, *found) >= images.MIN_INLIERS and len(np.intersect1d(images.cells(whole[1]), images.cells(found[1])))
    assert images.inliers(*whole, *images.describe(other)) < images.MIN_INLIERS


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "toxicity", "near-duplicates", "decontamination", "packing"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, DIR)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    assert 0.6 * docs.count() < kept.count() < docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, DIR)
    assert packed.select("doc_id").distinct().count() == kept.count()


def test_packed_registers_agree_as_expected(spark):
    rng = np.random.default_rng(9)
    a = rng.integers(0, 2**32, (2, near_dup.LONG), np.uint32)
    b = a.copy()
    b[:, ::7] ^= 8  # one bit of every seventh register
    long = [near_dup.packed(x) for x in (a, b)]
    differ = sum(int(x >> k & 15) != int(y >> k & 15) for x, y in zip(*(v[0].view(np.uint64).tolist() for v in long), strict=True) for k in range(0, 64, 4))
    assert differ == len(range(0, near_dup.LONG, 7))
    rows = [(long[0][0].tolist(), long[1][0].tolist(), long[0][1].tolist())]
    df = spark.createDataFrame(rows, "x array<bigint>, y array<bigint>, z array<bigint>").selectExpr("*", "10 n", "9 m", "7 k")
    assert df.select(*(near_dup._agreeing_long(*c) for c in (("x", "y", "n", "m"), ("x", "z", "n", "m"), ("x", "y", "n", "k")))).first()[:] == (True, False, False)
