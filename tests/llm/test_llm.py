"""Corpus operators against brute force, on small tables with nulls, ties, copies and clashing columns."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from phmspark.llm import batches, components, decontamination, html_text, language, ngram_join, packing, quality, queries, token_counts, topk_search, toxicity, warc
from phmspark.llm.common import fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "der die das und nicht the of and with that le la les des que el los una por con".split()


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "xx", "s", None) for i, t in zip(ids, texts)], DOCS)


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("aeiou") * rng.randint(0, 3) for _ in range(n))


ODD = [None, "", " \n\t ", "123 !!", "x", "Ünï çödé 漢字", "a " * 30_000, "same text here", "same text here"]


# 1: search


def brute_topk(rows, k=5, step=50):
    v = {i: [math.floor(256 * x) for x in e] for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = {}
    for q in v:
        if q % step == 0:
            scored = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q and len(v[c]) == len(v[q]))[:k]
            out |= {(q, r + 1): (c, -s) for r, (s, c) in enumerate(scored)}
    return out


@pytest.mark.parametrize("kind", ["random", "ties", "skewed"])
def test_topk_equals_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(330, 6))
    x = np.round(x) if kind == "ties" else x * np.exp(2 * rng.normal(size=(330, 1))) if kind == "skewed" else x
    rows = [(k, r.tolist()) for k, r in enumerate(x)] + [(1000, None), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1100, [math.nan] * 6), (1150, [math.inf] + [0.0] * 5), (1200, [0.0] * 6), (1250, [1e6] * 6)]
    df = spark.createDataFrame([(i, e, 7) for i, e in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = topk_search.top_k(df, F.col("_id") % 50 == 0, bucket_rows=40, query_rows=3).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == brute_topk(rows)


def test_topk_of_few_and_none(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(empty, F.col("_id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk_search.top_k(two, F.col("_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]


# 2: html


def test_main_text_of_pages():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header><a href=/>Home</a> Site</header><nav><ul><li><a href=/a>Menu</a></ul></nav>
    <div class="ad">Buy</div><div id="cookie-notice">Cookies</div><main><article><h1>Title &amp; more</h1><p><b>First  line<br>goes on.<p>Second&nbsp;&lt;tag&gt; <i>it</i>alic and a
    <a href=x>link</a> in a long enough sentence.</p><!-- no --><form>Name <input></form><ul><li>One<li>Two</ul></article><section class="comments"><p>Reader says a long thing here, very long indeed.</p></section></main>
    <aside>Side words</aside><footer>&copy; site</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more\nFirst line goes on.\nSecond <tag> italic and a link in a long enough sentence.\nOne\nTwo"
    assert [html_text.main_text(x) for x in (None, "", "<nav>menu</nav>", "<script>x</script>", "just text", "<p>a<p>b")] == ["", "", "", "", "just text", "a\nb"]
    deep = "<div>" * 5000 + "<p>deep words</p>"
    assert html_text.main_text(deep) == "deep words"


def test_extract_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None, "u", 3), (2, "<p>x</p>", None, 4), (2, "<p>x</p>", None, 4)], "page_id long, html string, url string, main_text int")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "html", "url", "main_text"] and sorted(r["main_text"] for r in got.collect()) == ["", "x", "x"]


# 3: language


def test_chain_equals_enumeration():
    rng = np.random.default_rng(0)
    pot, trans, lengths = rng.normal(size=(3, 5, 3)), rng.normal(size=(3, 3)), np.array([5, 3, 1])
    marginal, _, _ = language.chains(pot, lengths, trans)
    for s, n in enumerate(lengths):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = math.exp(sum(pot[s, k, path[k]] for k in range(n)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            for k in range(n):
                want[k, path[k]] += w
        assert marginal[s, :n] == pytest.approx(want / want.sum(axis=1, keepdims=True))


def test_language_learns_and_defines_odd_texts(spark):
    rng = random.Random(0)
    word = {"p": lambda: "".join(rng.choice(["ba", "bo", "bu"]) for _ in range(3)), "q": lambda: "".join(rng.choice(["zi", "ze", "xa"]) for _ in range(3))}
    made = [(k, " ".join(word["pq"[k % 2]]() for _ in range(40)), "pq"[k % 2]) for k in range(60)]
    df = spark.createDataFrame(made + [(900, None, "p"), (901, "", None), (902, "12 !", "q"), (903, "baba zizi " * 2000, None)], "doc_id long, text string, lang string")
    model = language.fit_tables(df)
    got = {r["doc_id"]: r for r in language.label_texts(df, model).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang in made)
    assert [(got[k]["lang_pred"], got[k]["lang_score"]) for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert 0 <= got[903]["lang_score"] <= 1 and got[903]["lang_pred"] in "pq"
    nothing = language.fit_tables(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language.label_texts(df, nothing).collect()} == {"und"}
    assert language.label_texts(df.limit(0), model).count() == 0


# 4: toxicity


def brute_segments(x):
    """Maximal-scoring subsequences by their definition: take the best (shortest, then first), go on at both sides."""
    best = max(((sum(x[a:b]), -(b - a), -a, a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=None)
    if best is None or best[0] <= 1e-12:
        return []
    a, b = best[3], best[4]
    return brute_segments(x[:a]) + [(a, b)] + [(p + b, q + b) for p, q in brute_segments(x[b:])]


def test_segments_equal_their_definition():
    rng = random.Random(5)
    for _ in range(300):
        x = [rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() / 100 for _ in range(rng.randint(0, 12))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(np.array(x, dtype=float))] == brute_segments(x)


def test_toxicity_finds_planted_words(spark):
    rng = random.Random(1)
    bad = ["vile", "scummy", "vermin"]
    texts, toxic = [], []
    for k in range(260):
        ws = text_of(rng, 60).split()
        if k % 4 == 0:
            for _ in range(3):
                ws.insert(rng.randrange(len(ws)), rng.choice(bad))
        texts.append(" ".join(ws))
        toxic.append(int(k % 4 == 0))
    n = len(texts)
    docs = docs_of(spark, texts + ODD)
    labels = spark.createDataFrame([(k, 1, t) for k, t in enumerate(toxic)] + [(None, 0, 1), (5, None, None), (n, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_tables(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_texts(docs, model).withColumn("held", fold(F.col("doc_id"), 3) == 1).collect()}
    held = [k for k in range(n) if got[k]["held"]]
    assert np.mean([(got[k]["tox_score"] >= 0.7) == bool(toxic[k]) for k in held]) >= 0.95
    hit = next(k for k in held if toxic[k] and got[k]["tox_passages"])
    assert any(b in texts[hit][p["start"] : p["end"]] for p in got[hit]["tox_passages"] for b in bad)
    assert all(0 <= got[k]["tox_score"] < 0.7 and got[k]["tox_passages"] == [] for k in range(n, n + len(ODD)))
    bare = toxicity.fit_tables(docs, labels.limit(0))
    assert {r["tox_score"] < 0.7 for r in toxicity.score_texts(docs.limit(3), bare).collect()} == {True}


# 5: join


def brute_components(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        ws = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))]
        sets.append(frozenset(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else frozenset())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, len(s), least.get(root(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("seed", [0, 1])
def test_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    passage = text_of(rng, 30)
    texts = []
    for size in (1, 3, 5, 6, 8, 9, 11, 14, 18, 25, 40, 60, 90, 140):
        base = text_of(rng, size)
        for _ in range(7):  # a chain of copies of copies, and copies of the base
            ws = rng.choice([base, texts[-1] if texts else base]).split()
            for _ in range(rng.randint(0, max(1, size // 12))):
                at = rng.randrange(len(ws) + 1)
                ws[at : at + rng.randint(0, 1)] = [rng.choice(WORDS)] * rng.randint(0, 1)
            texts.append(" ".join(ws))
    texts += [passage + " " + text_of(rng, rng.randint(3, 20)) for _ in range(30)] + ODD + [ODD[5].upper()]
    rows = list(zip(rng.sample(range(1000), len(texts)), texts)) + [(None, texts[3]), (None, "nobody else has this"), (7000, texts[9])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("own")).repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(df).collect()), key=str)
    assert got == sorted(brute_components(rows), key=str)


@pytest.mark.parametrize("choice", [0, 1, 2])
def test_index_shares_more_keys_than_are_spared_wherever_sets_link(choice):
    rng = np.random.default_rng(4)
    lay = ngram_join.Bands(8, 10, dict.fromkeys(range(20), choice))
    met = 0
    for size in [4, 5, 6, 7, 8, 9, 10, 12, 20, 33, 52, 80, 130, 400, 900] * 40:
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        swaps = max(0, int(size * rng.uniform(0, 0.24)))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[: len(a) - swaps // 2]], rng.integers(0, 2**64, int((swaps - swaps // 2) * rng.random()), dtype=np.uint64)]))
        k = len(np.intersect1d(a, b))
        if a.tolist() == b.tolist() or 10 * k < 8 * (len(a) + len(b) - k):
            continue
        met += 1
        found = [{(x, spare) for band in lay.of(len(s)) for x, spare in zip(*(v.tolist() for v in lay.keys(lay.layout(band), s, np.array([0, len(s)]))[::2]))} for s in (a, b)]
        both = [spare for _, spare in found[0] & found[1]]
        assert 0 in both or len(both) > max(both, default=0), (size, swaps)
    assert met > 200


def test_layout_does_not_change_components(spark, monkeypatch):
    rng = random.Random(8)
    texts = []
    for size in (5, 8, 12, 20, 40, 90):
        base = text_of(rng, size)
        for _ in range(12):
            ws = base.split()
            for _ in range(rng.randint(0, 1 + size // 20)):
                ws[rng.randrange(len(ws))] = rng.choice(WORDS)
            texts.append(" ".join(ws))
    rows = list(enumerate(texts))
    want = sorted(brute_components(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_join, "FEW", 3)  # most keys are crowded
    for choice in (0, 1, 2):
        monkeypatch.setattr(ngram_join, "chosen", lambda *_: dict.fromkeys(range(20), choice))
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(df).collect()) == want


def test_shared_passage_in_many_texts(spark):
    rng = random.Random(9)
    passage = text_of(rng, 60)
    texts = [f"{passage} {text_of(rng, 8 + k % 40)}" for k in range(1000)]
    texts += [t + " again" for t in texts[:20]]
    rows = list(enumerate(texts))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == sorted(brute_components(rows))


def test_one_id_with_different_texts(spark):
    rng = random.Random(10)
    a, b = text_of(rng, 40), text_of(rng, 40)
    got = ngram_join.components(spark.createDataFrame([(1, a), (1, b), (5, a + " tail"), (3, b + " tail"), (None, a + " end")], "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == [(1, 1), (1, 1), (3, 1), (5, 1), (None, 1)]


def test_long_text_is_split_like_a_short_one(monkeypatch):
    words = ["w%d" % (k % 37) for k in range(500)] + ["x%d" % k for k in range(40)]
    text = "  \n".join(words).encode()
    whole, at = ngram_join.Shingles(5)([text, b"a b", None])
    monkeypatch.setattr(ngram_join, "_PIECE", 50)
    cut, at2 = ngram_join.Shingles(5)([text, b"a b", None])
    assert whole.tolist() == cut.tolist() and at.tolist() == at2.tolist()


def test_components_of_long_chains(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 400), (400, 450)], "a long, b long").repartition(5)
    got = {r["node"]: r["component"] for r in components.connect(chain).collect()}
    assert got == {k: 0 for k in range(201)} | {400: 400, 450: 400, 500: 400}
    assert components.connect(chain.limit(0)).count() == 0


def test_join_of_nothing(spark):
    assert ngram_join.components(docs_of(spark, [])).count() == 0
    assert {(r["n_shingles"], r["component_id"]) for r in ngram_join.components(docs_of(spark, [None, "", "  "])).collect()} == {(0, 0), (0, 1), (0, 2)}


# 6: quality


def test_quality_tells_noise_from_prose(spark):
    rng = random.Random(2)
    good = [text_of(rng, 60).capitalize() + "." for _ in range(120)]
    bad = [" ".join(w.upper() + rng.choice(["!!", "###", "$$$"]) for w in text_of(rng, 60).split()) for _ in range(120)]
    docs = docs_of(spark, good + bad + ODD).withColumn("quality_score", F.lit("own"))
    labels = spark.createDataFrame([(k, int(k < 120), 0) for k in range(240)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model, base = quality.fit_tables(docs, labels)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score_texts(docs, model, base).collect()}
    assert len(got) == 240 + len(ODD) and all(0 <= x <= 1 for x in got.values())
    assert np.mean([got[k] for k in range(120)]) > 0.9 and np.mean([got[k] for k in range(120, 240)]) < 0.1
    none, base = quality.fit_tables(docs, labels.limit(0))
    assert none is None and {r["quality_score"] for r in quality.score_texts(docs, none, base).collect()} == {0.5}


def test_vote_equals_plain_sums():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(30, 4)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    y = (rng.random(30) > 0.5).astype(float)
    m = quality.Model(np.ones(1), np.ones((1, 1)), v, y, 1.0, 5, 3.0)
    q = rng.normal(size=(9, 4)).astype(np.float32)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    for s, row in zip(m.vote(q, block=4), q):
        near = np.argsort(-(v @ row))[:5]
        w = np.maximum(v[near] @ row, 0) ** 3
        assert s == pytest.approx(((w * y[near]).sum() + 0.01) / (w.sum() + 0.02), rel=1e-4)


# 7: token counts


def test_token_counts_and_cache(spark, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    plain = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ODD + ["<s> special </s>", "two  spaces\n\nlines"]
    docs = docs_of(spark, texts, [None, *range(1, len(texts))]).withColumn("digest", F.lit(1))
    cache = f"file://{tmp_path}/cache"
    for turn in range(2):  # the second time everything is in the cache
        got = token_counts.count_tokens(docs, path, cache).collect()
        assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == sorted((len((t or "").encode()), len(plain.encode(t or ""))) for t in texts)
        assert spark.read.parquet(cache).count() == len({t or "" for t in texts})
    more = docs_of(spark, ["only this is new", "x"])
    token_counts.count_tokens(more, path, cache).collect()
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts}) + 1
    other = token_counts.count_tokens(more, public_tokenizers.path("byte_bpe_50k.json"), cache).collect()
    assert len(other) == 2 and spark.read.parquet(cache).count() == len({t or "" for t in texts}) + 3


# 8: decontamination


def brute_hits(text, items, n=13):
    ws = [w for w in decontamination.words(text)]
    hit, found = set(), set()
    for i, t in items:
        iw = decontamination.words(t)
        for w in decontamination.windows(iw, n):
            for at in range(len(ws) - len(w) + 1):
                if tuple(ws[at : at + len(w)]) == w:
                    hit.update(range(at, at + len(w)))
                    found.add(str(i))
    return len(ws), len(hit), sorted(found)


@pytest.mark.parametrize("most", [10**9, 300])
def test_decontamination_equals_brute_force(spark, most):
    rng = random.Random(9)
    items = [(k, text_of(rng, rng.choice([2, 12, 13, 14, 30]))) for k in range(14)] + [(20, None), (21, ""), (22, "!!"), (None, "x"), (23, "Ünï-çödé 漢字")]
    items[3] = (3, items[2][1])
    texts = [text_of(rng, 40) + ". " + rng.choice(items[:14])[1].upper().replace(" ", " -- ") + "! " + text_of(rng, rng.randint(0, 20)) for _ in range(25)] + ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, texts).withColumn("n_hit", F.lit("own"))
    got = {r["doc_id"]: r for r in decontamination.decontaminate(docs, bench, max_items_chars=most).collect()}
    known = [x for x in items if x[0] is not None]
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["items"]) == brute_hits(t, known) and r["n_items"] == len(r["items"])
        inside = {p for s in r["spans"] for p in range(s["start"], s["end"])}
        if r["n_hit"] and most > 300:
            assert sum(len(decontamination.words(t[s["start"] : s["end"]])) for s in r["spans"]) == r["n_hit"] and inside
    assert decontamination.decontaminate(docs.limit(0), bench).count() == 0
    assert {r["n_items"] for r in decontamination.decontaminate(docs.limit(2), bench.limit(0)).collect()} == {0}


# 9: packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(4)
    texts = ODD + [text_of(rng, rng.randint(1, 300)) for _ in range(60)] + ["a  b <|endoftext|> c", "word " * 5000]
    docs = docs_of(spark, texts, [None, *range(1, len(texts))]).repartition(3)
    packed = packing.pack(docs, path, capacity=128, with_ids=True)
    rows = packed.collect()
    want = {}
    for k, t in enumerate(texts):
        want[k or None] = plain.encode(t or "", add_special_tokens=False).ids + [0]
    for doc, ids in want.items():
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert [i for r in own for i in r["ids"]] == ids and [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1])
        assert all(r["length"] == 128 for r in own[1:]) and all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in own)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == list(np.cumsum([0] + [n for _, n in s])[:-1]) and sum(n for _, n in s) <= 128
    assert len(by) <= -(-sum(map(len, want.values())) // 128) + 2
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(spark.createDataFrame(rows, packed.schema)).collect()}
    assert sum(map(len, whole.values())) == sum(map(len, want.values()))
    assert packing.pack(docs.limit(0), path).count() == 0


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, fast = Tokenizer.from_file(path), packing.WordIds(path, max_words=50)
    rng = random.Random(8)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "ß", "<|endoftext|>", "1", "'s", "!", "日本", "\x1c", "Ġ", " x", " "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(800)]
    for k in range(0, 800, 100):
        for t, ids in zip(texts[k : k + 100], fast.of(texts[k : k + 100])):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("counts", [{}, {5: 1}, {7: 100}, {3: 10, 4: 10, 5: 10, 10: 3}, {1: 1000}, {6: 9, 9: 4, 2: 1}])
def test_plan_places_every_piece_once(counts):
    n = np.zeros(11, dtype=np.int64)
    for k, v in counts.items():
        n[k] = v
    plan = packing.Plan(n, 10)
    used = np.zeros(11, dtype=np.int64)
    for lengths, times in plan.runs:
        assert sum(lengths) <= 10 and times > 0
        for x in lengths:
            used[x] += times
    assert (used == n).all()


# 10: WARC


def test_warc_files_round_trip_and_audit(spark, tmp_path):
    pages = [(k, f"http://x/{k}", f"<p>page {k} é\r\n\r\nWARC/1.0</p>") for k in range(3000, 3100)] + [(5000, None, None), (None, "u", ""), (5000, None, None)]
    rows = warc.records(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("start", F.lit("own")))
    path = str(tmp_path / "warc")
    warc.write_warc(rows, path)
    back = warc.read_warc(spark, path).collect()
    assert sorted(((r["uri"] or ""), bytes(r["payload"]).decode()) for r in back) == sorted(((u or ""), h or "") for _, u, h in pages)
    keep = rows.collect()
    a = spark.createDataFrame(keep, rows.schema)
    assert warc.audit(a, a).count() == 0
    hurt = [r for r in keep if r["page_id"] != 3050]  # one record gone: its place is missing
    hurt = [r if r["page_id"] != 3007 else type(r)(**(r.asDict() | {"record": r["record"].replace("page", "gape")})) for r in hurt]
    found = warc.audit(a, spark.createDataFrame(hurt, rows.schema)).collect()
    ordinal = {r["page_id"]: (r["segment"], r["ordinal"]) for r in keep}
    assert {((r["segment"], r["ordinal"]), r["status"]) for r in found} == {(ordinal[3050], "missing"), (ordinal[3007], "changed")}
    digest = next(r for r in found if r["status"] == "changed")["digest"]
    assert digest == hashlib.sha256(next(r for r in keep if r["page_id"] == 3007)["record"].encode()).hexdigest()
    assert warc.audit(a, a.limit(0)).count() == len(pages) and warc.audit(a.limit(0), a.limit(0)).count() == 0


# Shared


def test_batches_are_cut_by_rows_and_bytes():
    assert batches.cuts(np.array([1, 1, 1])) == [0, 3]
    assert batches.cuts(np.array([5_000_000, 1, 5_000_000])) == [0, 1, 2, 3]
    assert batches.cuts(np.array([0] * 1001)) == [0, 1000, 1001]


def test_every_operator_has_its_query():
    assert [f"op{k}" for k in range(1, 14)] == sorted((n.split("_")[0] for n in queries.QUERIES), key=lambda x: int(x[2:]))
