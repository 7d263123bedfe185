"""The divergence audit against a plain re-computation."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from phmspark.llm import divergence

COLUMNS = "doc_id long, text string, lang string, source string, value string, s int, term string"


def plain(rows, least=3, top=200):
    """rows of (text, lang, source), None as ''."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, tf = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        docs[lang].update(set(words))
        tf[lang, source].update(words)
    out = []
    for lang in {r[1] for r in rows}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted({r[2] for r in rows if r[1] == lang}, key=str.encode)

        def p(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        each = {s: p(tf[lang, s]) for s in sources}
        whole = p(sum((tf[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((each[s][t] - each[o][t]) ** 2 // each[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((each[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if tf[lang, s][t] > 0 and each[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def test_odd_rows_and_many_sources(spark):
    rng = random.Random(5)
    words = ["Alpha", "beta", "GAMMA", "été", "Éte", "x1y", "日本", "don't", "_low", "a\x00b"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for k in range(300):
        text = " ".join(rng.choices(words, k=rng.randrange(30)))
        rows.append((text, rng.choice(["en", "fr", None]), rng.choice(["a", "B", "é", None, "src1", "src10"])))
    rows += [(None, "en", "empty"), ("", "en", "empty"), ("12 34", "de", "none"), ("one two", "de", "x"), (None, None, None), ("word " * 50_000, "en", "a")]
    rows += [(" ".join(rng.choices(words[:20], k=8)), "many", f"s{k:03}") for k in range(70)] + [(None, "many", "s100")]  # two tiles of columns
    rows += rows[:40]
    df = spark.createDataFrame([(None if k % 9 == 0 else k, t, lang, s, "own", 1, "own") for k, (t, lang, s) in enumerate(rows)], COLUMNS).repartition(5)
    got = divergence.divergence(df)
    assert [f.simpleString() for f in got.schema] == ["lang:string", "source:string", "part:string", "item:string", "value:bigint", "rank:int"]
    assert sorted(map(tuple, got.collect())) == plain(rows)
    few = divergence.divergence(df, least_docs=5, top_terms=4)
    assert sorted(map(tuple, few.collect())) == plain(rows, 5, 4)


def test_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], COLUMNS)).count() == 0


def test_columns_are_runs(spark):
    """Terms of equal counts stand together: many terms, few runs; and the runs give the counts back."""
    rows = [(f"only{chr(97 + k % 26)}{chr(97 + k // 26)}", "en", f"s{k % 4}") for k in range(200) for _ in range(3)]
    terms, groups = divergence.vocabulary(divergence.term_counts(spark.createDataFrame([(k, *r, "", 0, "") for k, r in enumerate(rows)], COLUMNS)))
    found = divergence.columns(terms).collect()
    assert terms.count() == 200 and all(len(r["ends"]) // 8 <= 3 for r in found)
    assert sum(int(np.diff(np.frombuffer(r["ends"], "<i8"), prepend=0) @ np.frombuffer(r["counts"], "<i8")) for r in found) == 600
    assert groups.agg(F.sum("total")).first()[0] == 600


def test_counts_beyond_nine_billion_stay_exact():
    big = np.array([0, 10**10, 10**13])
    assert divergence.probabilities(big, 10**14, 7).tolist() == [1 + 10**9 * (int(n) + 1) // (10**14 + 7) for n in big]
    a = (np.array([3, 10]), np.array([5, 900]))
    b = (np.array([4, 10]), np.array([7, 2]))
    dense = lambda c: np.repeat(c[1], np.diff(c[0], prepend=0))
    p, q = dense(a), dense(b)
    assert divergence.intersected(a, b) == (int(((p - q) ** 2 // q).sum()), int(((p - q) ** 2 // p).sum()))
