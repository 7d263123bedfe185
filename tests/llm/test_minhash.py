"""Near duplicates by signatures against all pairs of sets."""

import random
import re

import numpy as np
import pytest

from phmspark.llm import minhash
from phmspark.llm.ngram_join import NO_ID, _Search

SF = "/root/testdata/sf0.001"


def plain(rows, num=85, den=100):
    """rows of (id, text): id, size, component by comparing all sets."""
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    distinct = sorted({s for s in sets if s}, key=lambda s: (len(s), sorted(s)))
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if len(b) * num > len(a) * den:
                break
            if den * len(a & b) >= num * len(a | b):
                parent[root(a)] = root(b)
    least: dict = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[root(s)] = min(i, least.get(root(s), i))
    return sorted(((i, len(s), least.get(root(s)) if s else i) for (i, _), s in zip(rows, sets)), key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def made(seed):
    """Groups of copies of many grades, a passage that many texts share, odd rows."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, shared = [], [word() for _ in range(60)]
    for _ in range(25):
        base = [word() for _ in range(rng.choice((8, 12, 30, 80, 200, 400)))]
        for _ in range(rng.choice((1, 3, 9))):
            rows.append(" ".join(edited(rng, base, rng.randrange(0, max(2, len(base) // 25)))))
    rows += [" ".join(shared + [word() for _ in range(rng.randrange(1, 40))]) for _ in range(60)]
    base = [word() for _ in range(150)]
    rows += [" ".join(edited(rng, base, 4)) for _ in range(120)]  # similar to the base, hardly to one another
    rows += ["", None, " \t\n", "One", "one", "a b c d", "A B c d", "a b c d e f g h i j", "a b c d e f g h i j k", "ﬁ É é"]
    rows += rows[:20]
    return [(None if k % 41 == 5 else k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame([(i, t, "own", 1) for i, t in rows], "doc_id long, text string, component_id string, size int").repartition(5)
    got = minhash.near_duplicates(df)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr) == plain(rows)


def test_crowded_lists_meet_in_chunks(spark, monkeypatch):
    """Without leads, in small chunks: crowded lists alone find every link."""
    rows = [r for r in made(3) if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in (("FEW", 1), ("CHUNK_SETS", 8), ("PURE", 4)):
        monkeypatch.setattr(minhash, name, value)
    monkeypatch.setattr(_Search, "look", lambda self, pairs: None)
    got = minhash.near_duplicates(df)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr) == plain(rows)


def test_signatures_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    found = []
    for _ in range(300):
        x = rng.integers(0, 2**64, 200, dtype=np.uint64)
        a, b = np.sort(x[:185]), np.sort(x[15:])  # 170 of 200
        signed = minhash.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        found.append(int((signed[0] == signed[1]).sum()))
        short = minhash.bytes_of(signed)
        assert ((short[0] == short[1]) >= (signed[0] == signed[1])).all()
    assert abs(np.mean(found) / 64 - 0.85) < 0.01 and min(found) >= minhash.LEAST_MATCHES + 6 and 2 < np.std(found) < 4


def test_kept_ones_and_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert minhash.op12_minhash(spark, str(tmp_path)).count() == 0
    got = minhash.op12_minhash(spark, SF).collect()
    assert {r["component_id"] for r in got} == {r["doc_id"] for r in got if r["kept"]}
    assert NO_ID > max(r["doc_id"] for r in got)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == plain(docs)
