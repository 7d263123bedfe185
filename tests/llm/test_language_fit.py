"""What fitting many languages takes, and how well few are told apart."""

import random
import tracemalloc
import zlib

import numpy as np

from phmspark.llm import language

SF = "/root/testdata/sf0.01"


def test_twenty_languages_stay_under_a_gigabyte():
    rng = random.Random(1)
    alphabets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyzäöüéèñç", 14)) for _ in range(20)]
    texts, langs = [], []
    for k, letters in enumerate(alphabets):
        words = ["".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(4000)]
        texts += [" ".join(rng.choices(words, k=400)) for _ in range(300)]
        langs += [f"l{k:02}"] * 300
    tracemalloc.start()
    model = language.fit(texts, langs, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000_000 and len(model.languages) == 20
    assert np.isfinite(model.weights).all() and np.isfinite(model.transitions).all()


def test_gradient_of_transitions_in_closed_form():
    """Sums over pairs of places equal those over pairs x languages x languages."""
    rng = np.random.default_rng(2)
    trans, potentials, lengths = rng.normal(size=(3, 3)), rng.normal(size=(5, language.WINDOW, 3)), np.array([48, 2, 1, 30, 7])
    _, forward, ahead = language.chains(potentials, lengths, trans)
    seq = np.repeat(np.arange(5), lengths)
    place = np.concatenate([np.arange(x) for x in lengths])
    here = np.flatnonzero(place[1:] > 0)
    before, after = forward[seq[here], place[here]], ahead[seq[here + 1], place[here + 1]]
    joint = before[:, :, None] * np.exp(trans)[None] * after[:, None, :]
    want = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    z = ((before @ np.exp(trans)) * after).sum(axis=1)
    assert np.allclose(np.exp(trans) * ((before / z[:, None]).T @ after), want)


def test_held_out_accuracy_has_a_floor(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in language.op3_language(spark, SF).collect() if r["held_out"] and truth[r["doc_id"]] is not None]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    assert len(got) > 100 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) / len(got) >= 0.98
