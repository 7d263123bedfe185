"""The alignment of two tokenizers against a plain re-computation on whole texts."""

import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest

from phmspark.llm import alignment

SF = "/root/testdata/sf0.001"
TEXTS = [
    "Hello world, hello again.", "a  b\n\n c\t d", " leading", "trailing ", " ", "\n", "naïve café Ærø", "日本語のテキスト と word", "don't stop <|endoftext|> now</s> <s>", "bar▁foo plain", "▁", "aaaa" * 2000,
    "x" * 50 + " " * 40 + "y", "tab\tand\x00null \x1c sep", "emoji 👩‍👩‍👧 ok", "q w nbsp", "ﬁ Å é", "0" * 300 + " 1234567 3.14", "the quick brown fox " * 300, None, "",
]


TEXTS_THERE = [t for t in TEXTS if t]


def paths():
    import public_tokenizers as own

    return own.path("byte_bpe_50k.json"), own.path("piece_bpe_32k.model")


def plain(texts):
    """Whole texts, one at a time, pairs one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = paths()
    a_model, b_model = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a_model.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}

    def b_bytes(piece):
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

    rows, holds = [], Counter()
    for text in texts:
        found = []
        if text:
            a = a_model.encode(" " + text, add_special_tokens=False).ids
            b = b_model.encode(text)
            left = [bytes(byte[c] for c in a_model.id_to_token(k)) for k in a]
            right = [b_bytes(b_model.id_to_piece(k)) for k in b]
            if b"".join(left) == b"".join(right) == (" " + text).encode():
                ea, eb = list(accumulate(map(len, left))), list(accumulate(map(len, right)))
                i = j = 0
                for end in sorted(set(ea) & set(eb)):
                    p, q = ea.index(end, i) + 1, eb.index(end, j) + 1
                    found.append((a[i:p], b[j:q]))
                    i, j = p, q
        links = Counter((x, y) for p, q in found for x in p for y in q)
        holds.update(links.keys())
        rows.append((found, links))
    most = defaultdict(int)
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    out = []
    for found, links in rows:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in found)
        out.append((sum(len(p) for p, _ in found), sum(len(q) for _, q in found), len(found), sum(links.values()), sum(n for (x, y), n in links.items() if holds[x, y] == most[x]), sum(n * holds[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if found else ""))
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("top_pairs", [1_000_000, 200, 0])
def test_equals_whole_texts(spark, top_pairs):
    texts = TEXTS + ["the quick brown fox"] * 5 + [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    df = spark.createDataFrame([(None if k == 3 else k // 2, t, "own", 7) for k, t in enumerate(texts)], "doc_id long, text string, codes string, n_a int").repartition(3)
    got = alignment.align(df, *paths(), top_pairs=top_pairs)
    rows = [(r["doc_id"], *(r[c] for c in NAMES)) for r in got.collect()]
    want = [(None if k == 3 else k // 2, *w) for k, w in enumerate(plain(texts))]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert any(w[1] == 0 for w, t in zip(want, texts) if t)  # bytes that do not come back


def test_groups_and_empty_table(spark):
    df = spark.createDataFrame([("x", "Hello world")], "name string, body string")
    row = alignment.aligned(df, *paths(), id_col="name", text_col="body", with_groups=True).first()
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"] and row["groups"].count(";") == row["n_groups"] - 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, *paths()).count() == 0


def test_links_of_long_groups_are_multiplied(monkeypatch):
    assert alignment.link_codes([1, 1, 2], [5, 5], 10) == {15: 4, 25: 2}
    a, b = alignment.common_ends(np.array([1, 3, 4]), np.array([3, 4]))
    assert a.tolist() == [2, 3] and b.tolist() == [1, 2]
    aligner = alignment.Aligner(*paths())
    one = aligner.of(TEXTS_THERE)
    monkeypatch.setattr(alignment, "LONG_GROUP", 0)
    two = aligner.of(TEXTS_THERE)
    assert (one.codes == two.codes).all() and (one.times == two.times).all() and (one.at == two.at).all()


def test_words_are_as_whole_texts():
    aligner, whole = alignment.Aligner(*paths(), max_words=10), alignment.Aligner(*paths())
    assert aligner.by_word
    whole.by_word = False
    for texts in (TEXTS_THERE, TEXTS_THERE[::-1], TEXTS_THERE[:3]):
        x, y = aligner.of(texts), whole.of(texts)
        assert x.groups == y.groups and (x.sums == y.sums).all() and (x.codes == y.codes).all() and (x.times == y.times).all()
    assert aligner.by_word and [bool(g) for g in x.groups] == [True] * 3
