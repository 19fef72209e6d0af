"""Encoding and decoding of pieces against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from claimloom.llm import pieces as Q
from claimloom.llm.queries import op12_sentencepiece, tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "a", " a", "a ", "▁", "▁▁a", "▁ a b", "two  spaces\n\n\tand" + " " * 37 + "x", "</s><s><unk><0x0A>", "日本語テキスト😀👩‍👧", "\x00\x01é", "a" * 17, "   \n  a", " " * 300 + "b"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def noise(seed, alphabet, n, longest):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(longest))) for _ in range(n)]


TEXTS = ODD + noise(1, "abcdeéß 日本▁\n .,01<>😀ÄtheTHE", 400, 60) + noise(2, "   ▁\n\tab", 400, 80) + noise(3, "abcdefghijklmnopqrstuvwxyz", 100, 400)


@pytest.mark.parametrize("stretch, long", [(Q.STRETCH, Q.LONG), (50, 4096), (1 << 22, 3)])
def test_same_ids_and_texts_as_the_library(library, monkeypatch, stretch, long):
    monkeypatch.setattr(Q, "STRETCH", stretch)
    monkeypatch.setattr(Q, "LONG", long)
    p = Q.Pieces(PATH)
    ids, counts = p.encode(pa.array(TEXTS), end=True)
    want = [library.encode(t or "", add_eos=True) for t in TEXTS]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    assert p.decode(ids.astype(int), counts) == [library.decode(w) for w in want]


def test_decoding_of_any_ids(library):
    p, r = Q.pieces(PATH), random.Random(5)
    rows = [[r.choice((0, 1, 2, 3 + r.randrange(256), r.randrange(p.size))) for _ in range(r.randrange(12))] for _ in range(500)]

    assert p.decode(np.array([i for x in rows for i in x]), np.array([len(x) for x in rows])) == [library.decode(x) for x in rows]


def test_a_cache_that_is_emptied_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(Q, "CACHED", 10)
    p = Q.Pieces(PATH)
    for k in range(0, 200, 40):
        ids, _ = p.encode(pa.array(TEXTS[k : k + 40]))
        assert ids.tolist() == [i for t in TEXTS[k : k + 40] for i in library.encode(t or "")]


def test_long_words_cost_no_square(library):
    for text in (" " * 50_000 + "a", "a" * 50_000, noise(9, "abcdefghijklmnop", 1, 2)[0] + "ratherlong" * 5000):
        assert Q.pieces(PATH).encode(pa.array([text]))[0].tolist() == library.encode(text)


def test_query_over_a_table(spark, library, tmp_path):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS[:60])] + [(None, "no id", "x"), (3, "twice", "x"), (3, "twice", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    got = [tuple(r) for r in op12_sentencepiece(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert empty.select(Q.encode("text", PATH).alias("ids")).count() == 0
    assert spark.createDataFrame([(None,)], "ids array<int>").select(Q.decode("ids", PATH).alias("t")).first()["t"] is None
    assert [r["ids"] for r in spark.createDataFrame([("a b",)], "t string").select(Q.encode("t", PATH, end=False).alias("ids")).collect()] == [library.encode("a b")]


def test_a_model_of_another_kind_is_refused(tmp_path):
    (tmp_path / "m.model").write_bytes(b"\x0a\x03\x0a\x01a")
    with pytest.raises(ValueError, match="not a BPE model"):
        Q.Pieces(str(tmp_path / "m.model"))
