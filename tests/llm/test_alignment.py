"""Alignment of two tokenizers against the libraries and plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from claimloom.llm import alignment as L
from claimloom.llm.queries import op11_token_alignment, tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", "two  spaces \n\n\tand" + " " * 37 + "x ", "<|endoftext|></s>", "日本語テキスト😀👩‍👧 naïve café ", "a▁b is not a space", "▁", "x  y　 z é x", "a" * 90, "don't 'tis 1234567 x.y,z", "unbelievably internationalization " * 3]


def noise(seed, alphabet, n, longest):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(longest))) for _ in range(n)]


TEXTS += noise(1, "abcde ß日本 \n .,01😀theTHE ", 150, 60) + noise(2, "the of and ", 60, 200) + noise(4, "😀日~", 10, 40)


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    alphabet, token = L.byte_alphabet(), {i: t for t, i in tok.get_vocab(with_added_tokens=False).items()}
    def of_b(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()
    rows = []
    for t in texts:
        whole = (" " + t).encode() if t else b""
        a, b = (tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        sa, sb = [bytes(alphabet[c] for c in token[i]) for i in a], [of_b(i) for i in b]
        if b"".join(sa) != whole or b"".join(sb) != whole:
            a, b, sa, sb = [], [], [], []
        groups, i, j = [], 0, 0
        while i < len(a):
            ga, gb, na, nb = [a[i]], [b[j]], len(sa[i]), len(sb[j])
            i, j = i + 1, j + 1
            while na != nb:
                if na < nb:
                    ga.append(a[i]); na += len(sa[i]); i += 1
                else:
                    gb.append(b[j]); nb += len(sb[j]); j += 1
            groups.append((ga, gb))
        rows.append((len(a), len(b), groups))
    count = Counter(p for _, _, g in rows for p in {(x, y) for ga, gb in g for x in ga for y in gb})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for na, nb, groups in rows:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((na, nb, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), text))
    return out


@pytest.fixture(scope="module")
def want():
    return brute(TEXTS)


def test_groups_and_links(want, monkeypatch):
    for lane, listed in ((L.LANE, L.LISTED), (1, 1), (10**6, 4)):
        monkeypatch.setattr(L, "LANE", lane)
        monkeypatch.setattr(L, "LISTED", listed)
        found = L.Aligned(pa.array(TEXTS), A, B)
        got = list(zip(found.n_a.tolist(), found.n_b.tolist(), found.n_groups.tolist(), found.n_links.tolist(), found.strings().to_pylist()))
        assert got == [(*w[:4], w[6]) for w in want]
        of, pair, times = found.pairs()
        assert np.bincount(of, weights=times, minlength=len(TEXTS)).astype(int).tolist() == [w[3] for w in want]


def test_gallop_finds_what_is_there():
    r = np.random.default_rng(3)
    for n, m in ((1, 1), (5, 500), (300, 400), (64, 5000)):
        long = np.unique(r.integers(0, 4 * m, m))
        short = np.unique(np.r_[r.integers(0, 4 * m, n), long[-1:]])
        short = short[short <= long[-1]]
        begin = np.arange(0, len(short), 7)
        count = np.minimum(len(short) - begin, 7)
        zero = np.zeros(len(begin), np.int64)
        got = L.gallop(short, long, begin, count, zero, zero + len(long) - 1)
        at = np.searchsorted(long, short)
        assert got.tolist() == np.where(long[at] == short, at, -1).tolist()


def test_packing_of_pairs():
    for index, times in (([], []), ([0], [1]), ([3, 7, 2**40], [1, 300, 2**33])):
        x, y = L.unpacked(L.packed(np.array(index, np.int64), np.array(times, np.int64)), len(index))
        assert (x.tolist(), y.tolist()) == (index, times)


@pytest.mark.parametrize("block", [L.BLOCK, 200])
def test_query_over_a_table(spark, want, tmp_path, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    extra = [(None, "no id", "x"), (3, "a", "x"), (3, "a", "x")]
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + extra
    spark.createDataFrame(rows, "doc_id long, text string, block string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    expected = [(r[0], *w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "") for r, w in zip(rows, brute([r[1] for r in rows]))]
    out = op11_token_alignment(spark, str(tmp_path))
    got = [tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_operator_returns_groups_and_an_empty_table_is_empty(spark):
    docs = spark.createDataFrame([(1, "hello there"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.aligned(docs, A, B).collect()}
    assert got[1]["groups"] == brute(["hello there"])[0][6] and got[2]["groups"] == "" and got[2]["count_sum"] == 0
    assert L.aligned(docs.where("doc_id > 5"), A, B).count() == 0


def test_a_tokenizer_of_another_kind_is_refused():
    with pytest.raises(ValueError, match="not a byte-level"):
        L.ByteLevel(tokenizer_path("word_bpe_49k.json"))
