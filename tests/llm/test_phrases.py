"""Phrases against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from claimloom.llm import phrases as P

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def corpus():
    r = random.Random(4)
    words = ["Of", "en", "de", "the", "new", "york", "times", "a", "é", "x\x01", "x", "日本", "and"]
    out = [None, "", " . ,", "one", "a\tb\x0bc", "never.Twice!"]
    for k in range(120):
        t = []
        for _ in range(r.randrange(40)):
            t += r.choice([["new", "york", "times"], ["New", "York"], ["of", "the"], ["x", "x", "x"], [r.choice(words)], [f"rare{r.randrange(900)}"], [","], [".", "\n"]])
        out.append(" ".join(t))
    return [(i, t, r.choice(["en", "en", "de", None])) for i, t in enumerate(out)]


def brute(rows, least, top, covered=80):
    f, total = Counter(), Counter()
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", low):
            w = re.findall("[^\\x20\\x09]+", piece)
            total[lang or "und"] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang or "und", tuple(w[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = defaultdict(int)
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longer[lang, w[i : i + m]] = max(longer[lang, w[i : i + m]], a)
    rows = defaultdict(list)
    for (lang, w), a in found.items():
        if 100 * longer[lang, w] >= covered * a:
            continue
        score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        rows[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, total[lang], -s) for lang, x in rows.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash") for r in corpus()], "doc_id long, text string, lang string, word string").repartition(3).cache()


@pytest.mark.parametrize("options", [{}, {"budget": 40}, {"budget": 4}, {"dictionary": 4}, {"dictionary": 0, "budget": 10}])
@pytest.mark.parametrize("least, top", [(5, 2000), (2, 7)])
def test_against_plain_counts(docs, options, least, top):
    want = brute(corpus(), least, top)
    got = sorted(tuple(r) for r in P.mine(docs, top=top, least=least, **options).select(*COLUMNS).collect())
    assert len(want) > 10 and got == want


def test_blocks_and_long_words_change_nothing(docs, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 100)
    monkeypatch.setattr(P, "LONGEST", 3)
    got = sorted(tuple(r) for r in P.mine(docs, least=5).select(*COLUMNS).collect())
    assert got == brute(corpus(), 5, 2000)


def test_empty_table_and_no_candidates(spark, docs):
    assert P.mine(docs.where("doc_id < 0")).count() == 0
    assert P.mine(docs.where("doc_id < 6")).count() == 0
    assert P.mine(docs).columns == COLUMNS


def test_repeated_rows_and_a_long_text(spark):
    text = "red green. " * 20000 + "blue " * 40
    rows = [(None, text, "en"), (None, text, "en")]
    got = sorted(tuple(r) for r in P.mine(spark.createDataFrame(rows, "doc_id long, text string, lang string")).select(*COLUMNS).collect())
    assert got == brute(rows, 30, 2000)


def test_products_past_64_bits_are_exact(spark):
    big = 6 * 10**18 + 1
    nodes = spark.createDataFrame([(1, 2, 0, 0, big)], P.NODES)
    words = spark.createDataFrame([(1, "en", "x", big), (2, "en", "y", big + 2)], "code long, lang string, word string, n long")
    row = P.candidates(P.Counted(nodes, words, None, None)).first()
    assert row["score"] == 2000000 * big // (2 * big + 2)


def test_parts():
    raw = np.array([[1, 2, P.BEYOND + 5], [3, 0, 4], [0, 0, 0], [0, 0, 0], [7, 1, 2**40]])
    for width in (2, 3):
        rows = raw[:, :width]
        assert P.unpacked(P.packed(list(rows[:4]), rows[4]), width).tolist() == rows.tolist()
    columns, n = P.unique_rows([np.array([2, 1, 2, 1]), np.array([P.BEYOND, 0, P.BEYOND, 1])], np.array([1, 2, 3, 4]))
    assert [c.tolist() for c in columns] == [[1, 1, 2], [0, 1, P.BEYOND]] and n.tolist() == [2, 4, 4]
    got = P.suffixes(np.array([1, 2, 0, 3, 4, 5]), np.array([True, False, False, False, False, True]))
    assert np.stack(got, axis=1).tolist() == [[1, 2, 0, 0], [2, 0, 0, 0], [0, 0, 0, 0], [3, 4, 0, 0], [4, 0, 0, 0], [5, 0, 0, 0]]
    partition = P.Partition(np.array([[9, 1, 1, 0], [5, 2, 4, 1], [1, 9, 2, 2]]), 4)
    assert partition.depth == sorted(partition.depth) and partition.depth[-1] == P.DEPTH
