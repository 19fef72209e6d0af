"""The pipeline's stages and run() against brute force on a small folder of tables."""

import random
import re
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from claimloom.llm import packing  # noqa: E402
from claimloom.llm.queries import tokenizer_path  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"aa": "ba ke lo ni".split(), "bb": "tsch üß ung ein".split()}
STAGE = dict(corpus_pipeline.STAGES)


def prose(lang, seed, n=60):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(5)) for _ in range(n))


BENCH = [prose("aa", 900, 30), None, "", prose("bb", 901, 8)]
SECRET = "password = Zz9abcdefgHij77"


def rows():
    texts = [(prose(lang, k), lang) for k in range(30) for lang in ("aa", "bb")]
    texts += [(None, "aa"), ("", "bb"), ("12 !? 34", "aa"), ("   ", None)]  # 60 to 63: without a language
    copy = texts[4][0].split()
    texts += [(texts[4][0], "aa"), (" ".join([*copy[:-1], "other"]), "aa"), (texts[5][0], "bb")]  # 64 to 66: near copies of 4 and 5
    texts += [("kelo " + BENCH[0] + " bani", "aa"), (BENCH[3], "bb"), (prose("aa", 50, 800) + " " + BENCH[3], "aa")]  # 67, 68: contaminated; 69: a little of it
    texts += [(prose("aa", 60) + " " + SECRET + " " + prose("aa", 61, 5), "aa")]  # 70
    texts += [(prose("bb", 70, 9000), "bb")]  # 71: long
    out = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(texts)]
    return [*out, out[8], (None, prose("aa", 80), "aa", "s", 0), (None, None, None, None, None)]  # a repeated row, rows without an id


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(BENCH)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def texts_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    table = [(i, t) for i, t, *_ in rows()]

    table = sorted([(i, t) for i, t in table if t and re.search("[a-zß-ü]", t)], key=str)
    docs = STAGE["language"](spark, docs, folder)
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and texts_of(docs) == table

    def alike(a, b):
        a, b = shingles(a), shingles(b)
        return 100 * len(a & b) >= 80 * len(a | b)

    table = [(i, t) for i, t in table if i is None or not any(j is not None and j < i and alike(t, u) for j, u in table)]
    docs = STAGE["near_dedup"](spark, docs, folder)
    assert texts_of(docs) == table and not {64, 65, 66} & {i for i, _ in table}

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for item in BENCH:
        w = word.findall((item or "").lower())
        windows |= {tuple(w[k : k + min(13, len(w))]) for k in range(max(1, len(w) - 12)) if w}

    def contaminated(text):
        w, hit = word.findall(text.lower()), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        return bool(hit) and 20 * len(hit) >= len(w)

    table = [(i, t) for i, t in table if not contaminated(t)]
    docs = STAGE["decontaminate"](spark, docs, folder)
    assert texts_of(docs) == table and {67, 68} & {i for i, _ in table} == set() and 69 in {i for i, _ in table}

    table = [(i, t.replace(SECRET, "[secret]")) for i, t in table]
    docs = STAGE["secrets"](spark, docs, folder)
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and texts_of(docs) == table
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())


def test_run_packs_what_the_stages_keep(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    kept = texts_of(docs)
    tokenizer = packing.Encoder(tokenizer_path()).tokenizer
    pieces, sequences = {}, {}
    for r in corpus_pipeline.run(spark, folder).collect():
        raw = bytes(r["ids"])
        assert zlib.crc32(raw) == r["ids_crc32"] and len(raw) == 4 * r["length"]
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], raw))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = {}
    for i, t in kept:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want.setdefault((i, len(ids)), []).append(np.array(ids, "<u4").tobytes())
    assert set(pieces) == set(want)
    for key, bodies in want.items():  # a repeated row's pieces are there as often as it is
        assert sorted(pieces[key]) and b"".join(p for _, p in sorted(pieces[key])) == bodies[0] * len(bodies) or len(bodies) > 1 and sum(len(p) for _, p in pieces[key]) == sum(map(len, bodies))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0


def test_stages_take_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder) if docs.columns[0] == "doc_id" else docs
        assert docs.count() == 0
