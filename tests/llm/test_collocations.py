import re
from collections import Counter

import numpy as np

from strandline.llm import collocations as C

from .conftest import ODD


def naive(rows, least=30, cover=80, top=2000, most=4):
    """(lang, rank, phrase, a, l, r, n, score) by dictionaries; rows: (lang, text)."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(ws)
            own = f.setdefault(lang, Counter())
            for k in range(1, most + 1):
                own.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in found.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if p[i:j] != p and 100 * a >= cover * found.get(p[i:j], 1 << 99):
                        gone.add(p[i:j])
        rest = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                rest.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rest)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", i, 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, batch long, n int")


def got(df):
    return sorted(map(tuple, df.collect()))


def test_against_dictionaries(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text").collect()]
    rows = [(lang, t[:4000]) for lang, t in rows] + [(None, t[:2000]) for _, t in rows[:40]]
    before = len(spark.catalog.listTables())
    for options in ({"least": 5}, {"least": 3, "cover": 50, "top": 40, "shard_keys": 500}):
        want = naive(rows, **{k: v for k, v in options.items() if k != "shard_keys"})
        assert len(want) > 100 and got(C.collocations(frame(spark, rows), **options)) == want
    assert len(spark.catalog.listTables()) == before


def test_odd_texts(spark):
    odd = [t for _, t in ODD] + ["a. b", "x\ty z", "A B, a b; a\x0bb", "word"]
    rows = [(lang, t) for t in odd for lang in ("en", None, "en\x00\n", "")] * 2
    for least in (1, 2):
        assert got(C.collocations(frame(spark, rows), least=least)) == naive(rows, least)
    assert C.collocations(frame(spark, [])).collect() == []
    assert C.collocations(frame(spark, [("en", None), (None, "")])).collect() == []


def test_repeats_overlap_and_ties(spark):
    rows = [("en", "ha " * 50), ("en", "b c " * 40), ("en", "c b. " * 7)]
    assert got(C.collocations(frame(spark, rows))) == naive(rows)


def test_batches_and_long_phrases(spark):
    size, C.BATCH_BYTES = C.BATCH_BYTES, 300
    try:
        rng = np.random.default_rng(4)
        rows = [("en", " ".join(f"w{x}" for x in rng.zipf(1.5, 60) % 50)) for _ in range(60)]
        assert got(C.collocations(frame(spark, rows), least=4, most_words=6, shard_keys=100)) == naive(rows, 4, most=6)
    finally:
        C.BATCH_BYTES = size


def test_candidates_verify_stored_keys():
    rng = np.random.default_rng(6)
    left, right = rng.integers(0, 1 << 60, 5000), rng.integers(0, 40, 5000)
    known = C.Candidates(left, right)
    assert sorted(known.slots(left, right)) == list(range(5000))
    assert (known.slots(left, right + 100) == -1).all()
    arrays = [rng.integers(0, 9, 11) for _ in range(13)]
    assert (C.tree_sum(iter(arrays), 11) == np.sum(arrays, axis=0)).all() and (C.tree_sum(iter([]), 3) == 0).all()


def test_scores_pass_64_bits(spark):
    big = 6_000_000_000_000
    phrases = spark.createDataFrame([("en", b"a b", 2, 1, 0, 0, big, [big + 1], [big])], "lang string, phrase binary, words int, id long, left long, right long, a long, firsts array<bigint>, rests array<bigint>")
    row = C.ranked(phrases, spark.createDataFrame([("en", big * 3)], "lang string, n long"), 80, 10).collect()
    assert [tuple(r) for r in row] == [("en", 1, "a b", big, big + 1, big, 3 * big, 2_000_000 * big // (2 * big + 1))]
