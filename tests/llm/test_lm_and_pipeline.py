import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from strandline.llm import suffix_tree_lm as M, text as X

from .conftest import ODD
from .test_filters import naive_lines
from .test_neardup import similar_classes
from .test_tokens import PIECES


def naive_scores(rows, depth=M.DEPTH, gain=M.GAIN):
    """By dictionaries: (held_out, tokens, known, N, base, score) of each row."""
    docs = [(i, [*(t or "").encode().lower().split(), "end"]) for i, t in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c, after = Counter(), defaultdict(Counter)
    for i, w in docs:
        if not out(i):
            c.update(w)
            for k in range(1, depth + 1):
                for j in range(k, len(w)):
                    after[tuple(w[j - k : j])][w[j]] += 1
    n, v = sum(c.values()), len(c)
    base = lambda x: (c[x] + 1) / (n + v + 1)
    root = lambda x: (c[x] or v) / (n + v)

    def close(s, x):
        """The suffix's distribution as the test takes it: all contexts seen twice."""
        if not s:
            return root(x)
        size, q = sum(after[s].values()), close(s[1:], x)
        return (max(after[s][x] - 1, 0) + q) / size if size >= 2 else q

    def diverges(s):
        size, again = sum(after[s].values()), [(x, k) for x, k in after[s].items() if k >= 2]
        total = sum(k * round(math.log((k - 1 + close(s[1:], x)) / close(s[1:], x)) * M.NATS) for x, k in again)
        return bool(again) and total / M.NATS - size * math.log(size) >= gain

    kept = {s for s in list(after) if diverges(s)}

    def p(w, j):
        q = root(w[j])
        for k in range(1, min(depth, j) + 1):
            s = tuple(w[j - k : j])
            if s in kept:
                q = (max(after[s][w[j]] - 1, 0) + len(after[s]) * q) / sum(after[s].values())
        return q

    return [(i, out(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(base(x)) for x in w), sum(math.log10(p(w, j)) for j in range(len(w)))) for i, w in docs]


@pytest.mark.parametrize("batch", (1 << 14, 8 << 20))
def test_scores(make, sample, monkeypatch, batch):
    monkeypatch.setattr(M, "BATCH_BYTES", batch)
    rows = [*sample, *((60_000 + k, t) for k, (_, t) in enumerate(ODD))]
    got = {r["doc_id"]: tuple(r) for r in M.score(make(rows)).collect()}
    want = naive_scores(rows)
    for w in want:
        assert got[w[0]][:5] == w[:5]
        assert got[w[0]][5:] == pytest.approx(w[5:], rel=1e-9)
    held = [got[w[0]] for w in want if w[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_contexts_of_repeated_texts(make):
    text = [f"w{i % 40} x{i % 40} y{i % 40} z{i % 40}" for i in range(160)]
    more = [f"{t} v{i % 77}" for i, t in enumerate(text)]
    for rows in (list(enumerate(text)), list(enumerate(text + more))):
        for got, want in zip(sorted(M.score(make(rows)).collect()), naive_scores(rows)):
            assert got["score"] == pytest.approx(want[-1], rel=1e-9)
    # every word of the corpus, and one never seen, behind the same two
    words = sorted({w for t in text for w in t.split()}) + ["unseen"]
    held = [i for i in range(10_000, 30_000) if zlib.crc32(str(i).encode()) % 7 == 2][: len(words) + 1]
    rows = [*enumerate(text), *((i, f"w3 x3 {w}") for i, w in zip(held, words)), (held[-1], "w3 x3")]
    scores = {r["doc_id"]: r["score"] for r in M.score(make(rows)).collect()}
    naive = {w[0]: w[-1] for w in naive_scores(rows)}
    assert all(scores[i] == pytest.approx(naive[i], rel=1e-9) for i in held)


@pytest.mark.parametrize("depth", (1, 2, 5))
def test_depths(make, sample, depth):
    got = {r["doc_id"]: r["score"] for r in M.score(make(sample[:60]), depth=depth).collect()}
    for w in naive_scores(sample[:60], depth):
        assert got[w[0]] == pytest.approx(w[-1], rel=1e-9)


def test_packing():
    for x in ([], [5], [0, 0, 1], [1 << 40, 3]):
        assert M.unpacked(M.packed(np.array(x, "<i8")), "<i8").tolist() == x
    keys = np.array([3, 1 << 50, (1 << 64) - 1], np.uint64)
    assert M.unpacked_keys(M.packed_keys(keys)).tolist() == keys.tolist()


def test_scores_of_odd_rows(make, odd):
    rows = M.score(odd).collect()
    assert len(rows) == len(ODD) and all(r["score"] <= 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert M.score(make([])).collect() == []
    from pyspark.sql import functions as F

    none = M.score(odd, held=F.lit(True)).collect()
    assert {r["train_tokens"] for r in none} == {0} and {r["base_score"] for r in none} == {0.0} == {r["score"] for r in none}


def test_stages_keep_columns(spark, odd, make):
    for docs in (odd, make([])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert sorted(out.columns) == sorted(docs.columns), name
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_pipeline(spark):
    """Each stage against brute force on what the stage before kept."""
    from strandline.llm import quality as Q
    from strandline.llm.sentencepiece_scan import Model

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = X.stored(stage(spark, docs, sf_dir))
        kept.append(docs.collect())
    before = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    bits = {r["doc_id"]: r["fail_bits"] for r in Q.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert {r["doc_id"] for r in kept[0]} == {r["doc_id"] for r in before if not bits[r["doc_id"]]}
    want = {i: t for i, _, _, t in naive_lines([(r["doc_id"], r["text"]) for r in kept[0]])}
    assert {r["doc_id"]: r["text"] for r in kept[1]} == want and all(r["n_chars"] == len(r["text"]) for r in kept[1])
    label = similar_classes([(r["doc_id"], r["text"]) for r in kept[1]])
    assert {r["doc_id"] for r in kept[2]} == set(label)
    items = [r["text"].lower().split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    holds = lambda t: any(" ".join(b) in " ".join(t.lower().split()) for b in items)
    assert {r["doc_id"] for r in kept[3]} == {r["doc_id"] for r in kept[2] if not holds(r["text"])}
    model = Model(PIECES)
    assert {r["doc_id"]: model.decode(np.frombuffer(r["ids"], "<u2")) for r in kept[4]} == {r["doc_id"]: r["text"] for r in kept[3]}
    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, kept[4]))
