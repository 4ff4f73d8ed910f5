import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from strandline.llm import sentencepiece_scan as P, token_files as T, wordpiece_counts as W
from strandline.llm.text import shared_dir

from .conftest import ODD

WORDS = str(public_tokenizers.path("word_bpe_49k.json"))
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))


def test_ranks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1001):
        r = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        c, d = T.encode_ranks(r)
        assert (T.decode_ranks(np.frombuffer(c, np.uint8), np.frombuffer(d + b"\n", np.uint8), n) == r).all()


def test_files_hold_what_the_library_encodes(spark, make, sample):
    rows = sample + [(50_000 + k, t) for k, (_, t) in enumerate(ODD)]
    rows = rows[::-1]
    folder = shared_dir(spark)
    T.write(make(rows), folder, WORDS, tokens_a_file=5_000)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in T.summary(spark, folder).collect()}
    tk, at = Tokenizer.from_file(WORDS), 0
    for i, t in sorted(rows):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, T.END_ID], "<u4").tobytes()
        assert got[i] == (at, len(ids) // 4, zlib.crc32(ids)), i
        at += len(ids) // 4
    order = [r["doc_id"] for r in T.read(spark, folder).orderBy("file", "at").select("doc_id").collect()]
    assert order == sorted(i for i, _ in rows)


def test_odd_files(make, odd):
    rows = T.round_trip(odd, WORDS).collect()
    assert len(rows) == len(ODD)
    spans = sorted((r["start"], r["start"] + r["n_tokens"]) for r in rows)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert {r["doc_id"] for r in rows if r["start"] < spans[2][0]} == {None}
    assert T.round_trip(make([]), WORDS).collect() == []


def test_plain_texts_are_cut_by_the_pattern():
    import regex

    find, rng = regex.compile(T.PATTERN).findall, random.Random(6)
    some = " \t\n\v\r" * 3 + "aZ09.,-_«²½ªµ×÷éÿßſŁĳșƒ"
    texts = ["".join(rng.choices(some, k=rng.randint(0, 60))).lower() for _ in range(300)]
    cut, counts = T.cut_plain([t.encode() for t in texts], T._kinds())
    assert [find(t) for t in texts] == [cut.slice(e - n, n).to_pylist() for e, n in zip(np.cumsum(counts), counts)]
    assert T.cut_plain([], T._kinds())[0].to_pylist() == []


def test_cached_ids_are_the_library_s():
    """Capitals whose small letters lie far away were cut as if they were signs."""
    tk, rng, cache = Tokenizer.from_file(WORDS), random.Random(7), T.WordCache(WORDS, "<u2", limit=40)
    some = ["aȺb", "xƁy", "Ⱦ", "don't", "'S", "naïve", "x²y", "ab,cd", "...", "<|", "日本", "İ", "ﬁ", "Zoë", "12", "\n", "\u00a0", "", "word"]
    texts = [" ".join(rng.choices(some, k=rng.randint(0, 8))) for _ in range(200)] + some
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        got = cache.encode([t.encode() for t in part], b"\x02\x00").to_pylist()
        assert got == [np.array([*tk.encode(t, add_special_tokens=False).ids, 2], "<u2").tobytes() for t in part]


def greedy(word, first, rest):
    n = at = 0
    while at < len(word):
        end = next((e for e in range(min(len(word), at + 64), at, -1) if word[at:e] in (rest if at else first)), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


def test_automaton_counts_longest_matches():
    rng = random.Random(1)
    draw = lambda: {bytes(rng.choices(b"abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 8))}
    for _ in range(400):
        f, r = draw(), draw()
        for first, rest in ((f, f), (f, r)):
            a = W.Automaton(first, rest)
            for _ in range(10):
                w = bytes(rng.choices(b"abc", k=rng.randint(0, 9)))
                assert a.count(w) == greedy(w, first, rest), (first, rest, w)


def test_counts_of_texts(make, odd):
    pieces = W.pieces_of(WORDS)
    got = W.count_tokens(odd, pieces).select("doc_id", "tokens.*").collect()
    by = {r["doc_id"]: tuple(r)[1:] for r in got}
    assert by[1] == by[2] == by[3] == (0, 0, 0) and by[5][0] == 5 and len(got) == len(ODD)
    assert by[9] == (1, greedy(b"x" * 50_000, pieces, pieces), 0)
    unknown = W.count_tokens(make([(1, "ab cd")]), {b"a", b"b"}).select("tokens.*").first()
    assert tuple(unknown) == (2, 3, 1)
    assert W.count_tokens(make([]), pieces).count() == 0


def viterbi(m, s):
    """Best segmentation by the plain recurrence, longest last piece of equals."""
    best, start = [P.LOW] * (len(s) + 1), [0] * (len(s) + 1)
    best[0] = 0
    for e in range(1, len(s) + 1):
        for a in range(max(0, e - m.longest), e):
            x = m.score.get(s[a:e], m.unknown_score if e == a + 1 else None)
            if x is not None and best[a] + x > best[e]:
                best[e], start[e] = best[a] + x, a
    out, e = [], len(s)
    while e:
        out.append(s[start[e] : e])
        e = start[e]
    return m.ids_of(out[::-1])


def test_chunks_and_plain_recurrence_agree(make, sample):
    m, rng = P.Model(PIECES), random.Random(4)
    rows = [(i, t[:400]) for i, t in sample[:40]] + [(1000 + k, "".join(rng.choices(c, k=rng.randint(40, 300)))) for k, c in enumerate(["ab", "the", ["tion", "er", " ", "日", "é"], "x  ", ["tion", "ing", "the", "a"]] * 6)]
    for chunk in (40, 97, 100_000):
        got = {r["doc_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in P.encode(make(rows), PIECES, chunk=chunk).collect()}
        assert got == {i: viterbi(m, m.normal(t)) for i, t in rows}


def test_ordinary_segments_go_in_lockstep(sample):
    """One pass of the recurrence for each distinct segment took most of the time."""
    m = P.Model(PIECES)

    def alone(s):
        raise AssertionError(f"decoded by itself: {s!r}")

    m._segment = alone
    for _, t in sample[:20]:
        assert np.frombuffer(m.encode(t[:300]), "<u2").tolist() == viterbi(m, m.normal(t[:300]))


def test_lockstep_is_the_plain_recurrence(monkeypatch):
    m, rng = P.Model(PIECES), random.Random(8)
    some = ["", " ", "\n", "\n\n a", "▁", "x" * 700, "日本語のテキスト、" * 20, "\U0001f600 ab \U0001f600", "a\u0300b", "\x00 \x01", "ab" * 40 + " c"]
    some += ["".join(rng.choices("ab \n▁日\U0001f600é.,xth", k=rng.randint(0, 150))) for _ in range(100)]
    want = [viterbi(m, m.normal(t)) for t in some]
    for kept in (P.CACHED_SEGMENTS, 5):
        monkeypatch.setattr(P, "CACHED_SEGMENTS", kept)
        for at in (0, 40, 80, 0):
            assert [np.frombuffer(x, "<u2").tolist() for x in m.encode_many(some[at : at + 60]).to_pylist()] == want[at : at + 60]
    m.cuts_at_space = False
    m.split = lambda s: [s] if s else []
    assert [np.frombuffer(x, "<u2").tolist() for x in m.encode_many(some).to_pylist()] == want


def test_pieces_decode_to_the_text(make, odd):
    for chunk in (1000, P.CHUNK):
        back = P.decode(P.encode(odd, PIECES, chunk=chunk), PIECES).select("doc_id", "text").collect()
        texts = sorted((r[0] or 0, r[1]) for r in back)
        assert texts == sorted((i or 0, (t or "").replace("▁", " ")) for i, t in ODD)
    assert P.encode(make([]), PIECES).collect() == []


def test_scan_is_associative():
    rng = np.random.default_rng(5)
    m = np.where(rng.random((9, 4, 4)) < 0.3, P.LOW, rng.integers(-100, 0, (9, 4, 4)))
    out, now = P.prefix_scan(m), m[0]
    for k in range(1, 9):
        now = P.combine(now, m[k])
        assert (out[k] == now).all()
    assert (P.combine(P.combine(m[0], m[1]), m[2]) == P.combine(m[0], P.combine(m[1], m[2]))).all()
