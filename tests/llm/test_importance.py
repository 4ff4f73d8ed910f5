import hashlib
import math
import re
import zlib
from collections import Counter

from strandline.llm import importance as I

from .conftest import ODD


def naive(rows, target, width=1, buckets=10_000, percent=10, least=20):
    """(doc_id, n_features, weight, score, rank) by plain loops."""

    def words(text):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)

    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, width + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets))))
    out = []
    for i, text in rows:
        f = features(text)
        weight, score = sum(map(gain, f)), None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(words(text))])
    fit = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for place, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = place
    return sorted(map(repr, (tuple(r[:5]) for r in out)))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_against_loops(make, sample):
    rows = [(i, t[:3000]) for i, t in sample]
    target = make([(i, t) for i, t in sample[:30]])
    for width, percent in ((1, 10), (2, 25)):
        want = naive(rows, [t for _, t in sample[:30]], width, percent=percent)
        assert got(I.resample(make(rows), target, width=width, percent=percent)) == want


def test_odd_rows(make, odd):
    target = [(1, "word é 日本語"), (2, None)]
    want = naive(ODD, [t for _, t in target], percent=50, least=1)
    assert got(I.resample(odd, make(target), percent=50, least_words=1)) == want
    assert got(I.resample(odd, make([]), width=3, percent=50, least_words=1)) == naive(ODD, [], 3, percent=50, least=1)
    assert I.resample(make([]), make(target)).collect() == []


def test_equal_rows_share_their_draws(make):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(7, text)] * 3 + [(i, text) for i in range(20, 37)]
    assert got(I.resample(make(rows), make([(1, "w1 w2")]), percent=30)) == naive(rows, ["w1 w2"], percent=30)
