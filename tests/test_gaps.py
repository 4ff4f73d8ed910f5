"""Alignment with gaps: every alignment of short strings, whole tables against linear memory,
and every branch of the gates."""

import tracemalloc

import numpy as np
import pytest

from strandline.operators import align, align_long
from strandline.plans.registry import QUERIES

RNG = np.random.default_rng(21)
BASES = list("ACGT")


def word(n):
    return "".join(RNG.choice(BASES, n))


def changed(s, swaps, gaps):
    s = list(s)
    for _ in range(swaps):
        s[RNG.integers(len(s))] = BASES[RNG.integers(4)]
    for _ in range(gaps):
        k, n = RNG.integers(len(s)), RNG.integers(1, 30)
        if RNG.random() < 0.5:
            del s[k : k + n]
        else:
            s[k:k] = list(word(n))
    return "".join(s) or "A"


def all_alignments(a, b):
    """Every alignment as columns."""
    if not a and not b:
        yield ()
    if a and b:
        yield from (((a[0], b[0]), *rest) for rest in all_alignments(a[1:], b[1:]))
    if a:
        yield from (((a[0], "-"), *rest) for rest in all_alignments(a[1:], b))
    if b:
        yield from ((("-", b[0]), *rest) for rest in all_alignments(a, b[1:]))


def value(columns, score, opening, extending):
    total, last = 0.0, None
    for x, y in columns:
        kind = "b" if y == "-" else "a" if x == "-" else None
        total += score[ord(x), ord(y)] if kind is None else -(extending if kind == last else opening)
        last = kind
    return total


@pytest.mark.parametrize("score, opening, extending", [(align.nucleotide_scores(), 2.0, 0.5), (align.protein_scores({("A", "C"): 3, ("C", "A"): 3}), 2.5, 1.0)])
def test_against_every_alignment(score, opening, extending):
    for _ in range(40):
        a, b = word(RNG.integers(0, 6)), word(RNG.integers(0, 6))
        best = max(value(c, score, opening, extending) for c in all_alignments(a, b))
        x, y, total = align.align_many([(a, b)], score, opening, extending)[0]
        assert total == pytest.approx(best) and value(zip(x, y), score, opening, extending) == pytest.approx(best)
        if a and b:
            moves, total = align_long.align(*(align._stack([s], len(s), 0)[0] for s in (a, b)), score, opening, extending)
            assert total == pytest.approx(best) and align._gapped(a, b, moves) == (x, y)


def test_linear_memory_gives_the_table_alignment(monkeypatch):
    for t in range(150):
        a = word(RNG.integers(1, 160))
        b = changed(a, RNG.integers(0, 30), RNG.integers(0, 4)) if t % 3 else word(RNG.integers(1, 160))
        scores = (align.nucleotide_scores(), 2.0, 0.5) if t % 2 else (align.protein_scores(), 10.0, 0.5)
        monkeypatch.setattr(align, "LONG", 1 << 40)
        want = align.align_many([(a, b)], *scores)
        monkeypatch.setattr(align, "LONG", 0)
        monkeypatch.setattr(align_long, "TABLE", (8 << 20, 50)[t % 2])
        monkeypatch.setattr(align_long, "FIRST_BAND", (1, 4, 64)[t % 3])
        assert align.align_many([(a, b)], *scores) == want


def test_thirty_thousand_bases():
    a = word(30_000)
    b = changed(a, 60, 3)
    tracemalloc.start()
    x, y, total = align.align_many([(a, b)], align.nucleotide_scores(), 2.0, 0.5)[0]
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert x.replace("-", "") == a and y.replace("-", "") == b
    assert value(zip(x, y), align.nucleotide_scores(), 2.0, 0.5) == pytest.approx(total) and total > 29_800


def test_every_reason_and_second_blocks(spark):
    sf = "/root/testdata/sf0.001"
    reasons = {r["reason"] for r in QUERIES["gapped_prefix_gate"](spark, sf).collect()}
    assert reasons == {None, "no_alignment", "prefix_not_homologous", "indel_in_prefix", "stop_in_prefix_a", "stop_in_prefix_b"}
    rows = QUERIES["gapped_window_gate"](spark, sf).collect()
    assert {r["reason"] for r in rows} == {None, "no_alignment", "no_indel_free_window", "window_starts_too_late"}
    assert {r["start_h"] for r in rows} >= {None, 0, 5, 10}
    facts = QUERIES["gapped_block_facts"](spark, sf).collect()
    assert {r["n_blocks"] for r in facts} == {0, 3} and all(r["indel_frac"] > 0 for r in facts)


def test_codons_with_n():
    from strandline.operators.rewrites import GENETIC

    code = align.resolved(GENETIC)
    assert len(code) == 125 and code["GCN"] == "A" and code["NNN"] == code["TGN"] == "X" and code["ATG"] == "M" and code["CTN"] == "L"


def test_scores_of_made_sequences(spark):
    rows = [(1, "ATGGCNTAA", "ATGGCATAA"), (2, "ATGRCATAA", "ATGACATAA"), (3, "ATGTAAGCA", "ATGTAAGCATAA")]
    got = {r["key"]: r for r in align.generation_scores(spark.createDataFrame(rows, "key long, made string, target string"), "key", "made", "target").collect()}
    assert got[1]["aa_identity"] == 100 and got[2]["aa_identity"] < 100
    assert got[3]["premature_stop"] and got[3]["n_stops"] == 1 and got[3]["indel_events"] == 1


def test_nothing_to_place():
    assert align.coding_places("ACGT", "") is None and align.coding_places("AACGTT", "CG") == [2, 3]


def test_equal_protein_alignments_are_told_apart_by_bases():
    """Three pairs of proteins with two best alignments each; the planted gap shares more bases."""
    rows = [
        ("ATGGTGGACGCCGCTGCTGCTTGGAAATAGACTTCAAATAGGCGTCAAGGTCGGGCTAAACACGAACTAGAAGAATAA", "ATGGTGGCCGCCGCTGCTGCTAAATAGACTTCAAATAGGCGACAAGGTCGGGCTTGGAAACACGAACTAGAAGAATAA", "MVDAAAAWK*TSNRRQGRAKHELEE", "MVAAAAAK*TSNRRQGRAWKHELEE"),
        ("ATGTATCTGGTCCCCCAGTGCTGGTGGGCTTGGTGGTGGTGGTGGTGGTGGTGGTGGTGGTGGTGGTGGTGGTGGAAACTAGGAGTTTTGTGCTACGGGGCTGGAGCAGGAAAGGGTAGACCCGTTGTTTGAACCTATGCTAAACGCTACCTGTGCAATCATGTCGTCCTCCATCGCTATTCACACTACTAA", "ATGTATCAGGTCCCCCAGTGGTGGTGGGCTAAACTAGGAGTTTTGTGCTACGGGGCTGGAGCAGGAAAGGGTAGACCCGTTGTTTGAACCTATGCTTGGTGGAAACGCTACCTGTGCAATCATGTCGTCCTCCATCGCTATTCACACTACTAA", "MYLVPQCWWAWWWWWWWWWWWWWWWKLGVLCYGAGAGKGRPVV*TYAKRYLCNHVVLHRYSHY", "MYQVPQWWWAKLGVLCYGAGAGKGRPVV*TYAWWKRYLCNHVVLHRYSHY"),
        ("ATGCCGGAGGCGGCCGCTGCTTGGAAATCATCACGCGCCCAGGGACGGGCCCATGCTAAANNNGGAGAAGCAACATAA", "ATGCCGGCGGCGGCCGCTGCTAAATCATGACGCGCCCAGGGCCGGGCCCATGCTTGGAAANNNGGAGAAGCAACATAA", "MPEAAAAWKSSRAQGRAHAKXGEAT", "MPAAAAAKS*RAQGRAHAWKXGEAT"),
    ]
    want = ["0-7:0-7 8-19:7-18 19-25:19-25", "0-10:0-10 25-47:10-32 47-63:34-50", "0-7:0-7 8-19:7-18 19-25:19-25"]
    for some in (rows, *[[r] for r in rows]):
        found = align.codon_alignments(some, align.protein_scores())
        assert [" ".join(f"{h}-{i}:{t}-{u}" for h, i, t, u in align.blocks_of(p, q)) for p, q, _ in found] == [want[rows.index(r)] for r in some]
    odd = [("", "", "", ""), ("ATGnnnG", "ATG", "MX", "M"), ("ATGAA", "", "M", "")]
    assert [x[:2] for x in align.codon_alignments(odd, align.protein_scores())] == [("", ""), ("MX", "M-"), ("M", "-")]
    assert align.codon_alignments([], align.protein_scores()) == []
