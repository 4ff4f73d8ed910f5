"""Global alignment with affine gaps, and what is read off alignments.

Many pairs go through one NumPy pass: pairs of like length are stacked, padded with letters
that match nothing, and a row of the dynamic programme is one array step over the stack
(the best gap along a row is a running maximum of scores lifted by their place). Each cell
keeps a byte that says where its three states came from. Of equal alignments the one that
prefers a substitution, then a gap in b, from the end is taken; other tools may choose
another of the same score.

Codons choose by their bases first (codon_alignments).

Long pairs go through align_long.py, a few rows at a time, with the same choice.

Defined cases: a pair with a null has a null result; an empty sequence aligns to gaps.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import align_long

#: Cells of stacked tables worked on together, a byte each; pairs with more cells than LONG
#: go alone, in linear memory.
CELLS, LONG = 1 << 24, 1 << 21
_LOW = -1e18
_LETTERS = 128


def nucleotide_scores() -> np.ndarray:
    """Match 1, mismatch 0."""
    return np.eye(_LETTERS)


def protein_scores(matrix: dict[tuple[str, str], float] | None = None) -> np.ndarray:
    """A substitution matrix given as a parameter; without one a match scores 5 and a
    mismatch -1."""
    out = np.where(np.eye(_LETTERS) > 0, 5.0, -1.0)
    for (x, y), s in (matrix or {}).items():
        out[ord(x), ord(y)] = s
    return out


def read_matrix(path: str) -> dict[tuple[str, str], float]:
    """A substitution matrix in the usual text form: a line of letters, then lines of a
    letter and its scores; # starts a comment."""
    with open(path, encoding="utf-8") as f:
        rows = [x.split() for x in f if x.strip() and not x.startswith("#")]
    return {(r[0], c): float(v) for r in rows[1:] for c, v in zip(rows[0], r[1:])}


def _numbers(seq: str) -> np.ndarray:
    return np.frombuffer(seq.encode("ascii", "replace"), np.uint8) % _LETTERS


def _stack(seqs: list, width: int, pad: int) -> np.ndarray:
    out = np.full((len(seqs), width), pad, np.intp)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = _numbers(s) if isinstance(s, str) else s
    return out


def _tables(a: np.ndarray, b: np.ndarray, ends: np.ndarray, score: np.ndarray, opening: float, extending: float) -> tuple[np.ndarray, np.ndarray]:
    """(where each cell's states came from, the scores of the three states at each pair's
    own ends).

    Bits of a cell: 1-2 the state before a substitution, 3-4 before a gap in b, 5-6 before a
    gap in a; 0 substitution, 1 gap in b, 2 gap in a."""
    k, n, m = len(a), a.shape[1], b.shape[1]
    came = np.zeros((n + 1, k, m + 1), np.uint8)
    place = np.arange(m + 1)
    h = np.full((k, m + 1), _LOW)
    h[:, 0] = 0
    e = np.full((k, m + 1), _LOW)
    f = np.full((k, m + 1), _LOW)
    f[:, 1:] = -opening - extending * place[:-1]
    came[0, :, 2:] = 2 << 4
    last = np.empty((k, 3))

    def note(row: int) -> None:
        own = np.flatnonzero(ends[:, 0] == row)
        last[own] = np.stack([x[own, ends[own, 1]] for x in (h, e, f)], axis=1)

    note(0)
    for i in range(1, n + 1):
        before = np.where((h >= e) & (h >= f), 0, np.where(e >= f, 1, 2)).astype(np.uint8)
        best = np.maximum(np.maximum(h, e), f)
        nh = np.full((k, m + 1), _LOW)
        nh[:, 1:] = best[:, :-1] + score[a[:, i - 1 : i], b]
        from_h, from_f, from_e = h - opening, f - opening, e - extending
        ne = np.maximum(np.maximum(from_h, from_f), from_e)
        source = np.where(from_h >= ne, 0, np.where(from_e >= ne, 1, 2)).astype(np.uint8)
        start = np.maximum(nh, ne) - opening + extending * (place + 1)
        run = np.maximum.accumulate(start, axis=1)
        nf = np.full((k, m + 1), _LOW)
        nf[:, 1:] = run[:, :-1] - extending * place[1:]
        # a gap in a comes from the cell to the left: newly opened there, or gone on
        opened = start[:, :-1] >= run[:, :-1]
        fresh = np.where(nh[:, :-1] >= ne[:, :-1], 0, 1)
        came[i, :, 1:] = before[:, :-1] | (np.where(opened, fresh, 2).astype(np.uint8) << 4)
        came[i] |= source << 2
        h, e, f = nh, ne, nf
        note(i)
    return came, last


def align_many(pairs: list[tuple[str, str]], score: np.ndarray, opening: float, extending: float, numbers: list[tuple[np.ndarray, np.ndarray]] | None = None) -> list[tuple[str, str, float]]:
    """(a with gaps, b with gaps, score) of each pair. A gap of n costs
    opening + (n - 1) extending. numbers: rows of score for each pair's letters, where those
    are not the letters' own."""
    out: list[tuple[str, str, float] | None] = [None] * len(pairs)
    numbers = numbers or [(_numbers(x), _numbers(y)) for x, y in pairs]
    long = {i for i, (x, y) in enumerate(pairs) if x and y and (len(x) + 1) * (len(y) + 1) > LONG}
    for i in long:
        x, y = pairs[i]
        moves, total = align_long.align(*(z.astype(np.intp) for z in numbers[i]), score, opening, extending)
        out[i] = (*_gapped(x, y, moves), total)
    order = sorted(set(range(len(pairs))) - long, key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    at = 0
    while at < len(order):
        end, n, m = at, 0, 0
        while end < len(order):
            x, y = pairs[order[end]]
            wide, high = max(n, len(x)), max(m, len(y))
            if end > at and (end - at + 1) * (wide + 1) * (high + 1) > CELLS // 4:
                break
            n, m, end = wide, high, end + 1
        some = order[at:end]
        padded = np.pad(score, ((0, 2), (0, 2)), constant_values=-1e6)
        ends = np.array([[len(x) for x in pairs[i]] for i in some])
        came, last = _tables(_stack([numbers[i][0] for i in some], n, len(score)), _stack([numbers[i][1] for i in some], m, len(score) + 1), ends, padded, opening, extending)
        for k, i in enumerate(some):
            out[i] = _trace(*pairs[i], came[:, k], last[k])
        at = end
    return out


def _trace(a: str, b: str, came: np.ndarray, last: np.ndarray) -> tuple[str, str, float]:
    i, j = len(a), len(b)
    state = int(np.argmax(last))
    total = float(last[state])
    moves = []
    while i or j:
        cell = int(came[i, j])
        moves.append(state)
        if state == 0:
            i, j, state = i - 1, j - 1, cell & 3
        elif state == 1:
            i, state = i - 1, 1 if j == 0 else cell >> 2 & 3
        else:
            j, state = j - 1, 2 if i == 0 else cell >> 4 & 3
        if not i and j:
            state = 2
        elif i and not j:
            state = 1
    return *_gapped(a, b, moves[::-1]), total


def _gapped(a: str, b: str, moves: list[int]) -> tuple[str, str]:
    x, y = iter(a), iter(b)
    return "".join("-" if s == 2 else next(x) for s in moves), "".join("-" if s == 1 else next(y) for s in moves)


def nucleotide(a: str, b: str) -> tuple[str, str, float]:
    """Match 1, mismatch 0, gaps 2 and 0.5."""
    return align_many([(a, b)], nucleotide_scores(), 2.0, 0.5)[0]


def protein(a: str, b: str, matrix: dict[tuple[str, str], float] | None = None) -> tuple[str, str, float]:
    """Gaps 10 and 0.5 under a substitution matrix."""
    return align_many([(a, b)], protein_scores(matrix), 10.0, 0.5)[0]


def base_at(target: str, other: str) -> list[int]:
    """For each place of the target (gaps left out) the base the other shows, as 0 to 3 for
    ACGT; -1 at a gap or another letter."""
    return ["ACGT".find(y) if y != "-" else -1 for x, y in zip(target, other) if x != "-"]


def identity(x: str, y: str) -> tuple[float, int, int]:
    """(matches over aligned pairs, gap places, gap runs)."""
    p, q = (np.frombuffer(s.encode(), np.uint8) for s in (x, y))
    gap = (p == 45) | (q == 45)
    both = int((~gap).sum())
    runs = int((gap & ~np.concatenate([[False], gap[:-1]])).sum()) if len(gap) else 0
    return (int(((p == q) & ~gap).sum()) / both if both else float("nan")), int(gap.sum()), runs


def coding_places(span: str, cds: str, seed: int = 31) -> list[int] | None:
    """Places of a spliced CDS in its span: exons in order, each found by its next ``seed``
    bases behind the one before and taken as far as both agree; None where one is missing or
    there is nothing to place."""
    if not cds:
        return None
    exons: list[range] = []
    rest, free = cds, 0
    while rest:
        first = span.find(rest[:seed], free)
        if first < 0:
            return None
        free = first + len(os.path.commonprefix([span[first : first + len(rest)], rest]))
        exons.append(range(first, free))
        rest = rest[free - first :]
    return [place for exon in exons for place in exon]


# -- in Spark -----------------------------------------------------------------------------


def _in_batches(df: DataFrame, keys: list[str], columns: list[str], fn, ddl: str) -> DataFrame:
    """fn(list of rows) -> list of result rows, for the rows without nulls; the others come
    back with nulls. Rows are dealt to tasks by key: a small file is no single task."""
    names = [c.split()[0] for c in ddl.split(", ")]
    kinds = dict(df.dtypes)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                whole = part[columns].notna().all(axis=1).to_numpy()
                found = iter(fn(list(part.loc[whole, columns].itertuples(index=False, name=None))))
                none = (None,) * len(names)
                rows = [next(found) if w else none for w in whole]
                result = pd.DataFrame(rows, columns=names, index=part.index)
                yield pd.concat([part[keys], result], axis=1)

    dealt = df.select(*keys, *[c for c in columns if c not in keys])
    # the number is given, since small rows must not be gathered in one task: work is in letters
    dealt = dealt.repartition(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return dealt.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), ddl]))


def sites(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, score, identity, gap_places, gap_runs, sites): sites are the places of a (from
    0) where the aligned base of b differs."""
    score = nucleotide_scores()

    def run(rows):
        out = []
        for (x, y), (p, q, s) in zip(rows, align_many(rows, score, 2.0, 0.5)):
            i, gaps, runs = identity(p, q)
            out.append((s, None if i != i else i, gaps, runs, [n for n, (c, d) in enumerate(zip(x, base_at(p, q))) if d >= 0 and "ACGT"[d] != c]))
        return out

    return _in_batches(df, [key], [a, b], run, "score double, identity double, gap_places int, gap_runs int, sites array<int>")


def masks(df: DataFrame, key: str, span: str, cds: str) -> DataFrame:
    """(key, places): the places of a spliced sequence in its span; null where one is missing."""
    return _in_batches(df, [key], [span, cds], lambda rows: [(coding_places(x, y),) for x, y in rows], "places array<int>")


def called_bases(df: DataFrame, key: str, target: str, other: str) -> DataFrame:
    """(key, calls): for each place of the target the base that the aligned other shows."""
    score = nucleotide_scores()
    run = lambda rows: [(base_at(p, q),) for p, q, _ in align_many(rows, score, 2.0, 0.5)]
    return _in_batches(df, [key], [target, other], run, "calls array<int>")


def generation_scores(df: DataFrame, key: str, made: str, target: str) -> DataFrame:
    """(key, columns, matches, indel_bp, indel_events, nt_identity, aa_identity, n_stops,
    premature_stop, calls): one alignment of a made sequence with its target, one of their
    proteins; percentages are of alignment columns. Site hits are read off ``calls``
    (site_hits)."""
    from strandline.operators.rewrites import GENETIC

    score = nucleotide_scores()
    amino = resolved(GENETIC)
    protein_of = lambda s: "".join(amino.get(s[i : i + 3]) or amino.get(re.sub("[^ACGT]", "N", s[i : i + 3])) for i in range(0, len(s) - 2, 3))
    percent = lambda p, q: 100 * sum(x == y != "-" for x, y in zip(p, q)) / max(1, len(p))

    def run(rows):
        fine = [i for i, (x, y) in enumerate(rows) if x and y]
        bases = dict(zip(fine, align_many([rows[i] for i in fine], score, 2.0, 0.5)))
        proteins = {i: (protein_of(rows[i][0]), protein_of(rows[i][1])) for i in fine}
        both = [i for i in fine if all(proteins[i])]
        aligned = dict(zip(both, align_many([proteins[i] for i in both], score, 2.0, 0.5)))
        out = []
        for i, (x, _) in enumerate(rows):
            if i not in bases:
                out.append((None,) * 9)
                continue
            p, q, _ = bases[i]
            _, gaps, runs = identity(p, q)
            stops = [GENETIC.get(x[k : k + 3]) == "*" for k in range(0, len(x) - 2, 3)]
            aa = percent(*aligned[i][:2]) if i in aligned else None
            out.append((len(p), sum(c == d != "-" for c, d in zip(p, q)), gaps, runs, percent(p, q), aa, sum(stops), any(stops[:-1]), base_at(q, p)))
        return out

    return _in_batches(df, [key], [made, target], run, "columns int, matches int, indel_bp int, indel_events int, nt_identity double, aa_identity double, n_stops int, premature_stop boolean, calls array<int>")


def resolved(code: dict[str, str]) -> dict[str, str]:
    """The code with codons that hold N: the amino acid if all bases there give one, else X."""
    out = {}
    for codon in map("".join, itertools.product("ACGTN", repeat=3)):
        kinds = {code[x] for x in map("".join, itertools.product(*("ACGT" if c == "N" else c for c in codon)))}
        out[codon] = kinds.pop() if len(kinds) == 1 else "X"
    return out


def site_hits(calls: DataFrame, wanted: DataFrame, key: str, into: str) -> DataFrame:
    """(key, n_<into>, pct_<into>): of the wanted sites (key, i, base) inside the target how
    many the calls hit; the share is null without any."""
    return site_set_hits(calls, wanted, key, {into: F.lit(True)})


def site_set_hits(calls: DataFrame, wanted: DataFrame, key: str, sets: dict[str, Column]) -> DataFrame:
    """(key, n_<set>, pct_<set>, ...): site_hits of several sets, each a condition on a
    wanted site's columns. Calls are looked up by place and read once, so alignments are not
    made again for each set; both sides are sorted, since rows that come out of arrays or
    Python are many more than their plan's estimate, which would have them broadcast."""
    x = calls.select(key, "calls").join(wanted.hint("merge"), key, "left")
    inside = F.coalesce((F.col("i") >= 0) & (F.col("i") < F.size("calls")), F.lit(False))
    hit = F.expr("get(calls, i) = instr('ACGT', base) - 1").cast("double")
    numbers = []
    for name, where in sets.items():
        of = inside & where
        numbers += [F.count_if(of).alias(f"n_{name}"), (100 * F.avg(F.when(of, hit))).alias(f"pct_{name}")]
    return x.groupBy(key).agg(*numbers)


# -- codon-aware alignment ----------------------------------------------------------------


def blocks_of(x: str, y: str) -> list[tuple[int, int, int, int]]:
    """The runs of aligned letters: (from, to) in x and in y."""
    both = np.array([p != "-" != q for p, q in zip(x, y)], bool)
    edge = np.diff(np.concatenate([[0], both.astype(np.int8), [0]]))
    in_x = np.concatenate([[0], np.cumsum([p != "-" for p in x])])
    in_y = np.concatenate([[0], np.cumsum([q != "-" for q in y])])
    return [(int(in_x[s]), int(in_x[e]), int(in_y[s]), int(in_y[e])) for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


#: What an equal base adds to the score of two codons: all of a pair's together stay below
#: half a point up to 170,000 codons, so only alignments of equal score are told apart by it.
EQUAL_BASE = 2.0**-20


def codon_alignments(rows: list[tuple[str, str, str, str]], score: np.ndarray) -> list[tuple[str, str, float]]:
    """align_many of the proteins (pa, pb) of coding sequences (a, b), rows being (a, b, pa,
    pb); of alignments with equal scores the one whose codons share most bases."""
    letter = np.zeros(128, np.int64)  # bases as 1 to 4
    letter[[ord(x) for x in "ACGT"]] = range(1, 5)
    found = []
    for a, b, pa, pb in rows:
        for s, p in ((a, pa), (b, pb)):
            bases = letter[_numbers(s[: 3 * len(p)])]
            codons = np.pad(bases, (0, 3 * len(p) - len(bases))).reshape(-1, 3) @ [25, 5, 1]
            found.append(125 * _numbers(p).astype(np.int64) + codons)
    kinds, number = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_inverse=True)
    bases = np.stack([kinds // 25 % 5, kinds // 5 % 5, kinds % 5], axis=1)
    equal = ((bases[:, None] == bases[None]) & (bases[:, None] > 0)).sum(axis=2)
    fine = score[np.ix_(kinds // 125, kinds // 125)] + EQUAL_BASE * equal
    sides = np.split(number, np.cumsum([len(x) for x in found])[:-1]) if found else []
    return align_many([(p, q) for *_, p, q in rows], fine, 10.0, 0.5, list(zip(sides[::2], sides[1::2])))


def codon_blocks(df: DataFrame, key: str, a: str, b: str, matrix: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """(key, a, b, pa, pb, blocks): the two coding sequences, their proteins (one stop at
    the end left out) and the aligned codon blocks (hs, he, ts, te)."""
    from strandline.functions import sequences as S

    score = protein_scores(matrix)
    proteins = df.select(key, F.col(a).alias("a"), F.col(b).alias("b"), F.expr(S.translate_trimmed(a)).alias("pa"), F.expr(S.translate_trimmed(b)).alias("pb"))

    def many(rows):
        return [([dict(zip(("hs", "he", "ts", "te"), x)) for x in blocks_of(p, q)],) for p, q, _ in codon_alignments(rows, score)]

    found = _in_batches(proteins, [key, "a", "b", "pa", "pb"], ["a", "b", "pa", "pb"], many, "blocks array<struct<hs:int,he:int,ts:int,te:int>>")
    return found.select(key, "a", "b", "pa", "pb", "blocks")


#: Aligned codons of blocks as (h, t): numbers of the two codons; k: place in the block.
_CODONS = "flatten(transform(blocks, b -> transform(sequence(0, b.he - b.hs - 1), k -> struct(b.hs + k AS h, b.ts + k AS t, k))))"


def codon_sites(aligned: DataFrame, key: str) -> DataFrame:
    """(key, h_idx, t_idx, h_base, t_base, aa_change, differs): the places of aligned whole
    codons where both show one of ACGT."""
    each = aligned.select(key, "a", "b", "pa", "pb", F.explode(F.expr(_CODONS)).alias("c")).select(key, "a", "b", "pa", "pb", "c.h", "c.t")
    whole = each.where("length(a) >= 3 * h + 3 AND length(b) >= 3 * t + 3")
    at = whole.withColumn("o", F.explode(F.array(*map(F.lit, range(3)))))
    out = at.select(key, F.expr("3 * h + o").alias("h_idx"), F.expr("3 * t + o").alias("t_idx"), F.expr("substr(a, 3 * h + o + 1, 1)").alias("h_base"), F.expr("substr(b, 3 * t + o + 1, 1)").alias("t_base"), F.expr("substr(pa, h + 1, 1) <> substr(pb, t + 1, 1)").alias("aa_change"))
    acgt = ("A", "C", "G", "T")
    return out.where(F.col("h_base").isin(*acgt) & F.col("t_base").isin(*acgt)).withColumn("differs", F.col("h_base") != F.col("t_base"))


def continuation_sites(sites_: DataFrame, key: str, prefix: int) -> DataFrame:
    """(key, i, base): differing places behind the prefix, counted from its end."""
    return sites_.where(F.col("differs") & (F.col("t_idx") >= prefix)).select(key, (F.col("t_idx") - prefix).alias("i"), F.col("t_base").alias("base"))


def context_places(aligned: DataFrame, key: str, context: int) -> DataFrame:
    """(key, h_idx, t_idx): places of aligned whole codons with ``context`` bases (rounded
    up to codons) of the same block before them."""
    each = aligned.select(key, "a", "b", F.explode(F.expr(f"filter({_CODONS}, c -> c.k >= {-(-context // 3)})")).alias("c"))
    whole = each.where("length(a) >= 3 * c.h + 3 AND length(b) >= 3 * c.t + 3")
    return whole.select(key, F.col("c.h").alias("h"), F.col("c.t").alias("t"), F.explode(F.array(*map(F.lit, range(3)))).alias("o")).select(key, F.expr("3 * h + o").alias("h_idx"), F.expr("3 * t + o").alias("t_idx"))


def block_facts(aligned: DataFrame) -> DataFrame:
    """aligned with n_blocks, matched (codons), indel_frac and aa_identity."""
    same = f"size(filter({_CODONS}, c -> substr(pa, c.h + 1, 1) = substr(pb, c.t + 1, 1)))"
    out = aligned.withColumn("n_blocks", F.size("blocks")).withColumn("matched", F.expr("aggregate(blocks, 0, (s, b) -> s + b.he - b.hs)"))
    return out.withColumn("indel_frac", F.expr("round(1 - try_divide(CAST(matched AS DOUBLE), greatest(length(pa), length(pb))), 6)")).withColumn("aa_identity", F.expr(f"round({same} / CAST(greatest(matched, 1) AS DOUBLE), 6)"))


def prefix_gate(aligned: DataFrame, prefix_codons: int) -> DataFrame:
    """aligned with ``reason``: why the first codons can't serve as a common prefix, null if
    they can."""
    stop = lambda p: f"instr(substr({p}, 1, {prefix_codons}), '*') > 0"
    reason = f"""CASE WHEN size(blocks) = 0 THEN 'no_alignment'
      WHEN blocks[0].hs <> 0 OR blocks[0].ts <> 0 THEN 'prefix_not_homologous'
      WHEN least(blocks[0].he, blocks[0].te) < {prefix_codons} THEN 'indel_in_prefix'
      WHEN {stop("pa")} THEN 'stop_in_prefix_a' WHEN {stop("pb")} THEN 'stop_in_prefix_b' END"""
    return aligned.withColumn("reason", F.expr(reason))


def window_gate(aligned: DataFrame, prefix_codons: int, latest: int) -> DataFrame:
    """aligned with ``start_h``, ``start_t`` (the first block without a stop in its first
    codons that is long enough and starts by ``latest``) and ``reason`` where there is none."""
    long = f"b.he - b.hs >= {prefix_codons}"
    clean = f"instr(substr(pa, b.hs + 1, {prefix_codons}), '*') = 0 AND instr(substr(pb, b.ts + 1, {prefix_codons}), '*') = 0"
    fit = F.expr(f"try_element_at(filter(blocks, b -> {long} AND b.hs <= {latest} AND {clean}), 1)")
    reason = F.expr(f"CASE WHEN size(blocks) = 0 THEN 'no_alignment' WHEN NOT exists(blocks, b -> {long}) THEN 'no_indel_free_window' ELSE 'window_starts_too_late' END")
    return aligned.withColumn("w_", fit).withColumn("start_h", F.col("w_.hs")).withColumn("start_t", F.col("w_.ts")).withColumn("reason", F.when(F.col("w_").isNull(), reason)).drop("w_")
