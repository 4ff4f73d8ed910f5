"""Sequence functions as Spark expressions: no Python runs per row.

Each takes SQL expressions (column names or longer) and returns a SQL expression string,
so that they nest. Null sequences give null; ratios over nothing give null.
"""

from __future__ import annotations

#: The standard genetic code, codons in TCAG order (a fixed value).
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
SENSE = [a + b + c for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG") if CODE[16 * i + 4 * j + k] != "*"]


def codons(s: str, whole: bool = True) -> str:
    """The codons of s from its first base; whole leaves out a partial one at the end."""
    last = f"length({s}) - 2" if whole else f"length({s})"
    return f"CASE WHEN length({s}) >= 3 THEN transform(sequence(1, {last}, 3), i -> substr({s}, i, 3)) ELSE CAST(array() AS array<string>) END"


def amino(codon: str) -> str:
    """The amino acid of a codon; null where a base is not one of ACGT."""
    at = lambda n: f"(instr('TCAG', substr({codon}, {n}, 1)) - 1)"
    ok = f"length({codon}) = 3 AND translate({codon}, 'ACGT', '') = ''"
    return f"CASE WHEN {ok} THEN substr('{CODE}', 16 * {at(1)} + 4 * {at(2)} + {at(3)} + 1, 1) END"


def _protein(s: str, each: str) -> str:
    return f"array_join(transform({codons(s)}, c -> {each}), '')"


def translate_plain(s: str) -> str:
    """U read as T; stop and unknown codons become X."""
    t = f"translate({s}, 'U', 'T')"
    return _protein(t, f"coalesce(nullif({amino('c')}, '*'), 'X')")


def translate_stops(s: str) -> str:
    """Unknown codons become X, stops stay *."""
    return _protein(s, f"coalesce({amino('c')}, 'X')")


def translate_masked(s: str) -> str:
    """Letters other than ACGT count as N; codons with one become X, stops stay."""
    return translate_stops(f"regexp_replace({s}, '[^ACGT]', 'N')")


def translate_trimmed(s: str) -> str:
    """As translate_stops, without one stop at the end."""
    return f"regexp_replace({translate_stops(s)}, '[*]$', '')"


def reverse_complement(s: str) -> str:
    return f"reverse(translate({s}, 'ACGTacgt', 'TGCAtgca'))"


def count_of(s: str, letters: str) -> str:
    """How many characters of s are among the letters."""
    return f"(length({s}) - length(translate({s}, '{letters}', '')))"


def gc_valid(s: str) -> str:
    """GC fraction of the valid bases; null without any."""
    return f"try_divide(CAST({count_of(s, 'GC')} AS DOUBLE), {count_of(s, 'ACGT')})"


def gc_length(s: str) -> str:
    """GC fraction of the full length, at least 1."""
    return f"({count_of(s, 'GC')} / CAST(greatest(1, length({s})) AS DOUBLE))"


def every_third(s: str, start: int) -> str:
    """Bases start, start + 3, ... (from 1) as a string."""
    return f"CASE WHEN length({s}) >= {start} THEN array_join(transform(sequence({start}, length({s}), 3), i -> substr({s}, i, 1)), '') ELSE '' END"


def gc3_fraction(s: str) -> str:
    return gc_length(every_third(s, 3))


def gc3_percent(s: str) -> str:
    return f"(100 * {gc_valid(every_third(s, 3))})"


def gc_position_percent(s: str, position: int) -> str:
    """GC percent of a codon position over whole codons."""
    whole = f"substr({s}, 1, CAST(floor(length({s}) / 3) * 3 AS INT))"
    return f"(100 * {gc_valid(every_third(whole, position))})"


def gc_class(a: str, b: str) -> str:
    """Whether a change of base a to b adds G or C, takes it away, or neither."""
    strong = lambda x: f"({x} IN ('G', 'C'))"
    return f"CASE WHEN {strong(b)} AND NOT {strong(a)} THEN 'up' WHEN {strong(a)} AND NOT {strong(b)} THEN 'down' ELSE 'neutral' END"


def longest_run(s: str, letter: str = "N") -> str:
    return f"coalesce(array_max(transform(regexp_extract_all({s}, '({letter}+)', 1), r -> length(r))), 0)"


def hamming(a: str, b: str) -> str:
    """Differing places over the shorter length."""
    n = f"least(length({a}), length({b}))"
    return f"CASE WHEN {n} > 0 THEN size(filter(sequence(1, {n}), i -> substr({a}, i, 1) <> substr({b}, i, 1))) ELSE 0 END"


def positional_identity(a: str, b: str) -> str:
    n = f"least(length({a}), length({b}))"
    return f"(1 - try_divide(CAST({hamming(a, b)} AS DOUBLE), {n}))"


def edit_identity(a: str, b: str) -> str:
    return f"(1 - try_divide(CAST(levenshtein({a}, {b}) AS DOUBLE), greatest(length({a}), length({b}))))"


def chance_identity(a: str, b: str) -> str:
    """What two sequences of these base frequencies share by chance."""
    f = lambda s, x: f"try_divide(CAST({count_of(s, x)} AS DOUBLE), length({s}))"
    return "(" + " + ".join(f"{f(a, x)} * {f(b, x)}" for x in "ACGT") + ")"


def divergence(p: str, q: str) -> str:
    """Jensen-Shannon divergence in bits of two arrays of frequencies."""
    term = "CASE WHEN x > 0 THEN 0.5D * x * log2(2 * x / (x + y)) ELSE 0D END"
    part = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> {term}), 0D, (s, v) -> s + v)"
    return f"({part(p, q)} + {part(q, p)})"


def synonymous_sites(codon: str) -> str:
    """The synonymous sites of a codon: at each place the share of the three other bases
    that keep the amino acid (changes to a stop do not)."""
    parts = []
    for place in (1, 2, 3):
        for base in "ACGT":
            changed = f"overlay({codon} PLACING '{base}' FROM {place})"
            parts.append(f"CASE WHEN substr({codon}, {place}, 1) <> '{base}' AND {amino(changed)} = {amino(codon)} THEN 1 ELSE 0 END")
    return "((" + " + ".join(parts) + ") / 3.0D)"


def window_bounds(length: str, window: int, most: int) -> str:
    """Windows over a length as an array of (i, start, stop): contiguous ones of about the
    window's size, or ``most`` evenly spaced ones where more would be needed."""
    n = f"CAST(ceil({length} / {window}.0D) AS INT)"
    half, gaps = window // 2, max(1, most - 1)
    even = lambda x: f"CAST(bround({x}, 0) AS INT)"  # noqa: E731  (half to even)
    centre = f"CAST({half} + i * ({length} - {2 * half}) / {gaps}.0D AS INT)"
    near = f"transform(sequence(0, {n} - 1), i -> struct(i, {even(f'i * {length} / CAST({n} AS DOUBLE)')} AS start, {even(f'(i + 1) * {length} / CAST({n} AS DOUBLE)')} AS stop))"
    far = f"transform(sequence(0, {most - 1}), i -> struct(i, {centre} - {half} AS start, {centre} + {half} AS stop))"
    return f"CASE WHEN {length} <= {window} THEN array(struct(0 AS i, 0 AS start, CAST({length} AS INT) AS stop)) WHEN {n} <= {most} THEN {near} ELSE {far} END"


def replaced(s: str, places: str, new: str) -> str:
    """s with the letters of ``new`` at places (from 0); an error where their numbers differ."""
    at = f"map_from_arrays({places}, split({new}, ''))"
    ok = f"size({places}) = length({new})"
    done = f"array_join(transform(sequence(0, length({s}) - 1), i -> coalesce(try_element_at({at}, i), substr({s}, i + 1, 1))), '')"
    return f"CASE WHEN {ok} THEN {done} ELSE raise_error('as many places as letters are needed') END"


def p_label(p: str) -> str:
    """A p value as text: null as n/a, small ones as a bound."""
    return f"CASE WHEN {p} IS NULL THEN 'n/a' WHEN {p} < 0.001 THEN 'p < 0.001' ELSE concat('p = ', format_string('%.3f', {p})) END"
