"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document. The ledger keeps the measurements and one
bit for each rule that fails. A policy is a named, versioned mask of rules: applying
or changing it is a bitwise AND over stored bits, and ablations ("what if this rule
were off") come from counts by bit pattern, without reading a text again.

Defined cases: a null text counts as empty; an empty text fails ``few_words``; very long
texts are measured whole; rules are strict inequalities, so a text at a bound passes; extra
columns come along untouched; repeated rows each get their own ledger row; an empty table
gives an empty ledger.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import ascii_words, fresh, scalar_struct

#: Rules in bit order. Bits are part of the stored format: append, never reorder.
RULES = (
    "few_words",  # under 20 words
    "repeated_windows",  # over 30 % of the words lie in 8-word windows that occur twice or more
    "symbols",  # over one symbol of #*$%&|<> for each ten words
    "upper_case",  # over half of the ASCII letters are capitals
    "exclamations",  # over one ! for each four words
    "repeated_lines",  # over half of the lines with a word repeat an earlier one
    "word_length",  # mean word under 2 or over 24 code points
    "few_letters",  # under half of the code points in words are letters or beyond ASCII
)
FEW_WORDS, REPEATED_WINDOWS = 1, 2

#: Versioned policies: the rules that reject a document.
POLICIES = {
    "base": FEW_WORDS | REPEATED_WINDOWS,
    "v1": (1 << len(RULES)) - 1,
}

WINDOW = 8

_DDL = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_lines:bigint,n_dup_lines:bigint,"
    "n_repeat_words:bigint,n_upper:bigint,n_lower:bigint,n_exclamations:bigint,n_letters:bigint>"
)


def _pair_ids(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids of pairs: equal where both members are equal, below the pair count."""
    span = int(right.max()) + 1
    return np.unique(left * span + right, return_inverse=True)[1].astype(np.int64)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window (of a power of two words) found twice or more.

    Windows get exact ids by doubling: ids of 2 words, then 4, then 8."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    width = 1
    while width < window:
        ids = _pair_ids(ids[:-width], ids[width:])
        if int(ids.max()) + 1 == len(ids):
            return 0
        width *= 2
    again = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


_SPACE = np.array([32, 9, 10, 11, 12, 13])
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of the ledger's columns."""
    words = ascii_words(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    inner = int(count[0x80:0xC0].sum())  # bytes inside a code point
    spaces = int(count[_SPACE].sum())
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(text) - inner - spaces,
        int(count[_SYMBOLS].sum()),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
        upper,
        lower,
        int(count[33]),
        upper + lower + int(count[0xC0:].sum()),
    )


def _measured(texts: list[bytes | None]) -> list[list]:
    return list(zip(*(measure(t or b"") for t in texts))) or [[]] * 10


def ledger(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with their measurements and ``fail_bits`` (long): bit i is RULES[i].

    A ledger column replaces a column of docs that has its name."""
    at = fresh(docs, "_ledger")
    out = docs.withColumn(at, scalar_struct(_measured, _DDL)(F.col(text)))
    get = lambda name: F.col(at)[name]
    n = get("n_words")
    fails = [
        n < 20,
        100 * get("n_repeat_words") > 30 * n,
        10 * get("n_symbols") > n,
        get("n_upper") > get("n_lower"),
        4 * get("n_exclamations") > n,
        2 * get("n_dup_lines") > get("n_lines"),
        (get("word_chars") < 2 * n) | (get("word_chars") > 24 * n),
        2 * get("n_letters") < get("word_chars"),
    ]
    bits = sum((F.when(rule, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(fails)), F.lit(0).cast("long"))
    names = [x.split(":")[0] for x in _DDL[7:-1].split(",")]
    return out.withColumns({name: get(name) for name in names} | {"fail_bits": bits}).drop(at)


def verdicts(ledger_df: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """The ledger with one boolean ``kept_<version>`` for each policy."""
    return ledger_df.withColumns({f"kept_{v}": F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0 for v, mask in (policies or POLICIES).items()})


def ablations(ledger_df: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """For each policy and each of its rules: documents that fail the rule, that fail
    nothing else in the policy (they would come back if it were dropped), and that the
    policy keeps. Works on counts by bit pattern, at most 2^rules rows."""
    policies = policies or POLICIES
    patterns = ledger_df.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = [(v, mask, i, name) for v, mask in policies.items() for i, name in enumerate(RULES) if mask >> i & 1]
    grid = F.explode(F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(m).cast("long").alias("mask"), F.lit(1 << i).cast("long").alias("bit"), F.lit(r).alias("rule")) for v, m, i, r in rules]))
    x = patterns.withColumn("g", grid).select("n", "fail_bits", "g.*").withColumn("hit", F.col("fail_bits").bitwiseAND(F.col("mask")))
    n_if = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return x.groupBy("policy", "rule").agg(
        n_if(F.col("hit").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        n_if(F.col("hit") == F.col("bit")).alias("n_failed_alone"),
        n_if(F.col("hit") == 0).alias("n_kept"),
    )


def keep_good(docs: DataFrame, *, text: str = "text", policy: str = "v1") -> DataFrame:
    """The rows of docs that the policy keeps, with the columns of docs."""
    at = fresh(docs, "_quality")
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(at), F.col(text).alias(fresh(docs, "_text")))
    held = ledger(wrapped, text=wrapped.columns[1])
    return held.where(F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0).select(f"{at}.*")
