"""Language identification by error-correcting output codes.

Each language has a codeword of bits. One binary classifier a bit tells from byte n-grams
whether a text's language has that bit: a log-linear model whose weight for an n-gram is
the log ratio of its mean relative frequency among the languages with the bit to that
among those without (smoothed, languages weighted alike however unequal the corpus).
A text's margin for a bit is the mean weight of its n-grams. Decoding takes the codeword of
least loss: the logistic loss of each bit's margin, weighted by how far apart the bit's two
sides lie (their symmetric divergence). Where the second-best codeword is close, the text
is flagged as ambiguous.

Learning is one pass of counts over all labelled texts, summed by a shuffle of at most
languages x buckets rows a task.

Codewords: all splits of the languages in two for up to 7 of them; beyond that a fixed
pseudo-random code of 15 bits per doubling of languages, whose columns differ.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every
text if nothing was learned; with one language known it is always the answer; of languages
of equal loss the first by name is the answer, flagged as ambiguous; very long texts count
whole, part by part; repeated rows are each answered; an empty table gives an empty one; a
column named like ``into`` (case aside) is replaced, other extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import as_bytes, scalar_struct

ORDERS, BUCKET_BITS, PRIOR = (2, 3, 4), 15, 0.5
#: Margins are in nats for one n-gram; a text's evidence counts as that of so many.
SHARPNESS = 20.0
AMBIGUOUS = 0.2
PIECE = 1 << 20
LETTER = r"\p{L}"


def held_out(id: Column, parts: int = 4, left: int = 2) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % parts == left, F.lit(False))


def grams(text: bytes) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of a text, part by part, orders apart."""
    low = b" " + text.decode("utf-8", "replace").lower().encode() + b" "
    for at in range(0, len(low), PIECE):
        b = np.frombuffer(low, np.uint8)[at : at + PIECE + max(ORDERS) - 1].astype(np.uint32)
        code = b.copy()
        for order in range(2, max(ORDERS) + 1):
            code = (code[:-1] << np.uint32(8)) | b[order - 1 :]
            if order in ORDERS:
                own = code[: max(0, min(PIECE, len(b) - order + 1))]
                place = (own * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
                yield place.astype(np.int64) + (ORDERS.index(order) << BUCKET_BITS)


def counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n) over labelled texts."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in it:
            for name, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if name not in total:
                    total[name] = np.zeros(len(ORDERS) << BUCKET_BITS, np.int64)
                for g in grams(t):
                    if len(g) > 1 << 14:
                        total[name] += np.bincount(g, minlength=len(total[name]))
                    else:
                        np.add.at(total[name], g, 1)
        for name, n in total.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen)), pa.array(seen.astype(np.int32)), pa.array(n[seen])], schema=schema)

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def code_matrix(n: int) -> np.ndarray:
    """Codewords of n languages as rows of +1 and -1."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 7:
        splits = [s for s in range(1, 1 << (n - 1))]
        return np.array([[1 if s >> i & 1 else -1 for s in splits] for i in range(n)], float)
    rng, columns, seen = np.random.default_rng(7), [], set()
    while len(columns) < 15 * math.ceil(math.log2(n)):
        c = rng.choice([-1, 1], n)
        key = tuple(c * c[0])
        if key not in seen and abs(int(c.sum())) < n:
            seen.add(key)
            columns.append(c)
    return np.array(columns, float).T


class Coder:
    """languages: names; table[i]: n-gram counts of language i."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.code = languages, code_matrix(len(languages))
        shape = (len(languages), len(ORDERS), 1 << BUCKET_BITS)
        p = table.reshape(shape).astype(float) + PRIOR
        p /= p.sum(axis=2, keepdims=True)
        n_bits = self.code.shape[1]
        self.weights = np.zeros((len(ORDERS) << BUCKET_BITS, n_bits), np.float32)
        self.apart = np.ones(n_bits)
        for b in range(n_bits):
            side = self.code[:, b] > 0
            if side.all() or not side.any():
                continue
            yes, no = p[side].mean(axis=0), p[~side].mean(axis=0)
            w = np.log(yes / no)
            self.weights[:, b] = w.ravel()
            self.apart[b] = ((yes - no) * w).sum() / len(ORDERS)
        self.apart /= self.apart.sum() or 1

    def margins(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for g in grams(text):
            total += self.weights[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return total / max(1, n)

    def decide(self, text: bytes) -> tuple[str, float, bool]:
        """(language, its share, whether the second-best is close)."""
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        m = self.margins(text) * SHARPNESS
        loss = (np.logaddexp(0, -self.code * m) * self.apart).sum(axis=1) * self.code.shape[1]
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(np.argmin(loss))
        second = np.sort(p)[-2]
        return self.languages[best], float(min(1.0, p[best])), bool(p[best] - second < AMBIGUOUS)


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    rows = counts(docs, text, lang).toPandas()  # at most languages x buckets rows
    languages = sorted(set(rows["lang"]))
    number = {x: i for i, x in enumerate(languages)}
    table = np.zeros((len(languages), len(ORDERS) << BUCKET_BITS), np.int64)
    if len(rows):
        np.add.at(table, (rows["lang"].map(number).to_numpy(), rows["bucket"].to_numpy()), rows["n"].to_numpy())
    return languages, table


def identify(docs: DataFrame, learned: tuple[list[str], np.ndarray], *, text: str = "text", into: str = "language") -> DataFrame:
    """docs with a struct ``into``: lang_pred, score, ambiguous."""
    model = docs.sparkSession.sparkContext.broadcast(learned)
    state: dict = {}

    def run(texts: list[bytes | None]) -> list[list]:
        if not state:
            state["coder"] = Coder(*model.value) if model.value[0] else None
            state["letter"] = regex.compile(LETTER).search
        coder, letter = state["coder"], state["letter"]
        out = [coder.decide(t) if coder and t and letter(t.decode("utf-8", "replace")) else ("und", 0.0, False) for t in texts]
        return list(zip(*out)) or [[], [], []]

    return docs.withColumn(into, scalar_struct(run, "struct<lang_pred:string,score:double,ambiguous:boolean>")(F.col(text)))
