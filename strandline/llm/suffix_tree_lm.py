"""Language-model scoring by a probabilistic suffix tree over words.

A text is the sequence of its lower-cased words and an end. Every word of the training
texts is a symbol; words never seen share one event, as in the add-one unigram base, so
both scores compare. The tree's root gives that event Witten-Bell mass. A context is one to
``DEPTH`` words before a token, inside its text.

1. Documents are packed in batches: distinct 64-bit word hashes in ascending order, and
   the texts as numbers into them. Everything after this reads the batches, not texts.
2. Batches send their distinct words and runs of words, as sorted hashes with training
   counts, to shards by leading bits; a shard adds up and answers each batch in its order.
   A run is sent if its words less the first, and less the last, may have been seen twice:
   what occurs once neither is a state nor moves one.
3. A context stays in the tree if its next-word distribution diverges from its suffix's:
   the summed log ratio of both over its occurrences (count x divergence, each occurrence
   left out of its own estimate, so that chance gains nothing) reaches ``GAIN`` nats. The
   sums travel to shards as the counts do.
4. A kept context's distribution gives each next word its count less one; the mass so taken
   goes to its suffix's distribution.
5. Each token is scored in its longest suffix state.

Making the frame runs jobs; batches and answers stand as bucketed tables until they end, so
that an answer is shuffled once, however many steps read it.
Nothing of the model is held by the driver or broadcast, and no key gathers more than one
row a batch and shard, however frequent. Thresholds are absolute, so contexts grow with the
corpus. Hashes of runs have ``SPARE_BITS`` bits more than the number of training tokens
needs: one run in 2 ** SPARE_BITS meets another by chance.

Defined cases: a null text is empty and consists of the end alone; a very long text
goes whole into one batch; a missing doc_id is never held out; repeated rows count and score once
each; there are no ties to break; an empty table gives no rows; extra columns, whatever
their names, are not read; with no training text every score is 0.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.batch_tables import Tables, with_answers
from strandline.llm.text import as_bytes, ascii_words, stored

DEPTH, GAIN = 3, 3.0
BATCH_BYTES, SHARD_KEYS = 8 << 20, 2_000_000
SPARE_BITS = 20
END_WORD = b"\n"  # no word
#: Fixed point of sums that travel: order of addition cannot change them.
NATS, SHARE = 1 << 10, 1 << 16
#: Level numbers of context sums, beside 0 for words and k for runs behind k words.
CONTEXT = 100
NOTHING = np.zeros(0, np.int64)


def held_out(id: Column, parts: int = 7, left: int = 2) -> Column:
    """Whether crc32 of doc_id as text leaves the given remainder."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % parts == left, F.lit(False))


def packed(values: np.ndarray) -> bytes:
    """Integers byte by byte of equal weight, compressed: high zero bytes cost nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""
    return len(values).to_bytes(5, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(raw[:5], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(raw[5:], n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending hashes as packed differences."""
    return packed(np.diff(keys.astype("<u8"), prepend=np.zeros(1, "<u8")))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, "<u8"), dtype=np.uint64)


# -- batches --------------------------------------------------------------------------

_BATCH = [("batch", pa.string()), ("docs", pa.binary()), ("missing", pa.binary()), ("held", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary()), ("hashes", pa.binary()), ("n_tokens", pa.int64()), ("n_trained", pa.int64())]
_BATCH_DDL = "batch string, docs binary, missing binary, held binary, lengths binary, words binary, hashes binary, n_tokens long, n_trained long"


def _row_of(docs: list, held: list[bool], lengths: list[int], numbers: list[np.ndarray], vocab: dict[bytes, int]) -> tuple:
    digest = xxhash.xxh64_intdigest
    # two words of one hash become one, as they do in the shards
    unique, place = np.unique(np.array([digest(w) for w in vocab], np.uint64), return_inverse=True)
    words = place[np.concatenate(numbers)]
    ids = np.array([0 if d is None else d for d in docs], "<i8")
    out = np.array(held, np.uint8)
    trained = int(np.array(lengths)[out == 0].sum())
    return (uuid.uuid4().hex, packed(ids), packed(np.array([d is None for d in docs], np.uint8)), packed(out), packed(np.array(lengths, "<u4")), packed(words.astype("<u4")), packed_keys(unique), len(words), trained)


def batches_of(docs: DataFrame) -> DataFrame:
    """A row for each batch of documents; docs: (doc_id, text, held)."""
    schema = pa.schema(_BATCH)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, lengths, numbers, vocab, size = [], [], [], [], {}, 0

        def flush() -> pa.RecordBatch:
            row = _row_of(ids, held, lengths, numbers, vocab)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, (_, k) in zip(row, _BATCH)], schema=schema)

        for batch in it:
            for doc, t, out in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                words = ascii_words((t or b"").lower())
                words.append(END_WORD)
                for w in set(words).difference(vocab):
                    vocab[w] = len(vocab)
                numbers.append(np.fromiter(map(vocab.__getitem__, words), np.uint32, len(words)))
                ids.append(doc)
                held.append(out)
                lengths.append(len(words))
                size += len(t or b"")
                if size >= BATCH_BYTES:
                    yield flush()
                    ids, held, lengths, numbers, vocab, size = [], [], [], [], {}, 0
        if ids:
            yield flush()

    return docs.mapInArrow(run, _BATCH_DDL)


@dataclass
class Level:
    """A batch's tokens behind k words: the runs' hashes, those of their contexts (the runs
    less the last word), and training counts of both. Counts are 0 for contexts seen under
    twice and, behind a word or more, for runs seen under twice."""

    k: int
    run: np.ndarray
    context: np.ndarray
    counts: np.ndarray | None
    states: np.ndarray | None


class Tokens:
    """The tokens of a batch."""

    def __init__(self, row: dict, shift: int):
        self.hashes = unpacked_keys(row["hashes"])
        self.words = unpacked(row["words"], "<u4")
        self.lengths = unpacked(row["lengths"], "<u4").astype(np.int64)
        self.held = unpacked(row["held"], "u1")
        self.trains = np.repeat(self.held == 0, self.lengths)
        self.starts, self.shift = np.cumsum(self.lengths) - self.lengths, np.uint64(shift)

    def asked(self, hashes: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ascending distinct keys, tokens, the key of each of them)."""
        at = np.flatnonzero(where)
        keys, inverse = np.unique(hashes[at] >> self.shift, return_inverse=True)
        return keys, at, inverse

    def answered(self, hashes: np.ndarray, where: np.ndarray, answer: np.ndarray) -> np.ndarray:
        """The answer for each token, 0 where nothing was asked."""
        out = np.zeros(len(self.words), np.int64)
        if len(answer):
            _, at, inverse = self.asked(hashes, where)
            out[at] = answer[inverse]
        return out

    def levels(self, depth: int, answers: dict[int, np.ndarray]) -> Iterator[tuple[Level, np.ndarray]]:
        """Levels 0 to depth, each with the tokens whose runs are sent. Counts that no answer
        gave yet are 0."""
        words = run = self.hashes[self.words]
        sent = inside = np.ones(len(run), bool)
        counts = answers[0][self.words] if 0 in answers else None
        yield Level(0, run, run, counts, None), sent
        for k in range(1, depth + 1):
            context = _moved(run)
            run = context * np.uint64(0x9E3779B97F4A7C15) ^ words
            run ^= run >> np.uint64(32)
            run *= np.uint64(0xD6E8FEB86659FD93)
            run ^= run >> np.uint64(29)
            inside = _moved(inside)
            inside[self.starts] = False
            if k == 2:
                sent = counts >= 2
            sent = (_moved(sent) & sent if k > 1 else sent) & inside
            states = None
            if counts is not None:
                states = _moved(counts)
                states[~inside | (states < 2)] = 0
            counts = self.answered(run, sent, answers.get(k, NOTHING))
            yield Level(k, run, context, counts, states), sent


def _moved(x: np.ndarray) -> np.ndarray:
    """Each token's predecessor's value; 0 for the first."""
    return np.concatenate([np.zeros(1, x.dtype), x[:-1]])


# -- requests and answers -------------------------------------------------------------

_SLICE = pa.schema([("level", pa.int32()), ("shard", pa.int32()), ("batch", pa.string()), ("keys", pa.binary()), ("values", pa.list_(pa.binary()))])
_SLICE_DDL = "level int, shard int, batch string, keys binary, values array<binary>"
_ANSWER_DDL = "level int, shard int, batch string, kinds long, answer binary"


def _cut(level: int, batch: str, keys: np.ndarray, values: list[np.ndarray], bits: int, width: int) -> pa.RecordBatch:
    """A request's rows, one for each shard that it meets."""
    edges = np.append(np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width - bits)), len(keys))
    parts = [(i, int(a), int(b)) for i, (a, b) in enumerate(zip([0, *edges[:-1]], edges)) if b > a]
    columns = [
        pa.array([level] * len(parts), pa.int32()),
        pa.array([i for i, _, _ in parts], pa.int32()),
        pa.array([batch] * len(parts), pa.string()),
        pa.array([packed_keys(keys[a:b]) for _, a, b in parts], pa.binary()),
        pa.array([[packed(v[a:b]) for v in values] for _, a, b in parts], pa.list_(pa.binary())),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_SLICE)


def _answers(pdf: pd.DataFrame, gain: float) -> pd.DataFrame:
    """A shard's sums, in each request's order."""
    level = int(pdf["level"].iloc[0])
    parts = [unpacked_keys(x) for x in pdf["keys"]]
    found, inverse = np.unique(np.concatenate(parts), return_inverse=True)

    def column(i: int) -> np.ndarray:
        return np.concatenate([unpacked(v[i], "<i8") for v in pdf["values"]])

    total = np.bincount(inverse, weights=column(0), minlength=len(found)).astype(np.int64)
    kinds = int((total > 0).sum())
    if level >= CONTEXT:
        share = np.bincount(inverse, weights=column(1), minlength=len(found)) / SHARE
        sizes, n = column(2), np.ones(len(found))
        n[inverse[sizes > 0]] = sizes[sizes > 0]
        total = np.where((share > 0) & (total / NATS - n * np.log(n) >= gain), n - np.rint(share), 0).astype(np.int64)
    elif level:
        total[total < 2] = 0
    back = total[inverse].astype("<i8")
    ends = np.cumsum([len(x) for x in parts])
    return pd.DataFrame({"level": level, "shard": pdf["shard"], "batch": pdf["batch"], "kinds": np.where(np.arange(len(parts)) == 0, kinds, 0), "answer": [packed(back[a:b]) for a, b in zip([0, *ends[:-1]], ends)]})


def summed(requests: DataFrame, gain: float) -> DataFrame:
    """(level, shard, batch, kinds, answer) of the requests that batches cut into slices."""
    return requests.groupBy("level", "shard").applyInPandas(lambda pdf: _answers(pdf, gain), _ANSWER_DDL)


_ANSWERED = ["level", "shard", "answer"]


def _by_level(row: dict) -> dict[int, np.ndarray]:
    parts: dict[int, list[np.ndarray]] = {}
    for x in row.get("answers", ()):
        parts.setdefault(x["level"], []).append(unpacked(x["answer"], "<i8"))
    return {k: np.concatenate(v) for k, v in parts.items()}


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time."""
    for batch in it:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def requests(batches: DataFrame, of: Callable[[Tokens, dict], Iterator[tuple[int, np.ndarray, list[np.ndarray]]]], bits: int, width: int) -> DataFrame:
    """Slices of what ``of`` asks for each batch: (level, keys, values)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(it):
            for level, keys, values in of(Tokens(row, 64 - width), _by_level(row)):
                if len(keys):
                    yield _cut(level, row["batch"], keys, [v.astype("<i8") for v in values], bits, width if level else 64)

    return batches.mapInArrow(run, _SLICE_DDL)


def _ask_first(tokens: Tokens, answers: dict) -> Iterator[tuple]:
    """Words, and words behind one."""
    yield 0, tokens.hashes, [np.bincount(tokens.words, weights=tokens.trains, minlength=len(tokens.hashes))]
    for level, sent in tokens.levels(1, answers):
        if level.k:
            keys, at, inverse = tokens.asked(level.run, sent)
            yield level.k, keys, [np.bincount(inverse, weights=tokens.trains[at], minlength=len(keys))]


def _ask_longer(depth: int) -> Callable[[Tokens, dict], Iterator[tuple]]:
    """Words behind two or more, where the answers to pairs let them occur twice."""

    def of(tokens: Tokens, answers: dict) -> Iterator[tuple]:
        for level, sent in tokens.levels(depth, answers):
            if level.k >= 2:
                keys, at, inverse = tokens.asked(level.run, sent)
                yield level.k, keys, [np.bincount(inverse, weights=tokens.trains[at], minlength=len(keys))]

    return of


def _ask_contexts(depth: int, n: int, kinds: int) -> Callable[[Tokens, dict], Iterator[tuple]]:
    """Each context's summed log ratios, counts less one, and size."""

    def of(tokens: Tokens, answers: dict) -> Iterator[tuple]:
        suffix = np.zeros(0)
        for level, _ in tokens.levels(depth, answers):
            if not level.k:
                suffix = _root(level.counts, n, kinds)
                continue
            keys, at, inverse = tokens.asked(level.context, level.states > 0)
            size, more, q = level.states[at], np.maximum(level.counts[at] - 1, 0), suffix[at]
            suffix[at] = (more + q) / size
            twice = np.flatnonzero((more > 0) & tokens.trains[at])
            q, more, of_key = q[twice], more[twice], inverse[twice]
            sums = [np.bincount(of_key, weights=np.rint(x), minlength=len(keys)) for x in (np.log((more + q) / q) * NATS, more / (more + 1) * SHARE)]
            sizes = np.zeros(len(keys), np.int64)
            sizes[of_key] = size[twice]
            yield CONTEXT + level.k, keys, [*sums, sizes]

    return of


def _root(counts: np.ndarray, tokens: int, kinds: int) -> np.ndarray:
    """Probabilities without a context: Witten-Bell mass for a word never seen."""
    return np.where(counts > 0, counts, kinds) / (tokens + kinds) if tokens else np.ones(len(counts))


# -- scoring --------------------------------------------------------------------------

_RESULT = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def _scored(batches: DataFrame, depth: int, width: int, tokens: int, kinds: int) -> DataFrame:
    schema = pa.schema(_RESULT)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(it):
            texts, answers = Tokens(row, 64 - width), _by_level(row)
            base = p = known = np.zeros(0)
            for level, _ in texts.levels(depth, answers):
                if not level.k:
                    base = (level.counts + 1) / (tokens + kinds + 1)
                    p, known = _root(level.counts, tokens, kinds), (level.counts > 0).astype(np.int64)
                    continue
                rest = texts.answered(level.context, level.states > 0, answers.get(CONTEXT + level.k, NOTHING))
                at = np.flatnonzero(rest)
                p[at] = (np.maximum(level.counts[at] - 1, 0) + rest[at] * p[at]) / level.states[at]
            sums = [np.add.reduceat(x, texts.starts) for x in (known, np.log10(base), np.log10(p))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(unpacked(row["docs"], "<i8"), mask=unpacked(row["missing"], "u1") == 1),
                    pa.array(texts.held == 1),
                    pa.array(texts.lengths),
                    pa.array(sums[0]),
                    pa.array(np.full(len(texts.lengths), tokens, np.int64)),
                    pa.array(sums[1]),
                    pa.array(sums[2]),
                ],
                schema=schema,
            )

    return batches.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, *, id: str = "doc_id", text: str = "text", held: Column | None = None, depth: int = DEPTH, gain: float = GAIN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for
    each row of docs; learned from the rows that are not held out."""
    if depth < 1:
        raise ValueError("depth must be 1 or more")
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), (held if held is not None else held_out(F.col(id))).alias("held"))
    tables = Tables(docs.sparkSession, 2 * rows.rdd.getNumPartitions())
    batches = tables.put(batches_of(rows))
    size, n = batches.agg(F.sum("n_tokens"), F.sum("n_trained")).first()
    size, n = size or 0, n or 0
    bits = max(3, math.ceil(math.log2(max(1, size / SHARD_KEYS))))
    width = min(64, max(1, size).bit_length() + SPARE_BITS)
    asked = lambda of, *answers: tables.put_answers(summed(requests(with_answers(batches, list(answers), _ANSWERED) if answers else batches, of, bits, width), gain))
    first = asked(_ask_first)
    kinds = first.where("level = 0").agg(F.sum("kinds")).first()[0] or 0
    # only the words behind one say which longer runs to ask about
    longer = asked(_ask_longer(depth), first.where("level = 1"))
    contexts = asked(_ask_contexts(depth, n, kinds), first, longer)
    out = stored(_scored(with_answers(batches, [first, longer, contexts], _ANSWERED), depth, width, n, kinds))
    tables.drop()
    return out
