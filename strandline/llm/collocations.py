"""Phrase collocations by a minimal perfect hash over Apriori-safe candidates.

1. Documents are packed in batches: each language's distinct words, and the texts as numbers
   into them. Everything after this reads the batches, not texts.
2. Words are counted in Spark; those seen ``least`` times get ids, which go back to the
   batches that hold them.
3. Phrases grow by a word a level. A candidate is a pair of counted phrases that overlap in
   all but their outer words: a phrase can't be frequent unless both are, so none is lost,
   and the pair of their ids is an exact key. A batch sends its distinct candidates and
   counts to shards by leading hash bits.
4. A shard builds a minimal perfect hash over its candidates, with the keys stored by slot so
   that every probe is verified. Slices of requests are counted by ``bincount`` into arrays
   of slots, and the arrays are summed as a tree. Slots that reach ``least`` become ids; they
   and their counts are answered to the batches that asked.
5. The first batch that holds a frequent phrase reports it: its words, and the counts of the
   parts of each cut, read by slot from the levels below.
6. A phrase goes if a phrase longer by a word, which holds it, has ``cover`` percent of its
   count; longer ones have no more, so these decide. Ranks within a language are cut in two
   steps, first among rows of a partition, then among what those leave.

Nothing grows with the corpus on the driver or in a broadcast. A key's rows are at most one
for each batch. Slices are at most batches times shards and at most one for each key sent:
from a few hundred GB of text on they hold a key or two each.

Making the frame runs jobs; batches and answers stand as bucketed tables until they end. Defined
cases: a null or empty text has no words; a null language is ``und``; very long texts go
whole into one batch; ties of cuts go to the shorter first part, ties of ranks to the lesser
phrase in byte order; repeated rows count each; an empty table gives an empty one; extra
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.batch_tables import Tables, with_answers
from strandline.llm.line_dedup import PerfectHash
from strandline.llm.suffix_tree_lm import packed, unpacked
from strandline.llm.text import as_bytes, discard, stored

MOST_WORDS, LEAST, COVER, TOP = 4, 30, 80, 2000
SCALE = 2_000_000
BATCH_BYTES, SHARD_KEYS, RUN_KEYS = 8 << 20, 1_500_000, 1 << 18
#: Ends of pieces become line ends, tabs blanks; b"." is then free to mark the ends.
_CUTS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_END = b"."
_LEVEL_BIT, _SHARD_BIT = 58, 32


# -- batches --------------------------------------------------------------------------

_BATCH_DDL = "batch long, langs array<string>, lang_of binary, vocab binary, tokens binary, n_tokens long"


def batches_of(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """A row for each batch of texts: token 0 ends a piece, the others number the words."""
    schema = pa.schema([("batch", pa.int64()), ("langs", pa.list_(pa.string())), ("lang_of", pa.binary()), ("vocab", pa.binary()), ("tokens", pa.binary()), ("n_tokens", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 24, 0
        held, words, lang_of, numbers, size = {}, [_END], [0], [], 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(numbers)
            row = (first + made, list(held), packed(np.array(lang_of, "<u4")), pa.compress(b"\n".join(words), codec="zstd", asbytes=True), packed(tokens.astype("<u4")), len(tokens))
            # the length of what was compressed stands before it
            row = (*row[:3], len(b"\n".join(words)).to_bytes(8, "little") + row[3], *row[4:])
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        for batch in it:
            for name, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if not t:
                    continue
                at, own = held.setdefault(name, (len(held), {_END: 0}))
                tokens = t.lower().translate(_CUTS).replace(b"\n", b" . ").split()
                tokens.append(_END)
                for w in set(tokens).difference(own):
                    own[w] = len(words)
                    words.append(w)
                    lang_of.append(at)
                numbers.append(np.fromiter(map(own.__getitem__, tokens), np.uint32, len(tokens)))
                size += len(t)
                if size >= BATCH_BYTES:
                    yield flush()
                    made, held, words, lang_of, numbers, size = made + 1, {}, [_END], [0], [], 0
        if numbers:
            yield flush()

    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).mapInArrow(run, _BATCH_DDL)


@dataclass
class Level:
    """Phrases of ``words`` words in a batch. ``at``: for each token the place of the phrase
    that starts there, or -1; then each place's id, count, and whether this batch reports it."""

    words: int
    at: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    mine: np.ndarray


@dataclass
class Asked:
    """A batch's distinct candidates in the order of their hashes. ``of``: for each token with
    a candidate (``where``) its place among them."""

    where: np.ndarray
    of: np.ndarray
    hashes: np.ndarray
    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray


def mixed(left: np.ndarray, right: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of pairs of ids."""
    x = (left.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32)) ^ right.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def candidates(level: Level) -> Asked:
    """Pairs of phrases of a level, a word apart, that both are frequent."""
    where = np.flatnonzero((level.at[:-1] >= 0) & (level.at[1:] >= 0))
    size = max(1, len(level.ids))
    pairs, of, counts = np.unique(level.at[where].astype(np.int64) * size + level.at[where + 1], return_inverse=True, return_counts=True)
    left, right = level.ids[pairs // size], level.ids[pairs % size]
    hashes = mixed(left, right)
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Asked(where, place[of], hashes[order], left[order], right[order], counts[order])


def _tables(row: dict, level: int) -> list[np.ndarray]:
    """(place asked about, id, count, mine) of all answers to a level."""
    parts = [x for x in row["answers"] if x["level"] == level]
    return [np.concatenate([unpacked(x[c], kind) for x in parts] or [np.zeros(0, kind)]) for c, kind in (("places", "<i4"), ("ids", "<i8"), ("counts", "<i8"), ("mine", "u1"))]


def climbed(row: dict, words: int) -> list[Level]:
    """The levels of a batch up to phrases of so many words, as far as answers go."""
    tokens = unpacked(row["tokens"], "<u4")
    places, *table = _tables(row, 1)
    look = np.full(int(tokens.max()) + 1, -1, np.int32)
    look[places] = np.arange(len(places))
    out = [Level(1, look[tokens], *table)]
    for k in range(2, words + 1):
        asked = candidates(out[-1])
        places, *table = _tables(row, k)
        look = np.full(len(asked.hashes), -1, np.int32)
        look[places] = np.arange(len(places))
        at = np.full(len(tokens), -1, np.int32)
        at[asked.where] = look[asked.of]
        out.append(Level(k, at, *table))
    return out


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in it:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _vocabulary(row: dict) -> list[bytes]:
    raw = row["vocab"]
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True).split(b"\n")


# -- words ----------------------------------------------------------------------------

_ANSWER = pa.schema([("batch", pa.int64()), ("level", pa.int32()), ("places", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("mine", pa.binary())])
_ANSWER_DDL = "batch long, level int, places binary, ids binary, counts binary, mine binary"
_ANSWERED = ["level", "places", "ids", "counts", "mine"]


def word_counts(batches: DataFrame) -> DataFrame:
    """(batch, place, lang, word, n) of each distinct word of each batch."""
    schema = pa.schema([("batch", pa.int64()), ("place", pa.int32()), ("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(it):
            words, tokens = _vocabulary(row), unpacked(row["tokens"], "<u4")
            n, langs = np.bincount(tokens, minlength=len(words)), pa.array(row["langs"])
            columns = [pa.array(np.full(len(words), row["batch"], np.int64)), pa.array(np.arange(len(words), dtype=np.int32)), langs.take(pa.array(unpacked(row["lang_of"], "<u4").astype(np.int32))), pa.array(words, pa.binary()), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([c.slice(1) for c in columns], schema=schema)

    return batches.mapInArrow(run, "batch long, place int, lang string, word binary, n long")


def word_answers(words: DataFrame, frequent: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        blobs = [packed(table.column(c).to_numpy().astype(kind)) for c, kind in (("place", "<i4"), ("id", "<i8"), ("f", "<i8"))]
        row = [table.column("batch")[0].as_py(), 1, *blobs, packed(np.zeros(table.num_rows, "u1"))]
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ANSWER)], schema=_ANSWER)

    held = words.join(frequent.hint("merge"), ["lang", "word"]).select("batch", "place", "id", "f")
    return held.groupBy("batch").applyInArrow(run, _ANSWER_DDL)


# -- phrases --------------------------------------------------------------------------

_SLICE = pa.schema([("shard", pa.int32()), ("batch", pa.int64()), ("first", pa.int32()), ("left", pa.binary()), ("right", pa.binary()), ("counts", pa.binary())])


def requests(batches: DataFrame, words: int, bits: int) -> DataFrame:
    """What each batch asks of each shard about its candidates of so many words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(it):
            asked = candidates(climbed(row, words - 1)[-1])
            cuts = np.searchsorted(asked.hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() if bits else [0]
            parts = [(s, a, b) for s, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(asked.hashes)])) if b > a]
            blobs = [[packed(x[a:b].astype("<i8")) for _, a, b in parts] for x in (asked.left, asked.right, asked.counts)]
            columns = [[s for s, _, _ in parts], [row["batch"]] * len(parts), [a for _, a, _ in parts], *blobs]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SLICE)], schema=_SLICE)

    return batches.mapInArrow(run, "shard int, batch long, first int, left binary, right binary, counts binary")


class Candidates:
    """Distinct pairs of ids by slot of a minimal perfect hash, with the pairs stored."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        for self.seed in range(16):
            hashes, first = np.unique(mixed(left, right, self.seed), return_index=True)
            self.hash = PerfectHash.build(hashes)
            slots = self.hash.slots(hashes)
            self.left, self.right = np.empty(len(slots), np.int64), np.empty(len(slots), np.int64)
            self.left[slots], self.right[slots] = left[first], right[first]
            if (self.slots(left, right) >= 0).all():
                return
        raise ValueError("pairs of ids collide under every seed")

    def slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Each pair's slot; -1 where the stored pair is another."""
        out = self.hash.slots(mixed(left, right, self.seed))
        safe = np.maximum(out, 0)
        return np.where((out >= 0) & (self.left[safe] == left) & (self.right[safe] == right), out, -1) if self.hash.n else np.full(len(left), -1)


def tree_sum(arrays: Iterator[np.ndarray], size: int) -> np.ndarray:
    """Sum of arrays, pairs of equal height first: as many are held as the tree is high."""
    held: list[tuple[int, np.ndarray]] = []
    for x in arrays:
        height = 0
        while held and held[-1][0] == height:
            x, height = held.pop()[1] + x, height + 1
        held.append((height, x))
    return sum((x for _, x in held), np.zeros(size, np.int64))


def counting(words: int, least: int) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _counted(table, words, least)


def _counted(table: pa.Table, words: int, least: int) -> pa.Table:
    """A shard's answers: of each request the places that are frequent."""
    shard = table.column("shard")[0].as_py()
    left, right, n = ([unpacked(x.as_py(), "<i8") for x in table.column(c)] for c in ("left", "right", "counts"))
    ends = np.cumsum([len(x) for x in n])
    left, right, n = (np.concatenate(x) for x in (left, right, n))
    known = Candidates(left, right)
    slots = known.slots(left, right)
    runs = (np.bincount(slots[a : a + RUN_KEYS], weights=n[a : a + RUN_KEYS], minlength=known.hash.n).astype(np.int64) for a in range(0, len(n), RUN_KEYS))
    totals = tree_sum(runs, known.hash.n)
    hits = np.flatnonzero(totals[slots] >= least)
    mine = np.zeros(len(n), np.uint8)
    mine[hits[np.unique(slots[hits], return_index=True)[1]]] = 1
    ids = slots + (words << _LEVEL_BIT) + (shard << _SHARD_BIT)
    edges = np.searchsorted(hits, [0, *ends])
    out = []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            at = hits[a:b]
            start = 0 if not i else int(ends[i - 1])
            places = at - start + table.column("first")[i].as_py()
            out.append((table.column("batch")[i].as_py(), words, packed(places.astype("<i4")), packed(ids[at]), packed(totals[slots[at]]), packed(mine[at])))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(_ANSWER), _ANSWER)], schema=_ANSWER)


def reported(batches: DataFrame, most_words: int) -> DataFrame:
    """(lang, phrase, words, id, left, right, a, firsts, rests): every frequent phrase once,
    with the counts of both parts of each cut."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("words", pa.int32()), ("id", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("a", pa.int64()), ("firsts", pa.list_(pa.int64())), ("rests", pa.list_(pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(it):
            levels, words, tokens = climbed(row, most_words), _vocabulary(row), unpacked(row["tokens"], "<u4")
            lang_of = unpacked(row["lang_of"], "<u4")
            count = lambda k, at: levels[k - 1].counts[levels[k - 1].at[at]]
            for level in levels[1:]:
                k, used = level.words, np.flatnonzero(level.at >= 0)
                first = np.zeros(len(level.ids), np.int64)
                first[level.at[used[::-1]]] = used[::-1]
                own = np.flatnonzero(level.mine)
                at, below = first[own], levels[k - 2]
                firsts = np.stack([count(j, at) for j in range(1, k)], axis=1)
                rests = np.stack([count(k - j, at + j) for j in range(1, k)], axis=1)
                columns = [[row["langs"][x] for x in lang_of[tokens[at]]], [b" ".join([words[t] for t in tokens[i : i + k]]) for i in at.tolist()], np.full(len(at), k, np.int32), level.ids[own], below.ids[below.at[at]], below.ids[below.at[at + 1]], level.counts[own], firsts.tolist(), rests.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return batches.mapInArrow(run, "lang string, phrase binary, words int, id long, left long, right long, a long, firsts array<bigint>, rests array<bigint>")


def ranked(phrases: DataFrame, totals: DataFrame, cover: int, top: int) -> DataFrame:
    wide = lambda x: x.cast("decimal(38,0)")
    scores = F.expr(f"transform(firsts, (l, i) -> named_struct('score', (cast(a as decimal(38,0)) * {SCALE}) div (cast(l as decimal(38,0)) + rests[i]), 'k', i, 'l', l, 'r', rests[i]))")
    longer = phrases.where("words > 2").select(F.explode(F.array_distinct(F.array("left", "right"))).alias("id"), "a").groupBy("id").agg(F.max("a").alias("longer"))
    open_ = phrases.join(longer.hint("merge"), "id", "left").where(F.col("longer").isNull() | (wide(F.col("longer")) * 100 < wide(F.col("a")) * cover))
    cut = open_.withColumn("cut", F.array_min(scores)).select("lang", F.col("phrase").cast("string").alias("phrase"), "a", F.col("cut")["l"].alias("l"), F.col("cut")["r"].alias("r"), F.col("cut")["score"].alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = cut.withColumn("part", F.spark_partition_id())
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part", "rank")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, *, lang: str = "lang", text: str = "text", most_words: int = MOST_WORDS, least: int = LEAST, cover: int = COVER, top: int = TOP, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language."""
    tables = Tables(docs.sparkSession, 2 * docs.rdd.getNumPartitions())
    batches = tables.put(batches_of(docs, lang, text))
    size = batches.agg(F.sum("n_tokens")).first()[0] or 0
    bits = max(0, -(-size // shard_keys) - 1).bit_length()
    words = stored(word_counts(batches))
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")))
    sums = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    frequent = stored(sums.withColumn("id", F.monotonically_increasing_id()))
    answers = [tables.put_answers(word_answers(words, frequent))]
    discard(words)
    discard(frequent)
    for k in range(2, most_words + 1):
        asked = requests(with_answers(batches, answers, _ANSWERED), k, bits)
        answers.append(tables.put_answers(asked.groupBy("shard").applyInArrow(counting(k, least), _ANSWER_DDL)))
    phrases = stored(reported(with_answers(batches, answers, _ANSWERED), most_words))
    tables.drop()
    return ranked(phrases, totals, cover, top)
