"""Line dedup by a sharded minimal perfect hash.

1. Every document emits the 128-bit hash of each of its distinct eligible line keys.
2. All distinct line hashes are dealt to shards by their bits. In each shard a minimal
   perfect hash (cascaded bit vectors with rank) maps every hash to a slot of three
   compact arrays: 64-bit fingerprint, document count, last document.
3. Documents probe the arrays: a line goes if the fingerprint agrees, the count reaches
   ``min_docs`` and the last document is another one. Probes travel to their shard, never
   to other lines; a shard that many probes meet is opened in as many streams as its
   measured load asks for, so a line of a third of all documents is no hot key. Only
   decisions travel back, and they join the texts by doc_id.

Defined cases: a null or empty text is one empty line; very long texts are probed whole;
a row without doc_id can be no keeper, so it is neither counted nor changed; repeated rows
of a doc_id are one document and share its fate; of equal lines inside a document all go or
all stay; an empty table gives an empty one; a column of docs named like ``into``
(case aside) is replaced, other extra columns come along whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import as_bytes, discard, fresh, stored

MIN_CODE_POINTS, MIN_DOCS = 20, 3
KEYS_A_SHARD = 1 << 18
#: Probes of a shard that one stream answers; beyond, the shard is opened in several.
PROBES_A_STREAM = 1 << 21
_SPACE = b" \t\n\x0b\x0c\r"
_GAMMA = 2.0


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def eligible(key: bytes, least: int) -> bool:
    return len(key) >= least and code_points(key) >= least


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


# -- minimal perfect hash -------------------------------------------------------------


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    """A fresh 64-bit hash of h for each level (splitmix64 finaliser)."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps each of n distinct 64-bit keys to its own slot of [0, n); any other key to
    some slot or to -1. A level's bit vector marks places that one key alone takes; a
    slot is the number of marks before it (a count for each word of 64 bits)."""

    def __init__(self, sizes: list[int], words: list[np.ndarray]):
        self.sizes, self.words = sizes, words
        self.ranks, at = [], 0
        for w in words:
            n = np.bitwise_count(w).astype(np.int64)
            self.ranks.append((at + np.cumsum(n) - n).astype(np.int64))
            at += int(n.sum())
        self.n = at

    @staticmethod
    def _packed(marks: np.ndarray) -> np.ndarray:
        raw = np.packbits(marks, bitorder="little").tobytes()
        return np.frombuffer(raw + bytes(-len(raw) % 8), "<u8")

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, left, level = [], [], keys, 0
        while len(left):
            m = max(8, int(len(left) * _GAMMA))
            at = (_mix(left, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            words.append(cls._packed(alone))
            left, level = left[~alone[at]], level + 1
            if level > 64:
                raise ValueError("keys of a minimal perfect hash must be distinct")
        return cls(sizes, words)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        todo, one = np.arange(len(keys)), np.uint64(1)
        for level, (m, words) in enumerate(zip(self.sizes, self.words)):
            if not len(todo):
                break
            at = _mix(keys[todo], level) % np.uint64(m)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit & one) == one
            before = np.bitwise_count(words[word[hit]] & ((one << bit[hit]) - one))
            out[todo[hit]] = self.ranks[level][word[hit]] + before
            todo = todo[~hit]
        return out

    def dump(self) -> tuple[list[int], bytes]:
        return self.sizes, b"".join(w.tobytes() for w in self.words)

    @classmethod
    def load(cls, sizes: list[int], packed: bytes) -> PerfectHash:
        words, at = [], 0
        for m in sizes:
            n = (m + 63) // 64
            words.append(np.frombuffer(packed, "<u8", n, 8 * at))
            at += n
        return cls(list(sizes), words)


class Shard:
    """The arrays of one shard; probe() tells which hashes a document must lose."""

    def __init__(self, sizes, bits, marks, counts, lasts):
        self.hash = PerfectHash.load(sizes, bits)
        self.marks = np.frombuffer(marks, np.uint64)
        self.counts = np.frombuffer(counts, np.uint32)
        self.lasts = np.frombuffer(lasts, np.int64)

    def lost(self, key: np.ndarray, mark: np.ndarray, doc: np.ndarray, min_docs: int) -> np.ndarray:
        slot = self.hash.slots(key)
        safe = np.where(slot < 0, 0, slot)
        return (slot >= 0) & (self.marks[safe] == mark) & (self.counts[safe] >= min_docs) & (self.lasts[safe] != doc)


_SHARD_DDL = "shard int, load long, sizes array<int>, bits binary, marks binary, counts binary, lasts binary"


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    key, mark = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
    # two keys may share h1 (never h1 and h2): the hash then keys on both halves
    phf = PerfectHash.build(key ^ _mix(mark, 77))
    slot = phf.slots(key ^ _mix(mark, 77))
    marks, counts, lasts = np.empty(len(slot), np.uint64), np.empty(len(slot), np.uint32), np.empty(len(slot), np.int64)
    marks[slot], counts[slot], lasts[slot] = mark, np.minimum(pdf["n"], 0xFFFFFFFF), pdf["last"]
    sizes, bits = phf.dump()
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "load": [int(pdf["n"].sum())], "sizes": [sizes], "bits": [bits], "marks": [marks.tobytes()], "counts": [counts.tobytes()], "lasts": [lasts.tobytes()]})


# -- steps ----------------------------------------------------------------------------


def _keys_of(text: bytes, least: int) -> set[bytes]:
    return {key_hash(k) for k in map(line_key, text.split(b"\n")) if eligible(k, least)}


def line_hashes(docs: DataFrame, least: int, id: str, text: str) -> DataFrame:
    """(doc, h1, h2): a row for each distinct eligible line key of each row of docs."""
    schema = pa.schema([("doc", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, held = [], []
            for doc, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if doc is not None and t:
                    keys = _keys_of(t, least)
                    ids += [doc] * len(keys)
                    held += keys
            if held:
                both = np.frombuffer(b"".join(held), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], schema=schema)

    return docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(run, "doc long, h1 long, h2 long")


def index_of(hashes: DataFrame, keys_a_shard: int = KEYS_A_SHARD) -> tuple[DataFrame, int]:
    """The sharded index over all distinct hashes, a row of arrays for each shard, and the
    number of shards. A document counts once for a line, however many rows it has."""
    lines = stored(hashes.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("last")))
    shards = -(-lines.count() // keys_a_shard) or 1
    dealt = lines.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))
    return stored(dealt.groupBy("shard").applyInPandas(_build_shard, _SHARD_DDL)), shards


def _kept(text: bytes | None, lost: set[bytes], least: int) -> tuple[int, int, bytes]:
    """(lines, lines dropped, the other lines joined)."""
    lines = (text or b"").split(b"\n")
    if not lost:
        return len(lines), 0, text or b""
    stay = [x for x in lines if not (eligible(k := line_key(x), least) and key_hash(k) in lost)]
    return len(lines), len(lines) - len(stay), b"\n".join(stay)


_RESULT = "struct<n_lines:bigint,n_dropped:bigint,kept:string>"


def lost_lines(hashes: DataFrame, index: DataFrame, n_shards: int, min_docs: int, probes_a_stream: int = PROBES_A_STREAM) -> DataFrame:
    """(doc, digest): the hashes that a document must lose, by probing the shards.

    Rows of a stream: first the arrays of its shard, then the hashes that probe them."""
    fields = ["sizes", "bits", "marks", "counts", "lasts"]
    none = [F.lit(None).cast(index.schema[f].dataType).alias(f) for f in fields]
    streams = index.select("shard", F.ceil(F.col("load") / probes_a_stream).cast("int").alias("streams"))
    null = F.lit(None).cast("long")
    arrays = index.join(streams, "shard").withColumn("stream", F.explode(F.sequence(F.lit(0), F.col("streams") - 1)))
    arrays = arrays.select("shard", "stream", F.lit(0).alias("kind"), null.alias("doc"), null.alias("h1"), null.alias("h2"), *fields)
    probes = hashes.withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("int")).join(streams, "shard")
    probes = probes.select("shard", F.pmod(F.hash("doc"), F.col("streams")).alias("stream"), F.lit(1).alias("kind"), "doc", "h1", "h2", *none)
    dealt = arrays.unionByName(probes).repartition("shard", "stream").sortWithinPartitions("shard", "stream", "kind")
    schema = pa.schema([("doc", pa.int64()), ("digest", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now = None, None
        for batch in it:
            shards, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0) | (kinds[1:] == 0)) + 1), len(shards)]
            for a, b in zip(cuts, cuts[1:]):
                if b <= a:
                    continue
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    row = part.select(fields).to_pylist()[0]
                    shard, now = int(shards[a]), Shard(*(row[f] for f in fields))
                elif shard == int(shards[a]):
                    h1, h2 = (part.column(c).to_numpy() for c in ("h1", "h2"))
                    mark, doc = h2.view(np.uint64), part.column("doc").to_numpy()
                    hit = np.flatnonzero(now.lost(h1.view(np.uint64) ^ _mix(mark, 77), mark, doc, min_docs))
                    if len(hit):
                        both = np.stack([h1[hit], h2[hit]], 1).astype("<i8")
                        yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array([x.tobytes() for x in both], pa.binary())], schema=schema)

    return dealt.mapInArrow(run, "doc long, digest binary")


def dedup_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_code_points: int = MIN_CODE_POINTS, keys_a_shard: int = KEYS_A_SHARD, probes_a_stream: int = PROBES_A_STREAM, into: str = "line_dedup") -> DataFrame:
    """docs with a struct column ``into``: n_lines, n_dropped, kept (the text left)."""
    hashes = stored(line_hashes(docs, min_code_points, id, text))
    index, n_shards = index_of(hashes, keys_a_shard)
    lost_at, id_at = fresh(docs, "_lost"), fresh(docs, "_lost_doc")
    lost = stored(lost_lines(hashes, index, n_shards, min_docs, probes_a_stream).groupBy(F.col("doc").alias(id_at)).agg(F.collect_set("digest").alias(lost_at)))
    discard(hashes)
    discard(index)

    def drop(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = [_kept(t, set(g or ()), min_code_points) for t, g in zip(as_bytes(texts), gone.to_pylist())]
        n, dropped, kept = zip(*out) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n_lines", "n_dropped", "kept"])

    drop.__annotations__ = {"texts": pa.Array, "gone": pa.Array, "return": pa.Array}
    # both sides grow with the documents: one plan at every size
    joined = docs.join(lost.hint("merge"), docs[id].cast("long") == lost[id_at], "left")
    return joined.withColumn(into, F.arrow_udf(drop, _RESULT).asNondeterministic()(F.col(text), F.col(lost_at))).drop(lost_at, id_at)


def keep_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with repeated lines gone from their texts and the length column brought up
    to date; a document that loses every line stays with an empty text."""
    at = fresh(docs, "_lines")
    out = dedup_lines(docs, id=id, text=text, into=at)
    changed = F.col(at)["n_dropped"] > 0
    new = {text: F.when(changed, F.col(at)["kept"]).otherwise(F.col(text))}
    if length in docs.columns:
        new[length] = F.when(changed, F.length(F.col(at)["kept"]).cast(docs.schema[length].dataType)).otherwise(F.col(length))
    return out.withColumns(new).drop(at).select(*docs.columns)


def sha256_hex(texts: list[bytes | None]) -> list[list]:
    return [[hashlib.sha256(t or b"").hexdigest() for t in texts]]
