"""Near duplicates by min-max hashing.

1. A text is its set of distinct four-word shingles; equal sets collapse to one leaf. Each
   permutation of the shingles gives two values of a leaf's signature, its minimum and its
   maximum. Either is equal for two sets with the chance of their similarity, so half the
   hash evaluations of MinHash make the same number of unbiased values, and since the two
   rarely fail together, their mean varies less.
2. ``ROWS`` minima of different permutations make a band, or ``ROWS`` maxima. Leaves with a
   band in common are candidates. Sets of a similarity of 0.8 share none of the 20 bands
   with chance 6e-7.
3. In each band's bucket every leaf is checked against the least leaf: one link a leaf, never
   all pairs. The check counts shared shingles of the full sets. Components follow.
4. Where leaves of different components still share a bucket, those outside its largest
   component meet the others in tiles. A tile compares signatures: pairs of one component,
   pairs that an earlier band brings together, and pairs under ``least`` equal values (five
   deviations below the mean of 0.8) go. All others are checked on their full sets: pair by
   pair where they are few, and where most pairs of a square of leaves are left, all of the
   square at once, of which a spanning forest of links is kept.
   Buckets above ``most`` leaves are first taken apart by a second band.
5. Checked links make the components; the least doc_id names each.

Making the frame runs jobs. Defined cases: a null or empty text, or one without words, has
the empty set and links with nothing, not even another; under four words the whole sequence
is one shingle; very long texts count whole; repeated rows and equal texts share a
component; a row without doc_id has a size and is kept, but belongs to no component and
links nothing; an empty table gives an empty one; extra columns, whatever their names, are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.components import components
from strandline.llm.similar import set_number, shingle_set
from strandline.llm.simhash import forest, whole_tasks
from strandline.llm.text import as_bytes, discard, stored

WIDTH, PERCENT = 4, 80
PERMUTATIONS, ROWS = 30, 3
VALUES = 2 * PERMUTATIONS
BANDS = VALUES // ROWS
LEAST = 33
CHUNK, MOST = 2048, 20_000
BLOCK_ROWS, SQUARE, COLUMNS = 20_000, 256, 8192
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
#: A permutation of 64-bit hashes: multiply by an odd number, fold, multiply again.
_FIRST, _SECOND = (_RANDOM.integers(0, 1 << 64, (PERMUTATIONS, 1), np.uint64) | np.uint64(1) for _ in range(2))


def signature(s: np.ndarray) -> np.ndarray:
    """The leading 32 bits of a set's minima, then of its maxima."""
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(s), 1 << 13):
        x = s[at : at + (1 << 13)] * _FIRST
        x ^= x >> np.uint64(32)
        x *= _SECOND
        low, high = np.minimum(low, x.min(axis=1)), np.maximum(high, x.max(axis=1))
    return (np.concatenate([low, high]) >> np.uint64(32)).astype("<u4")


def band_keys(signs: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature (a row of VALUES)."""
    parts = signs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    x = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        x = (x ^ parts[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("signs", pa.binary())])


def signatures(docs: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """(doc_id, n_shingles, node, signs); node stands for the set, null for the empty one."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sizes, nodes, signs = [], [], []
            for t in as_bytes(batch.column(1)):
                s = shingle_set(t, width)
                sizes.append(len(s))
                nodes.append(set_number(s) if len(s) else None)
                signs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip((sizes, nodes, signs), list(_SIGNED)[1:]))], schema=_SIGNED)

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, node long, signs binary")


def bucketed(leaves: DataFrame) -> DataFrame:
    """(key, band, node): the bucket of each band of each leaf."""
    schema = pa.schema([("key", pa.int64()), ("band", pa.int32()), ("node", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, VALUES)
            bands = np.tile(np.arange(BANDS, dtype=np.int32), len(signs))
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(signs).ravel()), pa.array(bands), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], schema=schema)

    return leaves.select("node", "signs").mapInArrow(run, "key long, band int, node long")


# -- the exact check ---------------------------------------------------------------------


def full_sets(docs: DataFrame, owners: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """(node, shingles) of the texts of owners (_owner), each set once."""
    rows = docs.select(F.col(id).cast("long").alias("_owner"), F.col(text).alias("_text")).join(owners.hint("merge"), "_owner", "left_semi")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 64):
                found = [s for t in as_bytes(batch.column(0).slice(at, 64)) if len(s := shingle_set(t, width))]
                yield pa.RecordBatch.from_arrays([pa.array([set_number(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "shingles"])

    return rows.select("_text").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def _linked(percent: int):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out, last, x = [], None, np.zeros(0, np.uint64)
        for p, q in zip(a, b):
            p, q = p.as_py(), np.frombuffer(q.as_buffer(), np.uint64)
            if p is not last and p != last:
                last, x = p, np.frombuffer(p, np.uint64)
            at = np.minimum(np.searchsorted(x, q), len(x) - 1)
            both = int((x[at] == q).sum())
            out.append(100 * both >= percent * (len(x) + len(q) - both))
        return pa.array(out, pa.bool_())

    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "boolean").asNondeterministic()


def checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough. A set travels once for each pair
    that has it as v."""
    x, y = sets.toDF("u", "x"), sets.toDF("v", "y")
    return pairs.join(y.hint("merge"), "v").join(x.hint("merge"), "u").where(_linked(percent)("x", "y")).select("u", "v")


# -- what the first links leave ------------------------------------------------------------

_TILE = ["key", "a", "b"]


_FOUND_DDL = "tile long, side int, u long, v long"


def _square(signs: list[np.ndarray], labels: list[np.ndarray], band: int, least: int) -> np.ndarray:
    """Which leaves of two lists the full sets must decide about."""
    same = signs[0][:, None, :] == signs[1][None, :, :]
    own = (same.sum(axis=2, dtype=np.int16) >= least) & (labels[0][:, None] != labels[1][None, :])
    if band:
        own &= ~same[:, :, : ROWS * band].reshape(*own.shape, band, ROWS).all(axis=3).any(axis=2)
    return own


def _decisions(rows: pd.DataFrame, least: int, square: int) -> Iterator[pd.DataFrame]:
    """Of whole tiles: pairs (u, v) to check; where a square of leaves has more pairs than
    twice its leaves, its leaves instead, to be checked together."""
    none = pd.array([], "Int64")
    signs = np.frombuffer(b"".join(rows["signs"]), "<u4").reshape(-1, VALUES)
    side, node, label, band = (rows[c].to_numpy() for c in ("side", "node", "label", "band"))
    key = [rows[c].to_numpy() for c in _TILE]
    cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in key], axis=0)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
        one, two = (lo + np.flatnonzero(side[lo:hi] == x) for x in (0, 1))
        for a in range(0, len(one), square):
            for b in range(0, len(two), square):
                at, to = one[a : a + square], two[b : b + square]
                own = _square([signs[at], signs[to]], [label[at], label[to]], int(band[lo]), least)
                i, j = np.nonzero(own)
                if not len(i):
                    continue
                first, second = at[np.unique(i)], to[np.unique(j)]
                if len(i) <= 2 * (len(first) + len(second)):
                    u, v = node[at[i]], node[to[j]]
                    yield pd.DataFrame({"tile": pd.array([None] * len(u), "Int64"), "side": 0, "u": np.minimum(u, v), "v": np.maximum(u, v)})
                else:
                    tile = int(np.int64(hash((int(key[0][lo]), int(key[1][lo]), int(key[2][lo]), a, b))))
                    both = np.concatenate([first, second])
                    yield pd.DataFrame({"tile": pd.array([tile] * len(both), "Int64"), "side": np.repeat([0, 1], [len(first), len(second)]), "u": node[both], "v": pd.array([None] * len(both), "Int64")})
    yield pd.DataFrame({"tile": none, "side": np.zeros(0, np.int32), "u": none, "v": none})


def _links_of_square(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A spanning forest of the links between both sides: shared shingles of all pairs come
    from products of incidence matrices over the shingles that two leaves have."""
    sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
    side, sizes = pdf["side"].to_numpy(), np.array([len(x) for x in sets])
    known, node = np.unique(pdf["u"].to_numpy(), return_inverse=True)
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, often = np.repeat(np.arange(len(sets)), sizes), n[column] > 1
    column = (np.cumsum(n > 1) - 1)[column[often]]
    owner = owner[often]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    shared = np.zeros((len(one), len(two)), np.int64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[lo:hi], column[lo:hi] - first] = 1
        shared += (held[one] @ held[two].T).astype(np.int64)
    i, j = np.nonzero(100 * shared >= percent * (sizes[one][:, None] + sizes[two][None, :] - shared))
    label = forest(len(known), iter([(node[one[i]], node[two[j]])]))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pd.DataFrame({"u": known[label[moved]], "v": known[moved]})


def tiled(marked: DataFrame, leaves: DataFrame, chunk: int) -> DataFrame:
    """Leaves (key, band, node, label) dealt to tiles: those outside a bucket's largest
    component against all of it, in pairs of chunks."""
    per = marked.groupBy("key", "label").agg(F.count("*").alias("m"))
    mixed = per.groupBy("key").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("n"), F.count("*").alias("labels")).where("labels > 1 AND n > 2")
    mixed = mixed.select("key", F.col("top")["label"].alias("main"), F.ceil((F.col("n") - F.col("top")["m"]) / chunk).alias("na"), F.ceil(F.col("n") / chunk).alias("nb"))
    rows = stored(marked.join(mixed.hint("merge"), "key").join(leaves.select("node", "signs").hint("merge"), "node"))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keep = ["band", "node", "label", "signs"]
    first = rows.where("label <> main").select("key", place("na").alias("a"), each("nb").alias("b"), F.lit(0).alias("side"), *keep)
    second = rows.select("key", each("na").alias("a"), place("nb").alias("b"), F.lit(1).alias("side"), *keep)
    return first.unionByName(second)


def undecided(members: DataFrame, labels: DataFrame, leaves: DataFrame, *, chunk: int = CHUNK, most: int = MOST, least: int = LEAST, square: int = SQUARE) -> DataFrame:
    """(tile, side, u, v): pairs of leaves of different components that share a bucket and may
    be similar (tile null), or the leaves of squares full of such pairs (u). members: (key,
    band, node, n); labels: (node, label)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_tasks(it, _TILE, BLOCK_ROWS):
            yield from _decisions(rows, least, square)

    marked = stored(members.join(labels.hint("merge"), "node").select("key", "band", "node", "n", "label"))
    dealt = tiled(marked.where(F.col("n") <= most).drop("n"), leaves, chunk)
    large = marked.where(F.col("n") > most)
    if not large.isEmpty():
        # two similar leaves that share this band share another: key by both
        other = bucketed(leaves.join(large.select("node").distinct().hint("merge"), "node", "left_semi")).select("node", F.col("key").alias("key2"), F.col("band").alias("band2"))
        twice = large.join(other.hint("merge"), "node").where("band2 <> band").select(F.xxhash64("key", "key2").alias("key"), F.lit(0).alias("band"), "node", "label")
        dealt = dealt.unionByName(tiled(twice, leaves, chunk))
    return dealt.repartition(*_TILE).sortWithinPartitions(*_TILE).mapInPandas(run, _FOUND_DDL)


def second_links(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among what undecided() found; of a square a spanning forest of them."""
    found = stored(found)
    one_by_one = checked(found.where("tile IS NULL").select("u", "v").distinct(), sets, percent)
    squares = found.where("tile IS NOT NULL").select("tile", "side", "u").join(sets.withColumnRenamed("node", "u").hint("merge"), "u")
    return one_by_one.unionByName(squares.groupBy("tile").applyInPandas(lambda pdf: _links_of_square(pdf, percent), "u long, v long"))


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, chunk: int = CHUNK, most: int = MOST, least: int = LEAST, square: int = SQUARE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs."""
    signed = stored(signatures(docs, id, text, width))
    leaves = stored(signed.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("signs").alias("signs")))
    keys = stored(bucketed(leaves))
    crowds = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1")
    members = stored(keys.join(crowds.hint("merge"), "key"))
    discard(keys)
    owners = leaves.join(members.select("node").distinct().hint("merge"), "node", "left_semi").select(F.col("doc_id").alias("_owner"))
    sets = stored(full_sets(docs, owners, id, text, width))
    near = stored(checked(members.where("node <> leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct(), sets, percent))
    found = leaves.select("node").join(components(near), "node", "left").select("node", F.coalesce("component", "node").alias("label"))
    more = stored(second_links(undecided(members, found, leaves, chunk=chunk, most=most, least=least, square=square), sets, percent))
    named = leaves.select("node", "doc_id").join(components(near.unionByName(more)), "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    of = stored(named.join(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("node", "component_id"))
    for part in (members, sets, near, more, leaves):
        discard(part)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = signed.select("doc_id", "n_shingles", "node").join(of.hint("merge"), "node", "left").select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
