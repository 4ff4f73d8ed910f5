"""SimHash near-dedup by a binary trie self-join.

1. Each text becomes a 64-bit fingerprint (a map, no shuffle). Equal fingerprints
   collapse to one row with their least doc_id, so exact copies cost nothing further.
2. Two fingerprints within k bits agree on at least B - k of B blocks of bits. For each
   choice of B - k blocks the fingerprints form one forest of tries, keyed by the chosen
   bits; every trie is joined with itself in one task. B grows with the number of
   fingerprints, which keeps tries small; every B gives the same links.
3. A trie above ``most`` leaves is cut below: its nodes SPLIT bits further down form pairs
   (a node with itself and with each node within k bits), and each pair is a task of its
   own. Again no link is lost, and no task holds a hot key.
4. The self-join walks pairs of nodes down from (root, root), adds up differing bits and
   drops a pair once they exceed k. Pairs of leaves that survive are links. A task emits
   a spanning forest of its links, never all pairs of a group.
5. Connected components over the forests; the least doc_id names a component.

Defined cases: null and empty texts have fingerprint zero and link like any other; very
long texts count whole; a bit set in exactly half of the hashes is 0; repeated rows and
equal texts share a component; a row without doc_id gets a fingerprint but no component and
links nothing; an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.components import components
from strandline.llm.text import as_bytes, ascii_words, stored

WIDTH, SEED, BITS, DIFFERENCE = 4, 42, 64, 4
TRIE_TARGET, TRIE_MOST = 512, 20_000
SPLIT = 12
BLOCK_ROWS, FRONTIER = 100_000, 500_000


def shingle_hashes(words: list[bytes], width: int = WIDTH, seed: int = SEED) -> bytes:
    """The big-endian XXH64 of each shingle of words, one after the other."""
    if not words:
        return b""
    digest = xxhash.xxh64_digest
    line = b" ".join(words)
    if len(words) <= width:
        return digest(line, seed)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return b"".join([digest(line[a : b - 1], seed) for a, b in zip(starts, ends[width - 1 :])])


def fingerprint(text: bytes | None, width: int = WIDTH, seed: int = SEED) -> bytes:
    """8 bytes, the highest bit first."""
    hashes = np.frombuffer(shingle_hashes(ascii_words((text or b"").lower()), width, seed), np.uint8).reshape(-1, 8)
    if not len(hashes):
        return bytes(8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint as a long with the same 64 bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = b"".join([fingerprint(t, width, seed) for t in as_bytes(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(fps, ">i8").astype(np.int64))], schema=schema)

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


# -- the join of tries ----------------------------------------------------------------


def _pairs_of(sizes_a: np.ndarray, sizes_b: np.ndarray, lo_a: np.ndarray, lo_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All leaf pairs of ranges [lo_a, +sizes_a) x [lo_b, +sizes_b)."""
    n = sizes_a * sizes_b
    first = np.repeat(np.cumsum(n) - n, n)
    k = np.arange(int(n.sum())) - first
    width = np.repeat(sizes_b, n)
    return np.repeat(lo_a, n) + k // width, np.repeat(lo_b, n) + k % width


def trie_links(fps: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], k: int, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (i, j) between the leaves of pairs of tries.

    fps: uint64, or rows of several with the highest bits first, sorted within each trie;
    pairs: from and to of the first and the second
    trie's leaves, which are the same for a trie with itself.
    A node is a range of leaves with equal leading bits; the walk takes one bit a step
    over a frontier of node pairs (a, b, bits that differ so far). Pairs with few leaves
    are decided at once. Frontiers above ``frontier`` are cut and walked one after another."""
    step = np.uint64(1)
    fps = fps.reshape(len(fps), -1)
    top = 64 * fps.shape[1] - 1
    al, ah, bl, bh = (x.astype(np.int64) for x in pairs)
    some = (ah > al) & (bh > bl) & ((al != bl) | (ah - al > 1))
    stack = [(top, al[some], ah[some], bl[some], bh[some], np.zeros(int(some.sum()), np.int16))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, al, ah, bl, bh, diff = stack.pop()
        if len(al) > frontier:
            half = len(al) // 2
            stack += [(bit, *(x[half:] for x in (al, ah, bl, bh, diff))), (bit, *(x[:half] for x in (al, ah, bl, bh, diff)))]
            continue
        while len(al):
            small = (ah - al) * (bh - bl) <= 16
            if bit < 0:
                small[:] = True
            if small.any():
                i, j = _pairs_of((ah - al)[small], (bh - bl)[small], al[small], bl[small])
                near = (i < j) & (np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int64) <= k)
                if near.any():
                    yield i[near], j[near]
                al, ah, bl, bh, diff = (x[~small] for x in (al, ah, bl, bh, diff))
            if not len(al):
                break
            if len(al) > frontier:
                stack.append((bit, al, ah, bl, bh, diff))
                break
            if bit not in ones:
                ones[bit] = np.concatenate([[0], np.cumsum((fps[:, (top - bit) // 64] >> np.uint64(bit % 64)) & step, dtype=np.int64)])
            c = ones[bit]
            am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
            own = al == bl  # a node with itself: the pair (1, 0) mirrors (0, 1)
            al, ah, bl, bh, diff = (
                np.concatenate(x)
                for x in (
                    (al, am, al, am[~own]),
                    (am, ah, am, ah[~own]),
                    (bl, bm, bm, bl[~own]),
                    (bm, bh, bh, bm[~own]),
                    (diff, diff, diff + 1, diff[~own] + 1),
                )
            )
            live = (diff <= k) & (ah > al) & (bh > bl)
            alone = (al == bl) & (ah - al == 1)
            keep = live & ~alone
            al, ah, bl, bh, diff = (x[keep] for x in (al, ah, bl, bh, diff))
            bit -= 1


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index that each of n nodes reaches."""
    label = np.arange(n)
    for i, j in links:
        while True:
            a, b = label[i], label[j]
            low = np.minimum(a, b)
            if (a == b).all():
                break
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


#: What a task of the join is: a trie (chosen bits and their value) and two of its nodes.
_TASK = ["mask", "value", "a", "b"]


def _join_block(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
    key = [pdf[c].to_numpy(np.int64) for c in _TASK]
    side = pdf["side"].to_numpy(np.int64)
    order = np.lexsort((fps, side, *key[::-1]))
    fps, side, key = fps[order], side[order], [x[order] for x in key]
    rep = pdf["rep"].to_numpy(np.int64)[order]
    first = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in key], axis=0)])
    lo = np.flatnonzero(first)
    hi = np.append(lo[1:], len(fps))
    # a pair of nodes has the second one's leaves after the first one's
    crossing = key[2][lo] != key[3][lo]
    mid = hi - np.add.reduceat(side, lo)
    pairs = lo, np.where(crossing, mid, hi), np.where(crossing, mid, lo), hi
    label = forest(len(fps), trie_links(fps, pairs, k))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pd.DataFrame({"u": rep[moved], "v": rep[label[moved]]})


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(k: int, blocks: int, free: int = (1 << BITS) - 1) -> list[int]:
    """The bits of free cut in blocks; a mask for each choice of blocks - k of them."""
    bits = [b for b in range(BITS) if free >> b & 1]
    parts = [sum(1 << b for b in bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks]) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - k)]


def _node(mask: int) -> str:
    """The number of a fingerprint's node: its SPLIT highest bits outside a mask."""
    bits = [b for b in range(BITS - 1, -1, -1) if not (mask % (1 << BITS)) >> b & 1][:SPLIT]
    return " + ".join(f"((shiftrightunsigned(fp, {b}) & 1L) * {1 << i}L)" for i, b in enumerate(reversed(bits)))


def tries(reps: DataFrame, n: int, k: int, target: int = TRIE_TARGET, most: int = TRIE_MOST) -> DataFrame:
    """(mask, value, a, b, side, fp, rep): the leaves that each task joins. a = b = -1 for
    a whole trie with itself; side tells which node of a pair a leaf is in."""
    blocks = k + 1
    while n >> (BITS * (blocks - k) // blocks) > target and blocks < k + 4:
        blocks += 1
    masks = [_signed(m) for m in block_masks(k, blocks)]
    leaves = reps.withColumn("mask", F.explode(F.array(*map(F.lit, masks)))).withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))).select("mask", "value", "fp", "rep")
    one, none = F.lit(-1).cast("long"), F.lit(0).cast("long")
    columns = [*_TASK, "side", "fp", "rep"]
    hot = stored(leaves.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > most).select("mask", "value"))
    if hot.isEmpty():
        return leaves.select("mask", "value", one.alias("a"), one.alias("b"), none.alias("side"), "fp", "rep")
    cold = leaves.join(hot, ["mask", "value"], "left_anti").select("mask", "value", one.alias("a"), one.alias("b"), none.alias("side"), "fp", "rep")
    node = F.expr("CASE mask " + " ".join(f"WHEN {m}L THEN {_node(m)}" for m in masks) + " END")
    large = leaves.join(hot, ["mask", "value"], "left_semi").withColumn("node", node)
    nodes = stored(large.select("mask", "value", "node").distinct())
    pairs = nodes.withColumnRenamed("node", "a").join(nodes.withColumnRenamed("node", "b"), ["mask", "value"]).where((F.col("a") <= F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= k))
    first = large.withColumnRenamed("node", "a").join(pairs, ["mask", "value", "a"]).withColumn("side", none)
    second = large.withColumnRenamed("node", "b").join(pairs.where("a < b"), ["mask", "value", "b"]).withColumn("side", F.lit(1).cast("long"))
    return cold.unionByName(first.select(*columns)).unionByName(second.select(*columns))


def whole_tasks(it: Iterator[pd.DataFrame], task: list[str], block_rows: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by task, regathered so that no task is cut; each row is moved once."""
    done: list[pd.DataFrame] = []
    current: list[pd.DataFrame] = []
    for pdf in it:
        if not len(pdf):
            continue
        first = int(np.flatnonzero(np.all([pdf[c].to_numpy() == pdf[c].iloc[-1] for c in task], axis=0))[0])
        if first or not current or any(current[-1][c].iloc[-1] != pdf[c].iloc[0] for c in task):
            done += [*current, pdf.iloc[:first]]
            current = [pdf.iloc[first:]]
        else:
            current.append(pdf)
        if sum(map(len, done)) >= block_rows:
            yield pd.concat(done, ignore_index=True)
            done = []
    if done or current:
        yield pd.concat([*done, *current], ignore_index=True)


def links(reps: DataFrame, k: int = DIFFERENCE, *, target: int = TRIE_TARGET, most: int = TRIE_MOST) -> DataFrame:
    """(u, v): edges that connect exactly the reps linked by fingerprints within k bits.

    reps: (fp, rep) with distinct fp."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_tasks(it, _TASK, BLOCK_ROWS):
            yield _join_block(rows, k)

    leaves = tries(reps, reps.count(), k, target, most)
    return leaves.repartition(*_TASK).sortWithinPartitions(*_TASK).mapInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", k: int = DIFFERENCE, width: int = WIDTH, seed: int = SEED, target: int = TRIE_TARGET, most: int = TRIE_MOST) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of docs."""
    fps = stored(fingerprints(docs, id=id, text=text, width=width, seed=seed))
    reps = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"))
    comp = components(links(reps, k, target=target, most=most))
    named = reps.join(comp, reps["rep"] == comp["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
