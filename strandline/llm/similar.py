"""Near duplicates at a given shingle similarity: wide SimHash, tries, an exact check.

1. A text is its set of distinct five-word shingles. Equal sets collapse to one leaf. A leaf
   has a SimHash fingerprint of 256 bits, enough to tell a similarity of 0.8 from one of 0.6,
   and ANCHORS least hashes under as many hash functions.
2. Leaves that share an anchor form a trie over their fingerprint bits. Two sets of
   similarity s share none of n anchors with chance (1 - s)^n (0.0003 at 0.8), so hardly any
   link is lost, and unrelated texts hardly ever meet.
3. Each trie is joined with itself by walking node pairs, adding up differing bits and
   pruning beyond the budget: three deviations above the mean of the given similarity.
   A task keeps the closest links that span what it found, never all pairs of a group:
   one forest of links so close that the check is sure to pass, and between its groups
   FORESTS disjoint ones, so that a link that fails leaves others to try.
4. Every kept link is checked exactly (shared shingles over all shingles); those below the
   similarity go.
5. The tries are walked once more with the groups that those links make: every link between
   two groups that was not kept is checked too. So each link within the budget has been
   checked or lies inside a group. What stays spans the groups; the least doc_id names each.

Hot tries (over ``most`` leaves): the trie is keyed by a second anchor too, which takes
unrelated texts with a common passage apart. One that stays hot is a family of near copies:
leaves close to its leader link to it and need no pairs among each other; the others meet
all leaves in pairs of blocks, each a task. No leaf and no pair with a far leaf is left out.

Defined cases: null and empty texts have the empty set and are duplicates of each other; a
text under five words is one shingle; very long texts count whole; repeated rows and equal
texts share a group; a row without doc_id belongs to no group; an empty table gives an
empty one; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.components import components
from strandline.llm.simhash import shingle_hashes, trie_links, whole_tasks
from strandline.llm.text import as_bytes, ascii_words, discard, fresh, stored

WIDTH, SIMILARITY = 5, 0.8
WORDS64, ANCHORS = 4, 5
BITS = 64 * WORDS64
MOST = 4096
FORESTS = 4
BLOCK_ROWS, HELD_LINKS, FRONTIER = 50_000, 4_000_000, 50_000
_FP = [f"f{i}" for i in range(WORDS64)]


def budget(similarity: float, deviations: float) -> int:
    """Differing bits of two sets of a similarity, so many deviations above the mean. Sets
    of equal size have the least cosine for a similarity, 2 s / (1 + s)."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(BITS * p + deviations * math.sqrt(BITS * p * (1 - p)))


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th hash of 64-bit hashes (finaliser of splitmix64)."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (n + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(np.frombuffer(shingle_hashes(ascii_words((text or b"").lower()), width), ">u8").astype(np.uint64))


def set_number(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def signature(s: np.ndarray) -> tuple[list[int], list[int]]:
    """(fingerprint as 64-bit words, anchors) of a shingle set; zeros for none."""
    if not len(s):
        return [0] * WORDS64, [0] * ANCHORS
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(s), 1 << 13):
        part = s[at : at + (1 << 13)]
        wide = np.stack([_mixed(part, w) for w in range(WORDS64)], axis=1).astype(">u8")
        ones += np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    fp = np.frombuffer(np.packbits(2 * ones > len(s)).tobytes(), ">i8").tolist()
    return fp, [int(_mixed(s, 100 + a).min().astype(np.int64)) for a in range(ANCHORS)]


_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), *((f, pa.int64()) for f in _FP), ("anchors", pa.list_(pa.int64()))])


def signatures(docs: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """(doc_id, node, f0.., anchors); node stands for the shingle set."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            nodes, fps, anchors = [], [], []
            for t in as_bytes(batch.column(1)):
                s = shingle_set(t, width)
                fp, own = signature(s)
                nodes.append(set_number(s))
                fps.append(fp)
                anchors.append(own)
            columns = list(zip(*fps)) or [[]] * WORDS64
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip([nodes, *columns, anchors], list(_SIGNATURE)[1:]))], schema=_SIGNATURE)

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, node long, " + "".join(f"{f} long, " for f in _FP) + "anchors array<bigint>")


# -- closest links -----------------------------------------------------------------------


def spanning(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of links that make a minimum spanning forest of n nodes (Boruvka)."""
    order = np.lexsort((j, i, d))
    rank = np.empty(len(d), np.int64)
    rank[order] = np.arange(len(d))
    label, chosen, live = np.arange(n), [], np.arange(len(d))
    while len(live):
        a, b = label[i[live]], label[j[live]]
        live, a, b = live[a != b], a[a != b], b[a != b]
        if not len(live):
            break
        best = np.full(n, len(d))
        np.minimum.at(best, a, rank[live])
        np.minimum.at(best, b, rank[live])
        picked = order[np.unique(best[best < len(d)])]
        chosen.append(picked)
        x, y = label[i[picked]], label[j[picked]]
        while True:
            lo = np.minimum(label[x], label[y])
            if (label[x] == label[y]).all():
                break
            np.minimum.at(label, label[x], lo)
            np.minimum.at(label, label[y], lo)
            while (label[label] != label).any():
                label = label[label]
        label = label[label]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def closest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, sure: int) -> np.ndarray:
    """Places of the links to keep: a forest of sure ones, FORESTS disjoint ones between
    the groups that those make."""
    near = np.flatnonzero(d <= sure)
    chosen = [near[spanning(n, i[near], j[near], d[near])]]
    label = np.arange(n)
    x, y = i[chosen[0]], j[chosen[0]]
    while len(x) and (label[x] != label[y]).any():
        lo = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], lo)
        np.minimum.at(label, label[y], lo)
        label = label[label]
        while (label[label] != label).any():
            label = label[label]
    left = np.flatnonzero((d > sure) & (label[i] != label[j]))
    for _ in range(FORESTS):
        if not len(left):
            break
        picked = spanning(n, label[i[left]], label[j[left]], d[left])
        chosen.append(left[picked])
        left = np.delete(left, picked)
    return np.concatenate(chosen)


def _distance(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int64)


_TASK = ["task", "a", "b"]


def _join_block(pdf: pd.DataFrame, k: int, sure: int) -> Iterator[pd.DataFrame]:
    """Links (u, v) of whole tasks: the closest spanning ones, or where rows have a component
    every one between two components."""
    fps = np.stack([pdf[f].to_numpy(np.int64).view(np.uint64) for f in _FP], axis=1)
    key, side, node = [pdf[c].to_numpy(np.int64) for c in _TASK], pdf["side"].to_numpy(np.int64), pdf["node"].to_numpy(np.int64)
    order = np.lexsort((*fps.T[::-1], side, *key[::-1]))
    fps, side, node, key = fps[order], side[order], node[order], [x[order] for x in key]
    lo = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in key], axis=0)]))
    hi = np.append(lo[1:], len(node))
    crossing = key[1][lo] >= 0
    mid = hi - np.add.reduceat(side, lo)
    pairs = lo, np.where(crossing, mid, hi), np.where(crossing, mid, lo), hi
    # a leaf may stand on both sides of a pair of blocks: nodes, not places, are linked
    known, place = np.unique(node, return_inverse=True)
    if "component" in pdf:
        of = pdf["component"].to_numpy(np.int64)[order]
        for i, j in trie_links(fps, pairs, k, FRONTIER):
            apart = of[i] != of[j]
            yield pd.DataFrame({"u": node[i[apart]], "v": node[j[apart]]}).drop_duplicates()
        return
    held, size = [], 0

    def reduced() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, d = (np.concatenate(x) for x in zip(*held))
        once = np.unique(i * len(known) + j, return_index=True)[1]  # tries share links
        i, j, d = i[once], j[once], d[once]
        stay = closest(len(known), i, j, d, sure)
        return i[stay], j[stay], d[stay]

    for i, j in trie_links(fps, pairs, k, FRONTIER):
        d, i, j = _distance(fps, i, j), place[i], place[j]
        other = i != j
        i, j, d = i[other], j[other], d[other]
        held.append((np.minimum(i, j), np.maximum(i, j), d))
        size += len(i)
        if size > HELD_LINKS:
            held = [reduced()]
            size = len(held[0][0])
    i, j, _ = reduced() if held else [np.zeros(0, np.int64)] * 3
    yield pd.DataFrame({"u": known[i], "v": known[j]})


def _tasks(leaves: DataFrame, most: int, sure: int) -> tuple[DataFrame, DataFrame | None]:
    """(leaves dealt to tasks, links to leaders of families of near copies). Leaves with a
    component: tasks of several only, and far from a leader are those of another than its."""
    none = lambda v: F.lit(v).cast("long")
    of = ["component"] if "component" in leaves.columns else []
    whole = ["task", none(-1).alias("a"), none(-1).alias("b"), none(0).alias("side"), *_FP, "node", *of]
    one = leaves.select(F.posexplode("anchors").alias("at", "anchor"), *_FP, "node", "anchors", *of).withColumn("task", F.xxhash64("at", "anchor"))
    if of:
        several = one.groupBy("task").agg((F.min("component") < F.max("component")).alias("m")).where("m").select("task")
        one = stored(one.join(several.hint("merge"), "task", "left_semi"))
    over = lambda df: stored(df.groupBy("task").agg(F.count("*").alias("n")).where(F.col("n") > most))
    hot = over(one)
    if hot.isEmpty():
        return one.select(*whole), None
    cold = one.join(hot, "task", "left_anti").select(*whole)
    two = one.join(hot.select("task"), "task", "left_semi").select("task", *_FP, "node", *of, F.col("at").alias("own"), F.posexplode("anchors").alias("at", "second")).where("at <> own")
    two = stored(two.withColumn("task", F.xxhash64("task", "at", "second")).select("task", *_FP, "node", *of))
    dense = over(two)
    out = cold.unionByName(two.join(dense, "task", "left_anti").select(*whole))
    if dense.isEmpty():
        return out, None
    family = two.join(dense.select("task"), "task", "left_semi")
    leader = family.groupBy("task").agg(F.min(F.struct("node", *_FP, *of)).alias("l"))
    far = sum((F.bit_count(F.col(f).bitwiseXOR(F.col("l")[f])) for f in _FP), F.lit(0))
    far = F.col("component") != F.col("l")["component"] if of else far > sure
    led = stored(family.join(leader, "task").select("task", *_FP, "node", *of, F.col("l")["node"].alias("leader"), far.alias("far")))
    links = led.where("NOT far AND node <> leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct()
    blocks = led.groupBy("task").agg(F.ceil(F.count_if("far") / (most // 2)).alias("rest"), F.ceil(F.count("*") / (most // 2)).alias("all_")).where("rest > 0")
    dealt = led.join(blocks, "task")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    each = lambda n: F.explode(F.sequence(none(0), F.col(n) - 1))
    first = dealt.where("far").select("task", place("rest").alias("a"), each("all_").alias("b"), none(0).alias("side"), *_FP, "node", *of)
    second = dealt.select("task", each("rest").alias("a"), place("all_").alias("b"), none(1).alias("side"), *_FP, "node", *of)
    return out.unionByName(first).unionByName(second), None if of else links


def candidate_links(leaves: DataFrame, similarity: float = SIMILARITY, *, most: int = MOST) -> DataFrame:
    """(u, v): the closest links that span what the tries find, or of leaves with a component
    all that they find between two. leaves: (node, f0.., anchors)."""
    k, sure = budget(similarity, 3), budget((1 + similarity) / 2, 0)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_tasks(it, _TASK, BLOCK_ROWS):
            yield from _join_block(rows, k, sure)

    dealt, led = _tasks(leaves, most, sure)
    links = dealt.repartition(*_TASK).sortWithinPartitions(*_TASK).mapInPandas(run, "u long, v long")
    return (links if led is None else links.unionByName(led)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


# -- the exact check ---------------------------------------------------------------------


def _shared(a: pa.Array, b: pa.Array) -> pa.Array:
    """Shared shingles over all shingles of two sets."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / max(1, len(x) + len(y) - both))
    return pa.array(out, pa.float64())


_shared.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}


def checked_links(links: DataFrame, docs: DataFrame, owners: DataFrame, similarity: float, id: str, text: str, width: int) -> DataFrame:
    """The links whose sets are as similar as asked. owners: (node, doc_id) tells whose text
    to take; only texts of linked nodes are read for their sets."""
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = owners.join(nodes, "node", "left_semi").select(F.col("doc_id").alias("_owner")).distinct()
    rows = docs.select(F.col(id).cast("long").alias("_owner"), F.col(text).alias("_text")).join(wanted.hint("merge"), "_owner", "left_semi")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 64):
                found = [shingle_set(t, width) for t in as_bytes(batch.column(0).slice(at, 64))]
                yield pa.RecordBatch.from_arrays([pa.array([set_number(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "set"])

    sets = stored(rows.select("_text").mapInArrow(run, "node long, set binary").dropDuplicates(["node"]))
    x, y = sets.toDF("u", "x"), sets.toDF("v", "y")
    return links.join(x.hint("merge"), "u").join(y.hint("merge"), "v").where(F.arrow_udf(_shared, "double").asNondeterministic()("x", "y") >= similarity).select("u", "v")


def groups(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, most: int = MOST) -> DataFrame:
    """(doc_id, component_id), a row for each row of docs with a doc_id."""
    signed = stored(signatures(docs, id, text, width))
    leaves = stored(signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(f).alias(f) for f in _FP], F.first("anchors").alias("anchors")))
    links = stored(candidate_links(leaves.drop("doc_id"), similarity, most=most))
    fine = stored(checked_links(links, docs, leaves.select("node", "doc_id"), similarity, id, text, width))
    named = lambda: leaves.join(components(fine), "node", "left").withColumn("component", F.coalesce("component", "node"))
    # links that the forests left out and whose ends no checked link has joined
    rest = stored(candidate_links(stored(named().drop("doc_id")), similarity, most=most).join(links.hint("merge"), ["u", "v"], "left_anti"))
    if not rest.isEmpty():
        fine = stored(fine.unionByName(checked_links(rest, docs, leaves.select("node", "doc_id"), similarity, id, text, width)))
    named = named().select("node", "doc_id", "component")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = stored(named.join(least, "component").select("node", "component_id"))
    out = signed.select("doc_id", "node").join(of, "node").select("doc_id", "component_id")
    for part in (links, rest, fine, leaves):
        discard(part)
    return out


def keep_one_each(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group: its least doc_id (one row of it, should it be
    repeated); rows without doc_id stay. A doc_id of several texts goes if one of them does."""
    found = stored(groups(docs, id=id, text=text, width=width, similarity=similarity))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(fresh(docs, "_gone"))).distinct()
    left = docs.join(gone.hint("merge"), docs[id].cast("long") == gone[gone.columns[0]], "left_anti")
    if found.count() == found.select("doc_id").distinct().count():
        return left
    at = fresh(docs, "_nth")
    nth = F.row_number().over(Window.partitionBy(id).orderBy(F.xxhash64(text)))
    return left.withColumn(at, nth).where((F.col(at) == 1) | F.col(id).isNull()).drop(at)
