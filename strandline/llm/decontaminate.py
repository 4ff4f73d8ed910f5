"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND.

Test items are the indexed side, passages of training documents are the queries. An
item's score is its BM25 score over the passage's distinct words divided by the score
of the item's own words, so one threshold serves all items and every item above it is
retrieved (no top-k). Retrieved pairs are verified: the item's words that lie in shared
runs of five words must cover enough of the whole item and of both its halves, question
and answer. A half under five words counts as one run of its own length, near the place
where the other half is.

Items are grouped by length class; a class cuts documents into passages twice as long as
an item may spread, with half of a passage shared with the next, so that any leaked item
lies whole in one passage. Every passage of every document is a query. A passage first
meets the pivot test of WAND for all blocks at once, as array arithmetic over running
sums of block maxima: most passages have no block that could reach the threshold. The
rest run block-max WAND.

Items are held by every task only while their text is under ``broadcast_bytes``
(measured); a larger benchmark is dealt to several indexes, each a job of its own over all
documents that keeps the leaks it finds. Item count, document frequencies and average
length are those of all items in any case.

Defined cases: null or empty items match nothing; null or empty texts contain nothing;
very long texts are searched whole, passage by passage; items with equal texts or ids are
all reported, in order of id and place; an item that occurs several times in a document is
reported once, where it overlaps most; repeated rows are each reported; an item shorter
than five words must occur as it is; an empty benchmark finds nothing and an empty table
gives an empty one; a column of docs named like ``into`` (case aside) is replaced, other
extra columns come along whatever their names.
"""

from __future__ import annotations

import bisect
import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import as_bytes, fresh, stored

SHINGLE, OVERLAP, HALF_OVERLAP = 5, 0.8, 0.6
#: Words that may lie between a short half of an item and the other half's runs.
REACH = 10
THRESHOLD, K1, B = 0.5, 1.2, 0.75
BLOCK = 4
#: Item texts that one index holds: about 40 times as much in a worker's memory.
BROADCAST_BYTES = 4 << 20
#: Words whose postings are summed together.
GATHERED = 20_000
#: Share of the threshold that words too common to tell items apart may add up to.
COMMON = 0.2

_TABLE = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and characters beyond ASCII."""
    lower = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return lower.translate(_TABLE).split()


def split_item(text: bytes) -> int:
    """The number of words in the question: those up to the last question mark, else half."""
    n = len(words_of(text))
    head, mark, _ = text.rpartition(b"?")
    q = len(words_of(head)) if mark else 0
    return q if 0 < q < n else (n + 1) // 2


class Index:
    """Items of one length class. Posting lists ascend by item; BLOCK items make a block."""

    def __init__(self, items: list[tuple[int, list[bytes], int]], n_all: int, df: Counter, average: float):
        self.items = items
        longest = max(len(w) for _, w, _ in items)
        self.stride = max(8, math.ceil(1.25 * longest))
        self.n_blocks = -(-len(items) // BLOCK)
        lists: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for i, (_, words, _) in enumerate(items):
            tf = Counter(words)
            impact = {}
            for w, f in tf.items():
                idf = math.log(1 + (n_all - df[w] + 0.5) / (df[w] + 0.5))
                impact[w] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / average))
            own = sum(impact.values())
            for w, x in impact.items():
                lists[w].append((i, x / own))
        self.term = {w: t for t, w in enumerate(lists)}
        self.posting_items = [array("i", [i for i, _ in p]) for p in lists.values()]
        self.posting_scores = [array("d", [x for _, x in p]) for p in lists.values()]
        self.most = [max(s) for s in self.posting_scores]
        # block maxima of each word, for the blocks that it is in only
        self.blocks, self.peaks = [], []
        for ids, scores in zip(self.posting_items, self.posting_scores):
            own, place = np.unique(np.array(ids) // BLOCK, return_inverse=True)
            top = np.zeros(len(own))
            np.maximum.at(top, place, np.array(scores))
            self.blocks.append(array("i", own.tolist()))
            self.peaks.append(array("d", top.tolist()))
        self.ends = np.cumsum([len(x) for x in self.blocks])
        self.flat_blocks, self.flat_peaks = (np.concatenate([np.asarray(x) for x in y]) for y in (self.blocks, self.peaks))
        # the words that matter least, as many as stay under COMMON together in every block
        self.floor, self.telling = np.zeros(self.n_blocks), np.ones(len(lists), bool)
        for t in sorted(range(len(lists)), key=lambda t: -len(self.blocks[t])):
            own = np.asarray(self.blocks[t])
            after = self.floor[own] + np.asarray(self.peaks[t])
            if after.max() > COMMON * THRESHOLD:
                break
            self.floor[own] = after
            self.telling[t] = False

    def candidates(self, terms: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
        """(document, start) of the passages that some block could lift over the threshold.

        terms: of each word of some documents, -1 for words of no item; bounds: where each
        document starts, and the end. A passage's bound in a block is the floor plus the
        block maxima of its telling words, each once. The floor alone reaches no threshold,
        so blocks without a telling word need no sum. Some thousand words are summed at a
        time, however long a document is."""
        step = self.stride
        at = np.flatnonzero(terms >= 0)
        at = at[self.telling[terms[at]]]
        if not len(at):
            return
        # where the same word stood before, so that a passage counts each word once
        own = terms[at]
        order = np.argsort(own, kind="stable")
        before = np.full(len(at), -1, np.int64)
        same = own[order[1:]] == own[order[:-1]]
        before[order[1:][same]] = at[order[:-1][same]]
        doc = np.searchsorted(bounds, at, "right") - 1
        half = (at - bounds[doc]) // step
        begin = bounds[doc] + half * step
        passages = np.maximum(1, -(-(np.diff(bounds) - step) // step))
        base = np.cumsum(passages) - passages
        # a word counts for the passage that starts with its half and for the one before
        first = np.flatnonzero((before < begin) & (half < passages[doc]))
        second = np.flatnonzero((before < begin - step) & (half > 0))
        passage = np.concatenate([(base[doc] + half)[first], (base[doc] + half - 1)[second]])
        order = np.argsort(passage, kind="stable")
        passage, word = passage[order], np.concatenate([own[first], own[second]])[order]
        lo = 0
        while lo < len(passage):
            # whole passages, as many as GATHERED words make
            hi = len(passage) if lo + GATHERED >= len(passage) else max(int(np.searchsorted(passage, passage[lo + GATHERED])), int(np.searchsorted(passage, passage[lo], "right")))
            found = self._above(passage[lo:hi], word[lo:hi])
            for x, d in zip(found.tolist(), (np.searchsorted(base, found, "right") - 1).tolist()):
                yield d, (x - int(base[d])) * step
            lo = hi

    def _above(self, passage: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The passages whose bound reaches the threshold in some block."""
        last = self.ends[word]
        size = last - np.where(word > 0, self.ends[word - 1], 0)
        start = np.repeat(last - size - (np.cumsum(size) - size), size)
        flat = start + np.arange(int(size.sum()))
        key = np.repeat(passage, size) * self.n_blocks + self.flat_blocks[flat]
        cell, place = np.unique(key, return_inverse=True)
        bound = np.bincount(place, weights=self.flat_peaks[flat], minlength=len(cell)) + self.floor[cell % self.n_blocks]
        return np.unique(cell[bound >= THRESHOLD - 1e-9] // self.n_blocks)

    def _peak(self, t: int, block: int) -> float:
        """The greatest score of a word in a block; 0 where it is not in it."""
        own = self.blocks[t]
        at = bisect.bisect_left(own, block)
        return self.peaks[t][at] if at < len(own) and own[at] == block else 0.0

    def retrieve(self, terms: set[int]) -> dict[int, float]:
        """Every item that scores THRESHOLD or more over the terms: block-max WAND."""
        lists = [[self.posting_items[t][0], 0, t] for t in terms]
        found: dict[int, float] = {}
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                bound += self.most[t]
                if bound >= THRESHOLD - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self._peak(t, block) for _, _, t in lists[: pivot + 1]) < THRESHOLD - 1e-9:
                after = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    after = min(after, lists[pivot + 1][0])
                item = max(after, item + 1)
                self._seek(lists, pivot + 1, item)
            elif lists[0][0] == item:
                score = sum(self.posting_scores[t][at] for i, at, t in lists[: pivot + 1])
                if score >= THRESHOLD - 1e-9:
                    found[item] = score
                self._seek(lists, pivot + 1, item + 1)
            else:
                self._seek(lists, pivot, item)
        return found

    def _seek(self, lists: list[list], n: int, item: int) -> None:
        """Moves the first n lists to their first posting at item or later."""
        ended = False
        for entry in lists[:n]:
            ids = self.posting_items[entry[2]]
            if entry[0] < item:
                entry[1] = at = bisect.bisect_left(ids, item, entry[1])
                if at == len(ids):
                    entry[0], ended = 1 << 60, True
                else:
                    entry[0] = ids[at]
        if ended:
            lists[:] = [x for x in lists if x[0] < 1 << 60]

    def verify(self, item: int, words: list[bytes], start: int) -> tuple[float, float, float]:
        """The shares of the whole item, its question and its answer that lie in word runs
        shared with the passage."""
        _, own, q = self.items[item]
        width = min(SHINGLE, len(own))
        near = words[max(0, start - self.stride) : start + 3 * self.stride]
        there = {tuple(near[i : i + width]) for i in range(len(near) - width + 1)}
        covered = [False] * len(own)
        for i in range(len(own) - width + 1):
            if tuple(own[i : i + width]) in there:
                covered[i : i + width] = [True] * width
        if len(own) >= SHINGLE:
            for part, rest in ((slice(q, None), own[:q]), (slice(0, q), own[q:])):
                if 0 < len(own[part]) < SHINGLE and not all(covered[part]) and self._beside(own[part], rest, near):
                    covered[part] = [True] * len(own[part])
                    if len(rest) < SHINGLE:
                        covered = [True] * len(own)
        share = lambda part: sum(part) / len(part) if part else 1.0
        return share(covered), share(covered[:q]), share(covered[q:])


    def _beside(self, part: list[bytes], rest: list[bytes], near: list[bytes]) -> bool:
        """Whether part occurs in near within REACH words of rest's runs, not inside them."""
        width = min(SHINGLE, len(rest))
        runs = {tuple(rest[i : i + width]) for i in range(len(rest) - width + 1)}
        taken = [False] * len(near)
        for i in range(len(near) - width + 1):
            if tuple(near[i : i + width]) in runs:
                taken[i : i + width] = [True] * width
        n = len(part)
        return any(near[i : i + n] == part and not any(taken[i : i + n]) and any(taken[max(0, i - REACH) : i + n + REACH]) for i in range(len(near) - n + 1))


class Benchmark:
    """The indexes of all length classes and one table of all their words."""

    def __init__(self, indexes: list[Index]):
        self.indexes = indexes
        self.word: dict[bytes, int] = {}
        for index in indexes:
            for w in index.term:
                self.word.setdefault(w, len(self.word))
        self.terms = []
        for index in indexes:
            own = np.full(len(self.word) + 1, -1, np.int32)  # the last place is for -1
            for w, t in index.term.items():
                own[self.word[w]] = t
            self.terms.append(own)


def build(items: list[tuple[int, bytes]], figures: tuple[int, dict[bytes, int], float] | None = None) -> Benchmark:
    """An index for each length class (powers of two) of items.

    figures: item count, document frequencies and average length of a benchmark of which
    items are a part; those of items themselves if absent."""
    parsed = [(i, words_of(t), split_item(t)) for i, t in items if t]
    parsed = [x for x in parsed if x[1]]
    if figures is None:
        figures = len(parsed), Counter(w for _, words, _ in parsed for w in set(words)), sum(len(w) for _, w, _ in parsed) / max(1, len(parsed))
    n_all, df, average = figures
    classes = defaultdict(list)
    for x in parsed:
        classes[max(4, (len(x[1]) - 1).bit_length())].append(x)
    return Benchmark([Index(x, n_all, df, average) for _, x in sorted(classes.items())])


def search(benchmark: Benchmark, texts: list[bytes]) -> list[list[tuple[int, float, float, float, float, int]]]:
    """Of each text the (item id, score, overlap, question overlap, answer overlap, word) of
    leaked items."""
    get = benchmark.word.get
    docs = [words_of(t) for t in texts]
    known = np.array([get(w, -1) for words in docs for w in words], np.int32)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in docs])]).astype(np.int64)
    best: list[dict[tuple[int, int], tuple]] = [{} for _ in docs]
    for nth, (index, own) in enumerate(zip(benchmark.indexes, benchmark.terms)):
        terms = own[known]
        for d, start in index.candidates(terms, bounds):
            part = terms[bounds[d] + start : min(bounds[d] + start + 2 * index.stride, bounds[d + 1])]
            for item, score in index.retrieve(set(part[part >= 0].tolist())).items():
                whole, question, answer = index.verify(item, docs[d], start)
                if whole >= OVERLAP and question >= HALF_OVERLAP and answer >= HALF_OVERLAP:
                    key = (nth, item)
                    if key not in best[d] or (whole, score) > (best[d][key][2], best[d][key][1]):
                        best[d][key] = (index.items[item][0], score, whole, question, answer, start)
    return [sorted(x.values(), key=lambda x: (x[0], x[5])) for x in best]


def _some(texts: list[bytes | None], most: int = 1 << 19) -> Iterator[list[bytes]]:
    """The texts, nulls as empty ones, about so many bytes at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t or b"")
        size += len(t or b"")
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


_DDL = "array<struct<item_id:bigint,score:double,overlap:double,question_overlap:double,answer_overlap:double,word:bigint>>"
_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("word", pa.int64())]))


def _searcher(held):
    state: list = []

    def run(texts: pa.Array) -> pa.Array:
        if not state:
            state.append(build(*held.value))
        names = [f.name for f in _KIND.value_type]
        return pa.array([[dict(zip(names, x)) for x in found] for part in _some(as_bytes(texts)) for found in search(state[0], part)], _KIND)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _DDL).asNondeterministic()


def _words(texts: pa.Array) -> pa.Array:
    return pa.array([words_of(t) for t in as_bytes(texts)], pa.list_(pa.binary()))


_words.__annotations__ = {"texts": pa.Array, "return": pa.Array}


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", into: str = "leaks", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with an array column ``into``: a struct for each leaked item."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).cast("binary").alias("t")).where("t IS NOT NULL")
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    groups = max(1, -(-size // broadcast_bytes))
    collected = lambda some: [(r["i"], bytes(r["t"])) for r in some.orderBy("i", "t").collect()]
    if groups == 1:
        return docs.withColumn(into, _searcher(spark.sparkContext.broadcast((collected(items), None)))(F.col(text)))
    group = F.pmod(F.xxhash64("t"), F.lit(groups)).alias("g")
    worded = stored(items.select(group, F.arrow_udf(_words, "array<binary>")("t").alias("w")).where(F.size("w") > 0))
    n_all, average = worded.agg(F.count("*"), F.avg(F.size("w"))).first()
    each = worded.select("g", F.explode(F.array_distinct("w")).alias("w"))
    counts = stored(each.groupBy("w").agg(F.count("*").alias("n")))
    row, found_at = fresh(docs, "_row"), fresh(docs, "_leaks")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    found = None
    for g in range(groups):
        own = counts.join(each.where(F.col("g") == g).select("w").distinct(), "w", "left_semi")
        figures = n_all, {bytes(r["w"]): r["n"] for r in own.collect()}, average
        held = spark.sparkContext.broadcast((collected(items.where(group == g)), figures))
        part = stored(rows.select(row, _searcher(held)(F.col(text)).alias(found_at)).where(F.size(found_at) > 0))
        held.destroy()
        found = part if found is None else found.unionByName(part)
    # leaks are few beside documents; a row has some of each group
    found = found.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list(found_at))).alias(found_at))
    out = rows.join(found, row, "left").withColumn(into, F.coalesce(found_at, F.array().cast(_DDL)))
    return out.drop(row, found_at)


def keep_unleaked(docs: DataFrame, benchmark: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    at = fresh(docs, "_found")
    return find_leaks(docs, benchmark, text=text, into=at).where(F.size(at) == 0).drop(at)
