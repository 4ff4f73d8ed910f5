"""SentencePiece encoding and decoding: best segmentation as a max-plus parallel scan.

The pieces, the rules for white space and the byte fallback come from a SentencePiece
model file; the segmentation is the one of greatest summed log probability (the unigram
decoder). A file without probabilities (a BPE file keeps merge order only) gets the Zipf
prior of its order: log p = -ln(order + 2) - ln H. Scores are fixed-point integers, so
sums are exact. Of equal segmentations the one whose pieces, from the end, are longest
is taken.

A document of up to CHUNK characters is decoded in its task. A longer one is cut in
chunks, which Spark deals out:

1. A piece may run over a chunk's end, by less than the longest piece. That overhang is
   the state between chunks. Each chunk yields its transfer matrix: the best score from
   each entry state to each exit state.
2. A scan multiplies matrices in the (max, +) algebra, which is associative, by doubling;
   this gives every chunk the score of each of its entry states.
3. Each chunk traces back by itself, for each exit state it has, and names the entry it
   came from; following those from the last chunk picks one trace a chunk.

Inside a chunk no piece spans certain places (before a space mark, around a line feed),
so segments between them are decoded alone, and each distinct segment of a megabyte
once; what earlier texts had is kept, within a bound. The recurrence runs over many
segments at a time in NumPy, a place of each in a step; only runs of over LOCKSTEP
characters without a place that no piece spans go one by one.

Defined cases: null and empty texts have no ids; an empty table gives an empty one; extra
columns are not read; a text with the space mark U+2581 itself
decodes to a space there (as with the library); repeated rows are each encoded; a
character of no piece becomes its UTF-8 bytes.
"""

from __future__ import annotations

import math
import re
import sys
import types
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import stored

SPACE = "▁"
CHUNK = 32_768
CACHED_SEGMENTS = 200_000
LOCKSTEP = 64
#: Stands between texts; no character.
NONE = 0x110000
LOW = -(1 << 61)
ONE = 1 << 20


def kind_of(n: int) -> str:
    """The bytes of an id: u16 where n ids fit, else u32, little-endian."""
    return "<u2" if n <= 1 << 16 else "<u4"


class Table:
    """A hash table of NumPy arrays: whole numbers from 0 on, each with its place in keys."""

    def __init__(self, keys: np.ndarray):
        bits = (4 * len(keys) + 4).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            won = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[won]], self.values[at[won]] = keys[left[won]], left[won]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, at = left[stay], (at[stay] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


class Model:
    """Pieces with integer scores, taken from a SentencePiece file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        given = [sp.get_score(i) for i in normal]
        ordered = all(float(s).is_integer() for s in given)
        total = math.log(sum(1 / (k + 2) for k in range(len(normal))))
        self.score = {names[i]: round(ONE * (-math.log(k + 2) - total)) if ordered else round(ONE * given[k]) for k, i in enumerate(normal)}
        self.id = {names[i]: i for i in normal}
        self.name = names
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = sp.unk_id()
        self.controls = {i for i in range(n) if sp.is_control(i)}
        self.unknown_score = min(self.score.values()) - 10 * ONE
        self.longest = max(map(len, self.id))
        self.starts = {p[:k] for p in self.id for k in range(1, len(p) + 1)}
        #: of each piece its score, of each other start of a piece None
        self.table = dict.fromkeys(self.starts) | self.score
        #: no piece has a space mark after another character
        self.cuts_at_space = all(SPACE not in p.lstrip(SPACE) for p in self.id)
        self.cuts_at_line = all("\n" not in p or len(p) == 1 for p in self.id)
        self.kind = kind_of(n)
        part = rf"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if self.cuts_at_line else rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        self.split = re.compile(part).findall if self.cuts_at_space else (lambda s: [s] if s else [])
        #: characters that stand side by side in some piece; between others a way may be cut
        self.joined = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.pairs = Table(np.array([ord(p[0]) << 21 | ord(p[1]) for p in self.joined], np.int64))
        #: the starts as a trie; a node is the place of its edge, plus 1
        order = sorted(self.starts, key=len)
        node = {"": 0} | {p: k + 1 for k, p in enumerate(order)}
        self.edges = Table(np.array([node[p[:-1]] << 21 | ord(p[-1]) for p in order], np.int64))
        self.node_id = np.array([-1, *(self.id.get(p, -1) for p in order)], np.int64)
        self.node_score = np.array([LOW, *(self.score.get(p, LOW) for p in order)], np.int64)
        self.known, self.known_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        plain = [SPACE if i in self.controls else names[i] for i in range(n)]
        for b, i in self.bytes.items():
            plain[i] = chr(b)
        self.plain = [x.replace(SPACE, " ") for x in plain]
        #: ids that decode by themselves, whatever stands beside them
        self.alone = np.ones(n, bool)
        self.alone[[i for b, i in self.bytes.items() if b > 127] + [self.unknown, *self.controls]] = False

    def steps(self, s: str, at: int) -> list[tuple[int, int]]:
        """(end, score) of each piece of s that starts at a place; at least one."""
        out, starts, score = [], self.starts, self.score
        end = at + 1
        while end <= len(s):
            part = s[at:end]
            if part not in starts:
                break
            if part in score:
                out.append((end, score[part]))
            end += 1
        if not out or out[0][0] != at + 1:
            out.append((at + 1, self.unknown_score))
        return out

    def forward(self, s: str, entry: dict[int, int], last: int) -> list[int]:
        """The best score to reach each place of s, from scored entries; pieces start
        before last only."""
        best = [LOW] * (len(s) + 1)
        for at, x in entry.items():
            best[at] = x
        for at in range(last):
            x = best[at]
            if x > LOW:
                for end, y in self.steps(s, at):
                    if x + y > best[end]:
                        best[end] = x + y
        return best

    def back(self, s: str, best: list[int], end: int, entries: dict[int, int], last: int) -> tuple[int, list[str]]:
        """(entry, pieces) of the best way to a place.

        A way that entered at a place with its best score ends there: the piece that led
        to it began before s, so it is longer than any piece of s that does as well."""
        pieces = []
        while entries.get(end) != best[end]:
            for at in range(max(0, end - self.longest), end):
                part = s[at:end]
                x = self.score.get(part, self.unknown_score if end == at + 1 else None)
                if x is not None and at < last and best[at] > LOW and best[at] + x == best[end]:
                    pieces.append(part)
                    end = at
                    break
            else:
                raise ValueError("no way back")
        return end, pieces[::-1]

    def ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    def pack(self, ids: list[int]) -> bytes:
        return array("H" if self.kind == "<u2" else "I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.kind).tobytes()

    def segment(self, s: str) -> bytes:
        """The ids, as bytes, of a segment that ways enter and leave at its ends."""
        joined = self.joined
        cuts = [k for k in range(1, len(s)) if s[k - 1 : k + 1] not in joined]
        return b"".join([self._segment(s[a:b]) for a, b in zip([0, *cuts], [*cuts, len(s)])]) if s else b""

    def _segment(self, s: str) -> bytes:
        """As forward() and back(), in one pass that notes where each best piece starts."""
        n, look, missing = len(s), self.table.get, self
        best, start, place = [LOW] * (n + 1), [0] * (n + 1), range(n)
        best[0] = 0
        for at in place:
            x, end = best[at], at + 1
            y = look(s[at:end], missing)
            if y is missing or y is None:
                if x + self.unknown_score > best[end]:
                    best[end], start[end] = x + self.unknown_score, at
            while y is not missing:
                if y is not None and x + y > best[end]:
                    best[end], start[end] = x + y, at
                end += 1
                if end > n:
                    break
                y = look(s[at:end], missing)
        pieces, end = [], n
        while end:
            at = start[end]
            pieces.append(s[at:end])
            end = at
        pieces.reverse()
        return self.pack(self.ids_of(pieces))

    def normal(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def _lockstep(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, how many each has), by the recurrence of _segment() for many
        runs at a time; a run goes to the next place that no piece spans."""
        lens = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(lens + 1) - 1
        codes = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
        codes[ends] = NONE
        places = np.arange(len(codes))
        inside = codes != NONE
        first = np.ones(len(codes), bool)
        first[1:] = (self.pairs.find(codes[:-1] << 21 | codes[1:]) < 0) & inside[1:]
        first[ends[:-1] + 1] = True
        first[ends[lens == 0]] = True
        offset = places - np.maximum.accumulate(np.where(first, places, 0))
        long = np.maximum.reduceat(offset, ends - lens) > LOCKSTEP
        if long.any():
            raw = [self.segment(p) if x else None for p, x in zip(parts, long)]
            some, counts = self._lockstep([p for p, x in zip(parts, long) if not x]) if not long.all() else (np.zeros(0, self.kind), np.zeros(0, np.int64))
            rest = iter(np.split(some, np.cumsum(counts)[:-1]))
            found = [np.frombuffer(r, self.kind) if x else next(rest) for r, x in zip(raw, long)]
            return np.concatenate(found), np.array([len(x) for x in found], np.int64)

        at = np.flatnonzero(inside)
        node, steps = np.zeros(len(at), np.int64), []
        for size in range(1, self.longest + 1):
            node = self.edges.find(node << 21 | codes[at + size - 1]) + 1
            if size == 1:
                lone = at[self.node_id[node] < 0]
                steps.append((lone, lone + 1, np.full(len(lone), self.unknown_score), np.full(len(lone), -1)))
            at, node = at[node > 0], node[node > 0]
            if not len(at):
                break
            whole = self.node_id[node] >= 0
            steps.append((at[whole], at[whole] + size, self.node_score[node[whole]], self.node_id[node[whole]]))
        begin, end, score, piece = (np.concatenate(x) for x in zip(*steps))
        order = np.argsort(offset[begin].astype(np.uint8), kind="stable")
        begin, end, score, piece = begin[order], end[order], score[order], piece[order]
        best, came, by = np.full(len(codes), LOW), np.zeros(len(codes), np.int64), np.full(len(codes), -1)
        last = 0
        for k, n in enumerate(np.bincount(offset[begin])):
            some = slice(last, last + n)
            last += n
            x = score[some] + best[begin[some]] if k else score[some]  # a run starts with nothing
            better = x > best[end[some]]
            to = end[some][better]
            best[to], came[to], by[to] = x[better], begin[some][better], piece[some][better]
        used = np.zeros(len(codes), bool)
        now = np.append(places[first & inside & (places > 0)], ends)
        now = now[best[now] > LOW]
        while len(now):
            used[now] = True
            now = came[now]
            now = now[offset[now] > 0]
        where = np.flatnonzero(used)
        ids, counts = by[where], np.diff(np.searchsorted(where, ends, side="right"), prepend=0)
        lone = np.flatnonzero(ids < 0)
        if len(lone):
            chars = codes[came[where[lone]]].tolist()
            of = {c: self.ids_of([chr(c)]) for c in set(chars)}
            many = np.ones(len(ids), np.int64)
            many[lone] = [len(of[c]) for c in chars]
            starts = np.append(0, np.cumsum(many))
            ids = np.repeat(ids, many)
            for k, c in zip(starts[lone].tolist(), chars):
                ids[k : k + len(of[c])] = of[c]
            bounds = starts[np.append(0, np.cumsum(counts))]
            counts = np.diff(bounds)
        return ids.astype(self.kind), counts

    def _learn(self, parts: list[str]) -> pa.Array:
        """The ids of new segments, some ten thousand characters at a time."""
        found, counts, held, n = [np.zeros(0, self.kind)], [np.zeros(1, np.int64)], [], 0
        for k, p in enumerate(parts):
            held.append(p)
            n += len(p)
            if n > 50_000 or k == len(parts) - 1:
                ids, many = self._lockstep(held)
                found.append(ids)
                counts.append(many)
                held, n = [], 0
        ends = np.cumsum(np.concatenate(counts)) * np.dtype(self.kind).itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(found))])

    def _known(self, parts: pa.Array) -> pa.Array:
        """The ids of distinct segments."""
        place = pc.index_in(parts, self.known)
        unknown = place.is_null()
        new = parts.filter(unknown)
        ids = pa.concat_arrays([self.known_ids, self._learn(new.to_pylist())])
        place = np.array(place.fill_null(0), np.int64)
        place[np.asarray(unknown)] = len(self.known) + np.arange(len(new))
        out = ids.take(pa.array(place))
        if len(ids) > CACHED_SEGMENTS:
            self.known, self.known_ids = parts, out  # those of the texts at hand stay
        else:
            self.known, self.known_ids = pa.concat_arrays([self.known, new]), ids
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as bytes of the kind."""
        return self.encode_many([text])[0].as_py()

    def encode_many(self, texts: list[str]) -> pa.Array:
        """The ids of each text as bytes of the kind."""
        return self.segments([self.normal(t) for t in texts])

    def segments(self, texts: list[str]) -> pa.Array:
        """The ids of each text, given as normal() gives it, as bytes of the kind."""
        if self.cuts_at_space and self.cuts_at_line:
            parts, counts = cut_segments(texts)
        else:
            cut = [self.split(t) for t in texts]
            parts, counts = pa.array([p for ps in cut for p in ps], pa.large_string()), np.array([len(ps) for ps in cut], np.int64)
        distinct = parts.dictionary_encode()
        flat = self._known(distinct.dictionary).take(distinct.indices)
        _, at, data = flat.buffers()
        at = np.frombuffer(at, np.int64)[np.append(0, np.cumsum(counts))]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at), data]).cast(pa.binary())

    def decode(self, ids: np.ndarray) -> str:
        if self.alone[ids].all():
            text = "".join(map(self.plain.__getitem__, ids.tolist()))
            return text[1:] if text.startswith(" ") else text
        out, raw = [], bytearray()
        for i in ids.tolist():
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.controls:
                out.append(self.name[i] if i != self.unknown else " ⁇ ")
        out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    # -- chunks -----------------------------------------------------------------------

    def parts(self, s: str, size: int) -> tuple[str, str, str, int]:
        """A chunk (size characters of s, which shows some more) as head, middle, tail:
        ways pass from head to middle to tail at places that no piece spans; and where
        the tail starts. Without such a place all of it is head, and the tail starts at -1."""
        found = self.split(s)
        cuts, at = [], 0
        for p in found[:-1]:
            at += len(p)
            cuts.append(at)
        cuts = [c for c in cuts if 0 < c < size]
        # a run that the chunk's start cuts short may be no whole segment: the head
        if not cuts:
            return s, "", "", -1
        return s[: cuts[0]], s[cuts[0] : cuts[-1]], s[cuts[-1] :], cuts[-1]

    def transfer(self, s: str, size: int) -> np.ndarray:
        """The scores from entry e (characters taken by the chunk before) to exit x
        (characters taken from the chunk after); s shows up to longest - 1 of those.

        Where all ways meet inside the chunk, what they share counts nothing: it adds the
        same to every entry of the matrix, and no choice depends on it."""
        n = self.longest
        out = np.full((n, n), LOW, np.int64)
        head, _, tail, cut = self.parts(s, size)
        if cut < 0:
            for e in range(min(n, size + 1)):
                best = self.forward(s, {e: 0}, size)
                for x in range(min(n, len(s) - size + 1)):
                    out[e, x] = best[size + x]
            return out
        ends = self.forward(tail, {0: 0}, size - cut)
        for e in range(min(n, len(head) + 1)):
            first = self.forward(head, {e: 0}, len(head))[-1]
            if first > LOW:
                for x in range(min(n, len(s) - size + 1)):
                    if ends[size - cut + x] > LOW:
                        out[e, x] = first + ends[size - cut + x]
        return out

    def traces(self, chunks: list[tuple[str, int, np.ndarray]]) -> Iterator[list[tuple[int, int, bytes]]]:
        """(exit, entry, ids) for each exit of each chunk (as for transfer()), given the
        score of each entry state."""
        cut = [self.parts(s, size) for s, size, _ in chunks]
        middles = self.segments([middle for _, middle, _, _ in cut])
        for chunk, (head, _, tail, at), ids in zip(chunks, cut, middles):
            yield self._traces(*chunk, head, ids.as_py(), tail, at)

    def _traces(self, s: str, size: int, entry: np.ndarray, head: str, middle: bytes, tail: str, cut: int) -> list[tuple[int, int, bytes]]:
        states = {e: int(v) for e, v in enumerate(entry) if v > LOW // 2}
        exits = range(min(self.longest, len(s) - size + 1))
        if cut < 0:
            best = self.forward(s, states, size)
            done = []
            for x in exits:
                if best[size + x] > LOW:
                    e, pieces = self.back(s, best, size + x, states, size)
                    done.append((x, e, self.pack(self.ids_of(pieces))))
            return done
        best = self.forward(head, {e: v for e, v in states.items() if e <= len(head)}, len(head))
        if best[-1] <= LOW:
            return []
        e, pieces = self.back(head, best, len(head), states, len(head))
        start = self.pack(self.ids_of(pieces)) + middle
        ends = self.forward(tail, {0: 0}, size - cut)
        done = []
        for x in exits:
            if ends[size - cut + x] > LOW:
                done.append((x, e, start + self.pack(self.ids_of(self.back(tail, ends, size - cut + x, {0: 0}, size - cut)[1]))))
        return done


def cut_segments(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """(segments of the texts in order, how many each has): cut before runs of space marks
    and around line feeds."""
    blobs = [t.encode() for t in texts]
    raw = np.frombuffer(b"".join(blobs), np.uint8)
    ends = np.cumsum([len(b) for b in blobs]).astype(np.int64)
    marks = np.zeros(len(raw) + 3, bool)  # the mark's bytes are E2 96 81
    marks[3:-2] = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81) if len(raw) > 2 else False
    mark, after = marks[3:], marks[:-3]
    line = raw == 0x0A
    begins = mark & ~after | line
    begins[1:] |= line[:-1]
    begins[np.unique(np.append(0, ends))[:-1]] = True
    starts = np.flatnonzero(begins)
    cut = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw)])
    return cut, np.diff(np.searchsorted(starts, ends), prepend=0)


# -- the scan -------------------------------------------------------------------------


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of stacks of matrices; associative."""
    out = (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)
    return np.where(out < LOW // 2, LOW, out)


def prefix_scan(matrices: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, ... matrices, by doubling."""
    out, step = matrices.copy(), 1
    while step < len(out):
        for a in range(len(out) - 1, step - 1, -256):  # from the end: sources stay as they were
            rows = np.arange(max(step, a - 255), a + 1)
            out[rows] = combine(out[rows - step], out[rows])
        step *= 2
    return out


def _scan_group(pdf: pd.DataFrame, n: int) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk")
    stack = np.stack([np.frombuffer(x, np.int64).reshape(n, n) for x in pdf["matrix"]])
    entry = np.full((len(stack), n), LOW, np.int64)
    entry[0, 0] = 0
    if len(stack) > 1:
        entry[1:] = prefix_scan(stack[:-1])[:, 0, :]
    return pd.DataFrame({"key": pdf["key"], "chunk": pdf["chunk"], "entry": [x.tobytes() for x in entry]})


def _choose_group(pdf: pd.DataFrame) -> pd.DataFrame:
    by = {}
    for chunk, x, e, ids in zip(pdf["chunk"], pdf["exit"], pdf["entered"], pdf["ids"]):
        by.setdefault(int(chunk), {})[int(x)] = (int(e), ids)
    state, picked = 0, []
    for chunk in sorted(by, reverse=True):
        state, ids = by[chunk][state]
        picked.append(ids)
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "doc_id": pd.array([pdf["doc_id"].iloc[0]], "Int64"), "ids": [b"".join(reversed(picked))]})


def _process_model(model_file: str) -> Model:
    """The model of this worker process, kept for its later tasks (as in token_files)."""
    held = sys.modules.setdefault("strandline_worker_state", types.ModuleType("strandline_worker_state")).__dict__.setdefault("models", {})
    if model_file not in held:
        held[model_file] = Model(model_file)
    return held[model_file]


# -- Spark ----------------------------------------------------------------------------


def encode(docs: DataFrame, model_file: str, *, id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids): a row for each row of docs; ids as bytes (see kind_of)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("key", pa.string()), ("chunk", pa.int32()), ("size", pa.int32()), ("part", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _process_model(model_file)
        more = model.longest - 1

        def flush(docs: list, texts: list, rows: list) -> Iterator[pa.RecordBatch]:
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), model.encode_many(texts), *(pa.nulls(len(docs), f.type) for f in list(schema)[2:])], schema=schema)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in it:
            docs_, texts, rows, n = [], [], [], 0
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py() or ""
                if len(t) < chunk:
                    docs_.append(doc)
                    texts.append(t)
                else:
                    s, key = model.normal(t), uuid.uuid4().hex
                    # no chunk is shorter than a piece may reach
                    places = list(range(0, len(s), chunk))
                    if len(s) - places[-1] <= model.longest:
                        places.pop()
                    for k, (a, b) in enumerate(zip(places, [*places[1:], len(s)])):
                        rows.append((doc, None, key, k, b - a, s[a : b + more]))
                n += len(t)
                if n > 1 << 20:
                    yield from flush(docs_, texts, rows)
                    docs_, texts, rows, n = [], [], [], 0
            yield from flush(docs_, texts, rows)

    first = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary, key string, chunk int, size int, part string")
    # keys are drawn once: what follows reads them from the shared folder
    first = stored(first)
    long = first.where("key IS NOT NULL")
    n = Model(model_file).longest

    def model() -> Model:
        return _process_model(model_file)

    def matrices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = [model().transfer(s, size).tobytes() for s, size in zip(batch.column("part").to_pylist(), batch.column("size").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), pa.array(out, pa.binary())], ["key", "chunk", "matrix"])

    def traces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc_id", "chunk", "exit", "entered", "ids"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in it:
            for at in range(0, batch.num_rows, 32):
                rows = batch.slice(at, 32).to_pylist()
                found = model().traces([(r["part"], r["size"], np.frombuffer(r["entry"], np.int64)) for r in rows])
                for r, some in zip(rows, found):
                    out = [(r["key"], r["doc_id"], r["chunk"], *x) for x in some]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    dealt = long.select("key", "doc_id", "chunk", "size", "part").repartition("key", "chunk")
    scanned = dealt.mapInArrow(matrices, "key string, chunk int, matrix binary").groupBy("key").applyInPandas(lambda pdf: _scan_group(pdf, n), "key string, chunk int, entry binary")
    traced = long.select("key", "doc_id", "chunk", "size", "part").join(scanned, ["key", "chunk"]).mapInArrow(traces, "key string, doc_id long, chunk int, exit int, entered int, ids binary")
    whole = traced.groupBy("key").applyInPandas(_choose_group, "key string, doc_id long, ids binary")
    return first.where("key IS NULL").select("doc_id", "ids").unionByName(whole.select("doc_id", "ids"))


def decode(encoded: DataFrame, model_file: str, *, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, ids, text): the texts that ids stand for, some hundred rows at a time."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _process_model(model_file)
        for batch in it:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [None if x is None else model.decode(np.frombuffer(x, model.kind)) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], schema=schema)

    return encoded.select(F.col(id).cast("long").alias("doc_id"), ids).mapInArrow(run, "doc_id long, ids binary, text string")


def ids_kind(model_file: str) -> str:
    """The kind of the ids behind encode()'s bytes."""
    import sentencepiece

    return kind_of(sentencepiece.SentencePieceProcessor(model_file=model_file).get_piece_size())


def ids_of(raw: bytes, model_file: str) -> np.ndarray:
    """The ids behind encode()'s bytes."""
    return np.frombuffer(raw, ids_kind(model_file))
