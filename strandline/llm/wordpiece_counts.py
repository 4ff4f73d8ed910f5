"""Token counts by a linear longest-match automaton.

Greedy longest-match-first word pieces, counted in time linear in the text. A trie over
the vocabulary's bytes gets, for each node, a failure link (where matching goes on after
the node's pieces are taken off) and the number of pieces taken off on the way. Counting
a word follows one arc or link a step and adds those numbers; pieces are never built.

Defined cases: a null or empty text has no words and no tokens; very long texts are counted
whole; a word that no sequence of pieces covers counts as one unknown token; there are no
ties, the longest piece is one; repeated rows each get their counts; an empty table gives an
empty one; a column named like ``into`` (case aside) is replaced, other extra columns come
along whatever their names.
"""

from __future__ import annotations

import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import ascii_words, scalar_struct

CACHED_WORDS = 400_000


class Automaton:
    """first: pieces that may begin a word; rest: pieces that may follow another one."""

    def __init__(self, first: set[bytes], rest: set[bytes]):
        self.arcs: list[dict[int, int]] = [{}]
        self.ends: list[bool] = [False]
        self.suffix_root = 0 if first == rest else self._node()
        for root, pieces in ((0, first), *([(self.suffix_root, rest)] * (self.suffix_root > 0))):
            for piece in pieces:
                at = root
                for byte in piece:
                    after = self.arcs[at].get(byte)
                    if after is None:
                        after = self.arcs[at][byte] = self._node()
                    at = after
                self.ends[at] = bool(piece)
        self._link()

    def _node(self) -> int:
        self.arcs.append({})
        self.ends.append(False)
        return len(self.arcs) - 1

    def _link(self) -> None:
        n = len(self.arcs)
        self.fail, self.popped = [-1] * n, [0] * n
        level = [0] if self.suffix_root == 0 else [0, self.suffix_root]
        while level:
            after = []
            for u in level:
                for byte, v in self.arcs[u].items():
                    after.append(v)
                    if self.ends[v]:
                        self.fail[v], self.popped[v] = self.suffix_root, 1
                        continue
                    z, pieces = self.fail[u], self.popped[u]
                    while z >= 0 and byte not in self.arcs[z]:
                        pieces += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.arcs[z][byte], pieces
            level = after

    def count(self, word: bytes) -> int:
        """Pieces of a word; -1 if it can't be covered."""
        arcs, fail, popped = self.arcs, self.fail, self.popped
        at = n = 0
        for byte in word:
            after = arcs[at].get(byte)
            while after is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return -1
                after = arcs[at].get(byte)
            at = after
        while at != self.suffix_root:
            if fail[at] < 0:
                return -1 if at else n
            n += popped[at]
            at = fail[at]
        return n


def _byte_of_symbol() -> dict[str, int]:
    """The printable symbols that byte-level vocabularies write bytes with."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def pieces_of(tokenizer_file: str) -> set[bytes]:
    """The pieces of a byte-level vocabulary file as bytes, word-end marks taken off."""
    with open(tokenizer_file, encoding="utf-8") as f:
        model = json.load(f)["model"]
    mark, byte_of = model.get("end_of_word_suffix") or "", _byte_of_symbol()
    found = set()
    for piece in model["vocab"]:
        piece = piece.removesuffix(mark) if mark and piece != mark else piece
        if piece and all(c in byte_of for c in piece):
            found.add(bytes(byte_of[c] for c in piece))
    return found


#: Runs of letters, single digits, runs of other signs.
WORD = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def count_tokens(docs: DataFrame, pieces: set[bytes], *, rest: set[bytes] | None = None, text: str = "text", into: str = "tokens", cached: int = CACHED_WORDS) -> DataFrame:
    """docs with a struct ``into``: n_words, n_tokens, n_unknown. Texts are lower-cased."""
    held = docs.sparkSession.sparkContext.broadcast((pieces, rest if rest is not None else pieces))
    state: dict = {}

    def run(texts: list[bytes | None]) -> list[list]:
        if not state:
            state["find"] = regex.compile(WORD).findall
            state["count"] = Automaton(*held.value).count
            state["known"] = {}
        find, count, known = state["find"], state["count"], state["known"]
        out = []
        for t in texts:
            words = tokens = unknown = 0
            for chunk in ascii_words(t or b""):
                got = known.get(chunk)
                if got is None:
                    counts = [count(w.encode()) for w in find(chunk.decode("utf-8", "replace").lower())]
                    bad = sum(c < 0 for c in counts)
                    got = (len(counts), sum(counts) + 2 * bad, bad)
                    if len(known) >= cached:
                        known.clear()
                    known[chunk] = got
                words += got[0]
                tokens += got[1]
                unknown += got[2]
            out.append((words, tokens, unknown))
        return list(zip(*out)) or [[], [], []]

    counted = scalar_struct(run, "struct<n_words:bigint,n_tokens:bigint,n_unknown:bigint>")
    return docs.withColumn(into, counted(F.col(text)))
