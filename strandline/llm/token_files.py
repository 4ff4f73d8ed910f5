"""Token-id files: frequency-ranked ids in byte-aligned variable-length code.

A file holds whole documents in doc_id order:

    magic b"SLTK", version u32, file number u64, documents n u64, tokens m u64,
    doc_id i64[n] (the least i64 stands for a missing one), tokens of each document u64[n],
    control bytes ceil(m / 4), data bytes

All integers are little-endian. Each id is replaced by its rank by falling frequency, so
frequent ids take one byte. Two control bits give a rank's length (1 to 4 bytes), four
ranks share a control byte, and control and data bytes lie apart: a 256-row numpy table
turns control bytes into lengths and everything after that is vectorised. The rank
table is a file of its own: magic b"SLTR", version u32, ids n u64, id u32[n].

Files are written through Spark's text writer (a byte string a file, which the writer
follows with one line feed) and read through its binaryFile reader, so they can be in
any store that Spark reaches.

Defined cases: a null text is empty and gives the end id alone; a missing doc_id sorts
first; rows with equal doc_id keep an order by their ids' hash; extra columns are not read;
an empty table writes a rank table only.
"""

from __future__ import annotations

import struct
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.text import as_bytes, ascii_words, shared_dir, stored
from strandline.llm.wordpiece_counts import _byte_of_symbol

END_ID = 2
TOKENS_A_FILE = 4 << 20
CACHED_WORDS = 500_000
_HEAD = "<4sIQQQ"
_MISSING = np.iinfo(np.int64).min

#: Lengths of four ranks by control byte.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


# -- coding ---------------------------------------------------------------------------


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    ranks = ranks.astype("<u4")
    size = (1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    codes = np.zeros(-(-len(size) // 4) * 4, np.uint8)
    codes[: len(size)] = size - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    widest = int(size.max(initial=1))
    used = np.arange(widest, dtype=np.uint8) < size[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[:, :widest][used].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].ravel()[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    out = data[at].astype(np.uint32)
    for byte in (1, 2, 3):
        more = np.flatnonzero(size > byte)
        if not len(more):
            break
        out[more] |= data[at[more] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


def file_bytes(number: int, doc_ids: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    return b"".join([struct.pack(_HEAD, b"SLTK", 1, number, len(doc_ids), len(ranks)), doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(), control, data])


def read_file(content: bytes, id_of_rank: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(file number, doc_ids, lengths, ids of all documents in order)."""
    magic, _, number, n, m = struct.unpack_from(_HEAD, content)
    if magic != b"SLTK":
        raise ValueError("not a token file")
    at = struct.calcsize(_HEAD)
    doc_ids = np.frombuffer(content, "<i8", n, at)
    lengths = np.frombuffer(content, "<u8", n, at + 8 * n).astype(np.int64)
    at += 16 * n
    control = np.frombuffer(content, np.uint8, -(-m // 4), at)
    data = np.frombuffer(content, np.uint8, -1, at + len(control))
    return number, doc_ids, lengths, id_of_rank[decode_ranks(control, data, m)]


def rank_file(ids: np.ndarray) -> bytes:
    return struct.pack("<4sIQ", b"SLTR", 1, len(ids)) + ids.astype("<u4").tobytes()


def read_rank_file(content: bytes) -> np.ndarray:
    magic, _, n = struct.unpack_from("<4sIQ", content)
    if magic != b"SLTR":
        raise ValueError("not a rank table")
    return np.frombuffer(content, "<u4", n, 16)


# -- tokenizing -----------------------------------------------------------------------


def _plain() -> str:
    """The pattern of texts that the fast way takes: ASCII white space and printable
    characters up to U+024F, for which composing changes nothing and lower-casing goes by
    single characters of the same range (some letters from U+0181 on leave it)."""
    taken = [c for c in [*range(0x20, 0x7F), *range(0xA1, 0x250)] if c != 0xAD and len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 0x250]
    ends = [c for c, d in zip(taken, [*taken[1:], 0]) if d != c + 1]
    begins = [d for c, d in zip([0, *taken], taken) if d != c + 1]
    return r"[\t-\r" + "".join(rf"\u{x:04x}-\u{y:04x}" for x, y in zip(begins, ends)) + "]*+"


PLAIN = _plain()

#: The pattern of pre-tokens that the tokenizer file has (a fixed value). Without an
#: apostrophe in the text its first alternatives never match.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _kinds() -> np.ndarray:
    """What PATTERN tells apart, of each character that PLAIN admits."""
    of = {"L": _LETTER, "N": _NUMBER}
    return np.array([_SPACE if c <= 0x20 else of.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x250)], np.uint8)


def cut_plain(texts: list[bytes], kinds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(pre-tokens of the texts in order, how many each has), as PATTERN cuts texts of
    characters that PLAIN admits, without an apostrophe."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    kind = kinds[raw]
    first = np.flatnonzero(raw >= 0xC0)  # of two bytes
    kind[first] = kind[first + 1] = kinds[(raw[first] & 31).astype(np.uint16) << 6 | raw[first + 1] & 63]
    begins = np.empty(len(raw), bool)
    begins[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= (kind == _NUMBER) & (raw & 0xC0 != 0x80)
    begins &= kind != _SPACE
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    starts = np.flatnonzero(begins)
    used = kind != _SPACE
    at = np.append(np.flatnonzero(begins[used]), np.count_nonzero(used))
    cut = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(raw[used])])
    return cut, np.diff(np.searchsorted(starts, ends), prepend=0)


class WordCache:
    """Ids of texts by way of their pre-tokens, each encoded once.

    Plain texts are lower-cased and cut as the file's own pattern does, many at a time;
    Arrow finds the distinct pre-tokens and those known already. New ones go to the file's
    BPE model many at a time, as words of one line: the model ends each with a piece that
    carries the word-end mark, where the ids are cut again. Of a text with anything unusual
    each whitespace-separated word goes through the whole tokenizer (pre-tokens never span
    ASCII white space, which the tokenizer drops)."""

    def __init__(self, tokenizer_file: str, kind: str = "<u4", limit: int = CACHED_WORDS):
        import json

        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.limit, self.odd = limit, {}
        self.parts, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.kind, self.size = kind, np.dtype(kind).itemsize
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        mark = spec["model"].get("end_of_word_suffix")
        steps = spec.get("pre_tokenizer", {}).get("pretokenizers", [{}])
        self.fast = bool(mark) and spec["normalizer"]["normalizers"][-1]["type"] == "Lowercase" and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        if self.fast:
            self.model = Tokenizer.from_file(tokenizer_file)
            self.model.normalizer = normalizers.Sequence([])
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.last = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
            self.last[[i for w, i in spec["model"]["vocab"].items() if w.endswith(mark)]] = True
            pattern = steps[0]["pattern"]["Regex"]
            self.find = regex.compile(pattern).findall
            self.kinds = _kinds() if pattern == PATTERN else None
            self.plain = regex.compile(PLAIN).fullmatch
            self.shown = str.maketrans({chr(b): c for c, b in _byte_of_symbol().items() if b != 0x20})

    def _learn(self, parts: list[str]) -> pa.Array:
        """The ids of new pre-tokens."""
        found, cuts = [], [np.zeros(1, np.int64)]
        n = 0
        for at in range(0, len(parts), 200):
            some = parts[at : at + 200]
            line = " ".join(some)
            if not line.isascii():
                line = line.encode().decode("latin-1").translate(self.shown)
            ids = np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                raise ValueError("the model did not end each word with its mark")
            found.append(ids.astype(self.kind))
            cuts.append(n + ends)
            n += len(ids)
        raw = np.concatenate([np.zeros(0, self.kind), *found])
        return pa.Array.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(self.size * np.concatenate(cuts)), pa.py_buffer(raw)])

    def _parts(self, parts: pa.Array) -> pa.Array:
        """The ids of distinct pre-tokens."""
        place = pc.index_in(parts, self.parts)
        unknown = place.is_null()
        new = parts.filter(unknown)
        ids = pa.concat_arrays([self.ids, self._learn(new.to_pylist())])
        place = np.array(place.fill_null(0), np.int64)
        place[np.asarray(unknown)] = len(self.parts) + np.arange(len(new))
        out = ids.take(pa.array(place))
        if len(ids) > self.limit:
            self.parts, self.ids = parts, out  # those of the texts at hand stay
        else:
            self.parts, self.ids = pa.concat_arrays([self.parts, new]), ids
        return out

    def _odd_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of words by the whole tokenizer."""
        if len(self.odd) > self.limit:
            self.odd = {}
        new = list(set(words).difference(self.odd))
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)):
                self.odd[w] = np.array(e.ids, self.kind).tobytes()
        return list(map(self.odd.__getitem__, words))

    def encode(self, texts: list[bytes | None], end: bytes = b"") -> pa.Array:
        """The ids of each text, and end, as bytes of the kind."""
        plain, quoted, odd = {}, {}, {}
        for k, t in enumerate(texts):
            s = (t or b"").decode("utf-8", "replace")
            if not self.fast or "<|" in s or self.plain(s) is None:
                odd[k] = ascii_words(t or b"")
            elif self.kinds is None or "'" in s:
                quoted[k] = self.find(s.lower())
            else:
                plain[k] = s.lower().encode()
        cut, counts = cut_plain(list(plain.values()), self.kinds) if plain else (self.parts[:0], np.zeros(0, np.int64))
        if quoted:
            cut = pa.concat_arrays([cut, pa.array([p for ps in quoted.values() for p in ps], pa.large_string())])
        distinct = cut.dictionary_encode()
        ids = self._parts(distinct.dictionary)
        found, last = self._odd_words([w for ws in odd.values() for w in ws]), 0
        whole = []
        for ws in odd.values():
            whole.append(b"".join(found[last : last + len(ws)]))
            last += len(ws)
        # the texts kind by kind: each one's pre-tokens, or the whole text, and the end
        counts = np.concatenate([counts, [len(ps) for ps in quoted.values()], [1] * len(odd)]).astype(np.int64)
        place = np.concatenate([np.asarray(distinct.indices, np.int64), len(ids) + np.arange(len(odd))])
        place = np.insert(place, np.cumsum(counts), len(ids) + len(odd))
        _, at, data = pa.concat_arrays([ids, pa.array([*whole, end], pa.large_binary())]).take(pa.array(place)).buffers()
        at = np.frombuffer(at, np.int64)[np.append(0, np.cumsum(counts + 1))]
        out = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at), data]).cast(pa.binary())
        return out if len(plain) == len(texts) else out.take(pa.array(np.argsort([*plain, *quoted, *odd])))


def _process_cache(tokenizer_file: str, kind: str) -> WordCache:
    """The cache of this worker process, kept for its later tasks. Functions travel by
    value, so what outlives a task is in a module of our own made in the worker."""
    held = sys.modules.setdefault("strandline_worker_state", types.ModuleType("strandline_worker_state")).__dict__.setdefault("caches", {})
    if (tokenizer_file, kind) not in held:
        held[tokenizer_file, kind] = WordCache(tokenizer_file, kind)
    return held[tokenizer_file, kind]


def _chunks(texts: list[bytes | None], size: int = 8 << 20) -> Iterator[list[bytes | None]]:
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t or b"")
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def token_rows(docs: DataFrame, tokenizer_file: str, *, id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids, counts): ids as bytes, u16 where the vocabulary allows, with the end
    id. A task adds a row with counts alone, how often it gave each id, as i64 bytes."""
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer_file).get_vocab_size(with_added_tokens=True)
    kind = "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = _process_cache(tokenizer_file, kind)
        end = np.array([end_id], kind).tobytes()
        total = np.zeros(max(size, end_id + 1), "<i8")
        for batch in it:
            docs_, at = batch.column(0), 0
            for texts in _chunks(as_bytes(batch.column(1))):
                ids = cache.encode(texts, end)
                total += np.bincount(_joined(ids, kind), minlength=len(total))
                yield pa.RecordBatch.from_arrays([docs_.slice(at, len(texts)), ids, pa.nulls(len(texts), pa.binary())], schema=schema)
                at += len(texts)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([total.tobytes()], pa.binary())], schema=schema)

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary, counts binary")
    rows._strandline_kind = kind
    return rows


def _joined(ids: pa.Array, kind: str) -> np.ndarray:
    """The ids of all rows, one after another."""
    _, at, data = ids.buffers()
    at = np.frombuffer(at, np.int32)[ids.offset :]
    return np.frombuffer(data, np.uint8)[at[0] : at[len(ids)]].view(kind)


def counts_by_id(rows: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs; a row for each id and task is shuffled."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in it:
            for raw in batch.column(0).to_pylist():
                total = total + np.frombuffer(raw, "<i8")
        seen = np.flatnonzero(total)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], schema=schema)

    return rows.where("counts IS NOT NULL").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# -- writing and reading --------------------------------------------------------------


def write(docs: DataFrame, folder: str, tokenizer_file: str, *, id: str = "doc_id", text: str = "text", end_id: int = END_ID, tokens_a_file: int = TOKENS_A_FILE) -> None:
    """Tokenizes docs and writes ``folder``/ranks and ``folder``/tokens."""
    spark = docs.sparkSession
    fresh_rows = token_rows(docs, tokenizer_file, id=id, text=text, end_id=end_id)
    kind = fresh_rows._strandline_kind
    rows = stored(fresh_rows)
    counts = counts_by_id(rows).orderBy(F.desc("n"), "id").collect()  # a row for each id of the vocabulary at most
    id_of_rank = np.array([r["id"] for r in counts], np.uint32)
    rank_of_id = np.zeros(int(id_of_rank.max()) + 1 if len(id_of_rank) else 1, np.uint32)
    rank_of_id[id_of_rank] = np.arange(len(id_of_rank), dtype=np.uint32)
    spark.createDataFrame([(bytearray(rank_file(id_of_rank)),)], "b binary").select(F.col("b").cast("string")).coalesce(1).write.text(f"{folder}/ranks")
    total = sum(r["n"] for r in counts)
    held = spark.sparkContext.broadcast(rank_of_id)
    schema = pa.schema([("file", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ranks, part, nth = held.value, TaskContext.get().partitionId(), 0
        docs_, lengths, parts, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal docs_, lengths, parts, size, nth
            blob = file_bytes(part << 32 | nth, np.array(docs_, np.int64), np.array(lengths, np.int64), np.concatenate(parts))
            docs_, lengths, parts, size, nth = [], [], [], 0, nth + 1
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], schema=schema)

        for batch in it:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs_.append(_MISSING if doc is None else doc)
                parts.append(ranks[np.frombuffer(ids, kind)])
                lengths.append(len(parts[-1]))
                size += lengths[-1]
                if size >= tokens_a_file:
                    yield flush()
        if docs_:
            yield flush()

    n_parts = max(1, -(-total // tokens_a_file))
    dealt = rows.where("counts IS NULL").select("doc_id", "ids").withColumn("tie", F.xxhash64("ids")).repartitionByRange(n_parts, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    files = dealt.select("doc_id", "ids").mapInArrow(run, "file binary")
    files.select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).text(f"{folder}/tokens")


def read_ranks(spark: SparkSession, folder: str) -> np.ndarray:
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/ranks").select("content").first()[0]
    return read_rank_file(bytes(content))


def _documents(content: bytes, id_of_rank: np.ndarray) -> Iterator[tuple[int, np.ndarray, list, list[bytes]]]:
    """(file number, tokens before, doc_ids, ids as little-endian u32 bytes) of some
    thousand documents of a file at a time."""
    number, doc_ids, lengths, ids = read_file(content, id_of_rank)
    raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
    starts = ends - lengths
    for a in range(0, len(doc_ids), 2000):
        b = min(a + 2000, len(doc_ids))
        yield number, starts[a:b], [None if d == _MISSING else d for d in doc_ids[a:b].tolist()], [raw[4 * x : 4 * y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())]


def _scan(spark: SparkSession, folder: str, ddl: str, each) -> DataFrame:
    """(file, at, doc_id, ...): each() makes the further columns of documents' ids."""
    held = spark.sparkContext.broadcast(read_ranks(spark, folder))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                for number, at, docs, ids in _documents(batch.column(0)[i].as_py(), held.value):
                    more = each(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), number, np.int64)), pa.array(at), pa.array(docs, pa.int64()), *more.values()], ["file", "at", "doc_id", *more])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/tokens").select("content")
    return files.mapInArrow(run, f"file long, at long, doc_id long, {ddl}")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(file, at, doc_id, ids): every document of the files; ids as little-endian u32
    bytes; file and at (tokens before it in its file) give the order."""
    return _scan(spark, folder, "ids binary", lambda ids: {"ids": pa.array(ids, pa.binary())})


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    docs = stored(_scan(spark, folder, "n_tokens long, ids_crc32 long", lambda ids: {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64())}))
    # one row for each file of some millions of tokens
    sizes = docs.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return docs.join(before, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_file: str, **options) -> DataFrame:
    """Writes docs to the shared folder and reads the files back."""
    folder = shared_dir(docs.sparkSession)
    write(docs, folder, tokenizer_file, **options)
    return summary(docs.sparkSession, folder)
