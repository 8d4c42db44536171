"""Token ids in files of patched frame-of-reference blocks, with an index of block starts.

A stream of unsigned numbers is cut into blocks of 1,024. A block stores its minimum, the differences
to it packed at the bit width that holds a given percentile of them, and an exception list (place and
high bits) for the values that need more. Blocks differ in size, so a file keeps the start of each;
any stretch of ids is read by decoding only the blocks it touches.

A file holds whole documents in ascending doc_id order, about ``FILE_IDS`` ids (one document may be
longer). All numbers are little-endian:

    magic, 8 bytes
    blocks of token ids | of token counts per document | of steps between consecutive doc_ids
    start of every block, u64, stream by stream
    footer: file number, n_ids, n_documents, n_null_doc_ids, first doc_id, blocks of each stream,
            place of the index, crc32 of all before it, magic
    one line feed (Spark's writer ends a record with it)

    block: count u16, width u8, bytes of an exception's high part u8, exceptions u16, zero u16,
           minimum u64, packed words u64 x width x ceil(count / 64), places u16, high parts

The end id may also occur inside a text, so the counts, not the end ids, part the documents.

Texts are range-partitioned by doc_id, encoded and written in one stage; a file is a record of Spark's
text writer, so that only committed tasks leave files, and the number in its footer (partition, place
in the partition) orders the files. Starts are sums over files, one row each.

Defined cases: a null text counts as empty and has the end id alone. Rows without doc_id come first;
rows with equal doc_id follow one another by a hash of the text, then by their place in the input, so
a hot doc_id is spread over many tasks. An empty table writes no document. Only doc_id and text are
read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.session import materialise, scratch_path

MAGIC = b"PFORIDS1"
BLOCK = 1024
#: Share of a block's differences that the packed width has to hold.
PERCENTILE = 0.95
#: Ids after which a file is closed.
FILE_IDS = 1 << 22
#: Blocks worked on at once.
_CHUNK = 256
_HEAD = struct.Struct("<HBBHHQ")
_FOOT = struct.Struct("<qQQQq3QQI8s")
_POWERS = np.array([1 << k for k in range(64)], np.uint64)
#: White space of the pretokenizer's pattern (the Unicode property).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNKS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+$")
_LEADING = re.compile(f"[{_SPACE}]+[^{_SPACE}]")
#: A line feed before a letter, a word of Latin letters, and what follows it: an ASCII symbol.
_LETTER = r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]"
_WORD = re.compile(f"(\n(?={_LETTER}))?( ?{_LETTER}+)(?:$|(?=[!-/:-@\\[-`{{-~]))")
#: Chunks whose ids a worker keeps.
CACHE = 1_000_000


# ---- blocks

def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 numbers below 2**width as rows of `width` 64-bit words."""
    words = np.zeros((width, len(values)), np.uint64)
    for i, column in enumerate(np.ascontiguousarray(values.T) if width else ()):
        word, shift = divmod(i * width, 64)
        words[word] |= column << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= column >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The rows of 64 numbers that ``pack`` was given."""
    out = np.zeros((64, len(words)), np.uint64)
    mask = np.uint64((1 << width) - 1)
    columns = np.ascontiguousarray(words.T)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        out[i] = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= columns[word + 1] << np.uint64(64 - shift)
        out[i] &= mask
    return np.ascontiguousarray(out.T)


def encode_blocks(values: np.ndarray, percentile: float = PERCENTILE) -> Iterator[bytes]:
    """Blocks of a stream of unsigned 64-bit numbers, in order."""
    for low in range(0, len(values), _CHUNK * BLOCK):
        part = values[low:low + _CHUNK * BLOCK].astype(np.uint64)
        counts = [min(BLOCK, len(part) - k) for k in range(0, len(part), BLOCK)]
        if counts[-1] < BLOCK:  # filled up with its last value; the count says where it ends
            part = np.concatenate([part, np.full(BLOCK - counts[-1], part[-1], np.uint64)])
        rows = part.reshape(-1, BLOCK)
        base = rows.min(axis=1)
        rows = rows - base[:, None]
        rank = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
        width = np.searchsorted(_POWERS, np.partition(rows, rank, axis=1)[:, rank], side="right")
        high = np.where(width[:, None] < 64, rows >> np.minimum(width, 63)[:, None].astype(np.uint64),
                        np.uint64(0))
        packed: list[np.ndarray] = [np.zeros(0)] * len(rows)
        for w in np.unique(width).tolist():
            which = np.flatnonzero(width == w)
            low_bits = rows[which] & np.uint64((1 << w) - 1)
            words = pack(low_bits.reshape(-1, 64), w).reshape(len(which), BLOCK // 64, w)
            for k, row in zip(which.tolist(), words):
                packed[k] = row
        odd = high.any(axis=1)
        for k, count in enumerate(counts):
            at = np.flatnonzero(high[k, :count]) if odd[k] else np.zeros(0, np.int64)
            above = high[k, at]
            top = int(above.max()) if len(at) else 0
            size = 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
            yield b"".join((
                _HEAD.pack(count, int(width[k]), size, len(at), 0, int(base[k])),
                packed[k][:-(-count // 64)].tobytes(), at.astype("<u2").tobytes(),
                above.astype(f"<u{size}").tobytes()))


def decode_blocks(content: bytes, starts: Iterable[int]) -> np.ndarray:
    """Numbers of the blocks that begin at the given places, one after another."""
    found = []  # (count, width, base, words, places, high parts)
    by_width: dict[int, list[int]] = {}
    for k, at in enumerate(starts):
        count, width, size, odd, _, base = _HEAD.unpack_from(content, at)
        at += _HEAD.size
        groups = -(-count // 64)
        words = np.frombuffer(content, "<u8", groups * width, at).reshape(groups, width)
        at += groups * width * 8
        places = np.frombuffer(content, "<u2", odd, at)
        above = np.frombuffer(content, f"<u{size}", odd, at + 2 * odd)
        found.append((count, width, base, words, places, above))
        by_width.setdefault(width, []).append(k)
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(found)
    for width, blocks in by_width.items():
        for low in range(0, len(blocks), _CHUNK):
            some = blocks[low:low + _CHUNK]
            rows = unpack(np.concatenate([found[k][3] for k in some]), width)
            row = 0
            for k in some:
                count, _, base, words, places, above = found[k]
                values = rows[row:row + len(words)].reshape(-1)[:count]
                row += len(words)
                if len(places):
                    values[places] |= above.astype(np.uint64) << np.uint64(width)
                out[k] = values + np.uint64(base)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


# ---- files

def file_bytes(number: int, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: documents in ascending order, those without doc_id first."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    steps = np.diff(known.view(np.uint64), prepend=known.view(np.uint64)[:1])
    parts, starts, sizes, at = [MAGIC], [], [], len(MAGIC)
    for stream in (ids, counts, steps):
        before = len(starts)
        for block in encode_blocks(stream):
            starts.append(at)
            at += len(block)
            parts.append(block)
        sizes.append(len(starts) - before)
    parts.append(np.array(starts, "<u8").tobytes())
    body = b"".join(parts)
    first = int(known[0]) if len(known) else 0
    return body + _FOOT.pack(number, len(ids), len(doc_ids), len(doc_ids) - len(known), first, *sizes,
                             at, zlib.crc32(body), MAGIC)


class TokenFile:
    """Reader of one file's bytes; blocks are decoded when they are asked for."""

    def __init__(self, content: bytes):
        end = len(content) - 1  # the line feed
        if end < len(MAGIC) + _FOOT.size or content[:8] != MAGIC or content[end - 8:end] != MAGIC:
            raise ValueError("not a whole token file")
        (self.number, self.n_ids, self.n_docs, self.n_null, self.first, *self._blocks, index, check,
         _) = _FOOT.unpack_from(content, end - _FOOT.size)
        if zlib.crc32(memoryview(content)[:end - _FOOT.size]) != check:
            raise ValueError("damaged token file")
        self.content = content
        self._starts = np.frombuffer(content, "<u8", sum(self._blocks), index)

    def _stream(self, k: int) -> np.ndarray:
        low = sum(self._blocks[:k])
        return decode_blocks(self.content, self._starts[low:low + self._blocks[k]].tolist())

    def counts(self) -> np.ndarray:
        """Token count of every document."""
        return self._stream(1).astype(np.int64)

    def doc_ids(self) -> list[int | None]:
        steps = self._stream(2)
        known = (np.cumsum(steps, dtype=np.uint64)
                 + np.array([self.first], np.int64).view(np.uint64)).view(np.int64)
        return [None] * self.n_null + known.tolist()

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from start up to stop, from the blocks that hold them."""
        start, stop = max(start, 0), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        low, high = start // BLOCK, -(-stop // BLOCK)
        values = decode_blocks(self.content, self._starts[low:high].tolist())
        return values[start - low * BLOCK:stop - low * BLOCK].astype("<u4")


# ---- encoding

def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary file writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Ids of texts by the tokenizers library, as little-endian 32-bit numbers.

    With a byte-level pretokenizer nothing joins a letter or symbol to white space behind it: a match
    of the pattern takes white space only at its begin, and special strings hold none. A text is
    therefore the sequence of its chunks (white space, then what is no white space), each encoded by
    itself, and a chunk seen before need not be encoded again. Nor does the pattern join a line feed
    to a letter behind it, or a letter to an ASCII symbol behind it, so a new chunk is cut there: its
    word may be known. New words are given to the library's model as the pretokens they are; other
    new chunks are joined into longer texts and parted by the known byte lengths of the tokens. Other
    tokenizers get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.in_chunks = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
            and pre.get("use_regex", True) and spec.get("normalizer") is None
            and not (spec["model"].get("dropout") or spec["model"].get("unk_token"))
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"]
                        or re.search(f"[{_SPACE}]", t["content"]) for t in added))
        if self.in_chunks:
            size = self.tokenizer.get_vocab_size()
            self.lengths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)])
            for t in added:
                self.lengths[t["id"]] = len(t["content"].encode())
            self.model = Tokenizer(self.tokenizer.model)  # takes pretokens
            self.letters = {b: c for c, b in _byte_letters().items()}
        # matches nothing where there are no special strings
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added) or r"(?!)")
        self._known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in
                self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: set[str]) -> None:
        """Encode what is new in new chunks."""
        known, match, special = self._known, _WORD.match, self.special
        words, others, made = [], [], []
        for c in chunks:
            found = match(c)
            if found is None:
                others.append(c)
                continue
            head, word = found.groups()
            if head is None and len(word) == len(c):
                words.append(c)
            elif special.search(c):
                others.append(c)
            else:
                made.append((c, head or "", word, c[found.end():]))
        # the parts of cut chunks that are not new themselves
        fresh = {m[2] for m in made}.difference(known, words)
        self._learn_words([*words, *fresh])
        ends = {m[1] for m in made}.union(m[3] for m in made) - {""}
        self._learn_others(list(ends.difference(known, others)) + others)
        known[""] = b""
        known.update((c, known[head] + known[word] + known[rest]) for c, head, word, rest in made)

    def _store(self, chunks: list[str], ids: np.ndarray, sizes: list[int]) -> None:
        """Part the ids of joined chunks by the chunks' sizes in bytes."""
        cuts = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes)) + 1
        raw, cuts = ids.tobytes(), (4 * cuts).tolist()
        self._known.update(zip(chunks, (raw[a:b] for a, b in zip([0, *cuts], cuts))))

    def _learn_words(self, words: list[str]) -> None:
        """Words are single pretokens, written as the vocabulary file writes their bytes."""
        blank = self.letters[32]
        for low in range(0, len(words), 1024):
            some = words[low:low + 1024]
            spelt = [w.replace(" ", blank) if w.isascii() else
                     w.encode().decode("latin-1").translate(self.letters) for w in some]
            found = self.model.encode_batch_fast([spelt], is_pretokenized=True,
                                                 add_special_tokens=False)[0]
            self._store(some, np.array(found.ids, "<u4"), list(map(len, spelt)))

    def _learn_others(self, chunks: list[str]) -> None:
        """Only chunks that begin with white space and hold more can be joined."""
        joined, alone = [], []
        for c in chunks:
            (joined if _LEADING.match(c) else alone).append(c)
        self._known.update(zip(alone, self._whole(alone)))
        for low in range(0, len(joined), 1024):
            some = joined[low:low + 1024]
            found = self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0]
            self._store(some, np.array(found.ids, "<u4"), [len(c.encode()) for c in some])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text."""
        if not self.in_chunks:
            return self._whole(texts)
        chunks = [_CHUNKS.findall(t) for t in texts]
        if len(self._known) > CACHE:
            self._known.clear()
        self._learn(set().union(*chunks).difference(self._known))
        return [b"".join(map(self._known.__getitem__, c)) for c in chunks]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _files(path: str, end_id: int, file_ids: int):
    def run(batches):
        code, end = encoder(path), np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 32
        doc_ids, rows, size = [], [], 0

        def closed():
            counts = np.array([len(r) // 4 for r in rows], np.uint64)
            made = file_bytes(number, doc_ids, counts, np.frombuffer(b"".join(rows), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["file"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            low = 0
            while low < len(ids):  # about a megabyte of text at a time
                high, chars = low, 0
                some = []
                while high < len(ids) and chars < 1 << 20:
                    some.append(texts[high].as_py() or "")
                    chars += len(some[-1])
                    high += 1
                for doc, row in zip(ids[low:high], code.encode(some)):
                    doc_ids.append(doc)
                    rows.append(row + end)
                    size += len(row) // 4 + 1
                    if size >= file_ids:
                        yield closed()
                        doc_ids, rows, size, number = [], [], 0, number + 1
                low = high
        if doc_ids:
            yield closed()
    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, file_ids: int = FILE_IDS) -> None:
    """Encode every text, append the end id and write the files below `path`, which must be new."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("tie"),
        F.monotonically_increasing_id().alias("place"))
    keys = [F.col("doc_id").asc_nulls_first(), "tie", "place"]
    made = (rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
            .mapInArrow(_files(tokenizer, end_id, file_ids), "file binary"))
    # the text writer puts the bytes of a string down as they are
    (made.select(F.col("file").cast("string").alias("value")).write
     .option("maxRecordsPerFile", 1).mode("errorifexists").text(path))


def _documents(with_ids: bool):
    def run(batches):
        for batch in batches:
            for value in batch.column(0):
                content = value.as_py()
                if not content:  # Spark's empty file of an empty table
                    continue
                file = TokenFile(content)
                counts = file.counts()
                ends = np.cumsum(counts)
                doc_ids, low = pa.array(file.doc_ids(), pa.int64()), 0
                while low < len(counts):  # about a million ids at a time
                    first = int(ends[low] - counts[low])
                    high = max(low + 1, int(np.searchsorted(ends, first + (1 << 20), "right")))
                    ids = file.ids(first, int(ends[high - 1]))
                    raw = ids.tobytes()
                    cuts = (4 * (ends[low:high] - first)).tolist()
                    check = [zlib.crc32(raw[a:b]) for a, b in zip([0, *cuts], cuts)]
                    columns = [pa.array([file.number] * (high - low), pa.int64()),
                               doc_ids.slice(low, high - low),
                               pa.array((ends - counts)[low:high]), pa.array(counts[low:high]),
                               pa.array(check, pa.int64())]
                    names = ["file", "doc_id", "start_in_file", "n_tokens", "ids_crc32"]
                    if with_ids:
                        bounds = np.concatenate([[0], ends[low:high] - first]).astype(np.int32)
                        columns.append(pa.ListArray.from_arrays(pa.array(bounds),
                                                                pa.array(ids.astype(np.int64))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    low = high
    return run


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(file, doc_id, start_in_file, n_tokens, ids_crc32[, ids]) of every document in the files."""
    schema = "file long, doc_id long, start_in_file long, n_tokens long, ids_crc32 long"
    return (spark.read.format("binaryFile").load(path).select("content")
            .mapInArrow(_documents(with_ids), schema + (", ids array<long>" if with_ids else "")))


def with_starts(read_back: DataFrame) -> DataFrame:
    """Add `start`, the ids of all documents before; read_back is a table of rows of ``read``.

    Sizes of files are added up inside each partition of the writer and then over the partitions, so
    the one window without a key sees a row for each partition.
    """
    part, place = F.shiftright("file", 32), F.col("file")
    files = read_back.groupBy("file").agg(F.sum("n_tokens").alias("ids_")).withColumn("part_", part)
    inside = Window.partitionBy("part_").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part_").agg(F.sum("ids_").alias("all_"))
    parts = parts.select("part_", F.coalesce(F.sum("all_").over(before), F.lit(0)).alias("before_"))
    starts = (files.withColumn("inside_", F.coalesce(F.sum("ids_").over(inside), F.lit(0)))
              .join(parts, "part_").select("file", (F.col("before_") + F.col("inside_")).alias("at_")))
    return (read_back.join(starts, "file")
            .withColumn("start", F.col("at_") + F.col("start_in_file")).drop("at_"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file) of every document as read back from the files."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write(docs, path, tokenizer, end_id)
    found = materialise(read(spark, path), "token-documents")
    return with_starts(found).select("doc_id", "start", "n_tokens", "ids_crc32", "file")
