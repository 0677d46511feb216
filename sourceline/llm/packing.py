"""Token ids in files of fixed-width bits.

Every id takes the fewest bits that the vocabulary needs. Ids are packed in blocks whose byte
offsets stand in the file, so a reader can unpack any range of blocks with numpy and nothing else.

File (little-endian): ``magic 8s, bits u4, block u4, n_ids u8, n_docs u8, payload_at u8``, then
``doc_id i8[n_docs]``, ``id_is_null u1[n_docs]``, ``doc_end u8[n_docs]`` (ids up to the end of the
document), ``block_offset u8[n_blocks + 1]`` (bytes from ``payload_at``), then the packed blocks.

Defined cases: a null text is an empty one and gives the end id alone; a null document id sorts
first; rows that repeat an id stay separate, in the order of a hash of their text; an empty table
gives no files and no rows; columns other than the two named are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path

MAGIC = b"BITIDS01"
HEAD = struct.Struct("<8sIIQQQ")
BLOCK = 1 << 12
FILE_IDS = 1 << 23
READ_BLOCKS = 64
#: Entries of a worker's memo of encoded words; it is emptied when full, which only costs time.
MEMO = 1_000_000
_ENCODERS: dict[str, "WordEncoder"] = {}


def bits_for(vocabulary: int) -> int:
    return max(1, (max(1, vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id as ``bits`` bits, most significant first; zero bits fill the last byte."""
    ids = np.ascontiguousarray(ids, dtype=">u4")
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    flags = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits:]
    return np.packbits(flags).tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f">u{bits // 8}", count=count).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * bits).reshape(count, bits)
    wide = np.zeros((count, 32), dtype=np.uint8)
    wide[:, 32 - bits:] = flags
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


class WordEncoder:
    """Encodes a text word by word and remembers the words.

    The tokenizer drops white space and joins nothing across it, so the ids of a text are those of
    its words one after the other. A text that may name a special token is encoded as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([str(self.tokenizer.id_to_token(i)).endswith("</w>") for i in range(size)])
        self.memo: dict[bytes, bytes] = {}
        self.marks = {mark: self._direct(mark.decode()) for mark in (b".", b",")}

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, missing: set[bytes]) -> None:
        memo = self.memo
        if len(memo) + len(missing) > MEMO:
            memo.clear()
        plain, marked = {}, []
        for word in missing:
            mark = word[-1:]
            stem = word[:-1] if mark in self.marks else word
            if stem and (text := stem.decode("utf-8", "replace")).isalpha():
                if stem not in memo:
                    plain[stem] = text
                if stem is not word:
                    marked.append((word, stem, mark))
            else:
                memo[word] = self._direct(word.decode("utf-8", "replace"))
        words = list(plain.items())
        for at in range(0, len(words), 4096):
            some = words[at:at + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(t for _, t in some), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                data, last = ids.tobytes(), 0
                for (word, _), end in zip(some, (ends * 4).tolist(), strict=True):
                    memo[word] = data[last:end]
                    last = end
            else:
                for word, text in some:
                    memo[word] = self._direct(text)
        for word, stem, mark in marked:
            memo[word] = memo[stem] + self.marks[mark]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for at in range(0, len(texts), 256):
            raw = [t.encode() for t in texts[at:at + 256]]
            split = [None if b"<|" in r else r.lower().split() for r in raw]
            seen: set[bytes] = set()
            for words in split:
                if words:
                    seen.update(words)
            memo = self.memo
            missing = {w for w in seen if w not in memo}
            if missing:
                if len(memo) + len(missing) > MEMO:
                    missing = seen
                self._learn(missing)
            get = memo.__getitem__
            out += [self._direct(r.decode()) if words is None else b"".join(map(get, words))
                    for r, words in zip(raw, split, strict=True)]
        return out


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _open(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_file(path: str, ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, ends: np.ndarray,
               bits: int, block: int = BLOCK) -> None:
    """The file appears under its name only when whole, so a task that is run again replaces it."""
    packed = [pack(ids[i:i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, packed)]).astype("<u8")
    at = HEAD.size + 17 * len(doc_ids) + offsets.nbytes
    store, place = _open(path)
    task = TaskContext.get()
    part = f"{place}.{task.taskAttemptId() if task else 0}.part"
    with store.open_output_stream(part) as out:
        out.write(HEAD.pack(MAGIC, bits, block, len(ids), len(doc_ids), at))
        for piece in (doc_ids.astype("<i8"), nulls.astype("u1"), ends.astype("<u8"), offsets):
            out.write(piece.tobytes())
        for piece in packed:
            out.write(piece)
    store.move(part, place)


class PackedFile:
    """Random access to one file: the tables are read at once, blocks when asked for."""

    def __init__(self, path: str) -> None:
        store, place = _open(path)
        self.source = store.open_input_file(place)
        magic, self.bits, self.block, self.n_ids, self.n_docs, self.at = HEAD.unpack(self.source.read_at(HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of packed ids")
        data, n, p = self.source.read_at(self.at - HEAD.size, HEAD.size), self.n_docs, 0
        self.doc_ids = np.frombuffer(data, "<i8", n, p)
        self.nulls = np.frombuffer(data, "u1", n, p := p + 8 * n)
        self.ends = np.frombuffer(data, "<u8", n, p := p + n).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", -1, p + 8 * n).astype(np.int64)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks ``first`` up to, without, ``last``."""
        start, end = int(self.offsets[first]), int(self.offsets[last])
        data = self.source.read_at(end - start, self.at + start)
        if self.block * self.bits % 8 == 0 or last - first == 1:
            return unpack(data, min(last * self.block, self.n_ids) - first * self.block, self.bits)
        return np.concatenate([self.blocks(i, i + 1) for i in range(first, last)])

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids at positions ``start`` up to, without, ``end``."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first = start // self.block
        return self.blocks(first, -(-end // self.block))[start - first * self.block:end - first * self.block]

    def crcs(self) -> list[int]:
        """crc32 of each document's ids as little-endian unsigned 32-bit integers, in bounded memory."""
        out, doc, crc = [], 0, 0
        ends = self.ends.tolist()
        for first in range(0, len(self.offsets) - 1, READ_BLOCKS):
            last = min(first + READ_BLOCKS, len(self.offsets) - 1)
            data, base = memoryview(self.blocks(first, last).astype("<u4").tobytes()), first * self.block
            at, stop = base, base + len(data) // 4
            while doc < len(ends) and ends[doc] <= stop:
                out.append(zlib.crc32(data[4 * (at - base):4 * (ends[doc] - base)], crc))
                at, crc, doc = ends[doc], 0, doc + 1
            crc = zlib.crc32(data[4 * (at - base):], crc)
        return out


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int | None = None,
              file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into files below ``folder``, in ascending order of doc_id.

    Returns ``file, part, roll, n_ids, n_docs``, one row per file. The order comes from a range
    partition; each task writes the files of its range. Ids of one file are all that a task holds.
    """
    if vocabulary is None:
        from tokenizers import Tokenizer
        vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    bits, end = bits_for(max(vocabulary, end_id + 1)), np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        held: list[bytes] = []
        idents: list[int | None] = []
        size, roll = 0, 0

        def flush() -> pd.DataFrame:
            nonlocal held, idents, size, roll
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            nulls = np.array([i is None for i in idents], dtype="u1")
            name = f"{folder}/ids-{part:06d}-{roll:05d}.bits"
            write_file(name, ids, np.array([i or 0 for i in idents], dtype="<i8"), nulls,
                       np.cumsum([len(h) // 4 for h in held], dtype=np.int64), bits)
            row = pd.DataFrame({"file": [name], "part": [part], "roll": [roll], "n_ids": [len(ids)], "n_docs": [len(idents)]})
            held, idents, size, roll = [], [], 0, roll + 1
            return row

        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at:at + 256]
                for ident, is_null, ids in zip(some["doc_id"].tolist(), some["_null"].tolist(), coder.encode(some["text"].tolist()), strict=True):
                    if size and size + len(ids) // 4 + 1 > file_ids:
                        yield flush()
                    held.append(ids + end)
                    idents.append(None if is_null else int(ident))
                    size += len(ids) // 4 + 1
        if idents:
            yield flush()

    ordered = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
               .withColumn("_order", F.xxhash64("text")).repartitionByRange("doc_id", "_order")
               .sortWithinPartitions("doc_id", "_order")
               .select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "text", F.col("doc_id").isNull().alias("_null")))
    files = ordered.mapInPandas(run, "file string, part int, roll int, n_ids long, n_docs long")
    files.write.parquet(f"{folder}/index")
    return docs.sparkSession.read.parquet(f"{folder}/index")


def read_documents(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, read from them."""
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, base in zip(batch["file"], batch["base"], strict=True):
                packed = PackedFile(name)
                starts = np.concatenate([[0], packed.ends[:-1]])
                yield pd.DataFrame({"doc_id": pd.array(packed.doc_ids, dtype="Int64").copy(), "start": starts + int(base),
                                    "n_tokens": packed.ends - starts, "ids_crc32": packed.crcs()}).assign(
                    doc_id=lambda d, n=packed.nulls: d["doc_id"].mask(n.astype(bool)))

    before = Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return placed.repartition("file").mapInPandas(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` to a new shared folder and describe each document from the files."""
    spark: SparkSession = docs.sparkSession
    return read_documents(write_ids(docs, shared_path(spark, "packed-ids"), tokenizer, end_id))
