"""Token ids: whole texts are encoded with a public tokenizer and written as files of packed blocks."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import partitions, read_file, scratch, stored, write_file
from docloom.llm.pfor import Reader, dump

END = 0
#: The pattern by which the tokenizer cuts text (a fixed value of the vocabulary).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Ids in a file; a longer document has a file of its own.
FILE_IDS = 4_000_000
#: Cached pieces of text a worker keeps.
CACHE = 500_000
#: Where a text holds one of these it is encoded in one go: white space whose runs the tokenizer splits by what follows,
#: characters outside Latin letters, and the form of special tokens.
WHOLE = re.compile(r"\s\s|[^\n -~¡-ɏ]|<\||^\s|\s$|\x00")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces(dict):
    """The ids of pieces of text, found on first use.

    A piece is cut by the tokenizer's own pattern, and each cut goes through the library's BPE model. A word of letters
    alone is one cut; so is a mark after it, which ends the piece.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenize = tokenizer.model.tokenize
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE shows these bytes as themselves
        others = [b for b in range(256) if b not in plain]
        self.shown = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}
        self.space = chr(self.shown[32])
        self.packed = [k.to_bytes(4, "little") for k in range(tokenizer.get_vocab_size())]

    def bpe(self, cut: str) -> bytes:
        if cut.isascii() and cut[1:].isalpha() and (cut[0] == " " or cut[0].isalpha()):
            shown = self.space + cut[1:] if cut[0] == " " else cut
        else:
            shown = cut.encode().decode("latin-1").translate(self.shown)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(shown)])

    def __missing__(self, piece: str) -> bytes:
        word = piece[1:] if piece[:1] == " " else piece
        if word.isalpha():
            found = self.bpe(piece)
        elif word[-1:] in (".", ",") and word[:-1].isalpha():
            found = self[piece[:-1]] + self.mark[word[-1]]
        else:
            found = b"".join([self[c] if c != piece else self.bpe(c) for c in PATTERN.findall(piece)])
        self[piece] = found
        return found


class Encoder:
    """Byte-level BPE by the tokenizers library, with the ids of pieces between white space remembered.

    The tokenizer splits a text at white space before anything else, and a single space goes with what follows it. So where
    no white space stands beside other white space, the ids of a text are those of its pieces, one after another.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Pieces(self.tokenizer)
        self.known.mark = {c: self.known.bpe(c) for c in ".,"}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.known) > CACHE:
            self.known.clear()
        get, out = self.known.__getitem__, []
        for t in texts:
            if WHOLE.search(t):
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                out.append(b"".join(map(get, t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0"))))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, folder: str, path: str, end: int = END, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all texts, each followed by `end`, in ascending doc_id order; one row for each file.

    Rows: file, part, seq (files sort by part and seq), n_docs, n_ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, coder = TaskContext.get().partitionId(), 0, encoder(path)
        ids: list[bytes] = []
        names: list[int | None] = []
        size, last = 0, np.array([end], "<u4").tobytes()

        def flush() -> pa.RecordBatch:
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            flat = np.frombuffer(b"".join(ids), "<u4")
            name = f"{folder}/{part:06d}-{seq:06d}.ids"
            unnamed = names.count(None)  # nulls sort first
            write_file(name, dump(np.array([n or 0 for n in names], np.int64), counts, flat, unnamed=unnamed))
            return pa.RecordBatch.from_pydict({"file": [name], "part": [part], "seq": [seq], "n_docs": [len(ids)], "n_ids": [len(flat)]})

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                got = coder.encode([t or "" for t in rows.column(1).to_pylist()])
                for name, one in zip(rows.column(0).to_pylist(), got):
                    if ids and size + len(one) // 4 + 1 > file_ids:
                        yield flush()
                        ids, names, size, seq = [], [], 0, seq + 1
                    ids.append(one + last)
                    names.append(name)
                    size += len(one) // 4 + 1
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.repartitionByRange(partitions(docs), "doc_id").sortWithinPartitions("doc_id", F.crc32(F.col("text").cast("binary")))
    return rows.mapInArrow(run, "file string, part long, seq long, n_docs long, n_ids long")


def read(files: DataFrame) -> DataFrame:
    """From files as write() gives them: doc_id, start, n_tokens, ids_crc32 of every document, in the order written.

    A file's start comes from sums over partitions, then over the files of a partition, never over documents.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)))
    inside = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("seq"))), F.lit(0))
    jobs = files.withColumn("inside", inside).join(parts.select("part", "base"), "part").select("file", (F.col("inside") + F.col("base")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = Reader(read_file(file))
                ends = np.cumsum(data.counts.astype(np.int64))
                starts = ends - data.counts
                for at in range(0, len(ends), 2000):
                    flat = data.read(int(starts[at]), int(ends[min(at + 2000, len(ends)) - 1])).astype("<u4")
                    own = [(int(s - starts[at]), int(e - starts[at])) for s, e in zip(starts[at : at + 2000], ends[at : at + 2000])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(data.doc_ids[at : at + 2000], mask=np.arange(at, min(at + 2000, len(ends))) < data.unnamed), pa.array(starts[at : at + 2000] + first), pa.array(data.counts[at : at + 2000].astype(np.int64)), pa.array([crc32(flat[s:e].tobytes()) for s, e in own], pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return jobs.repartition(partitions(files), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """Encode every whole text, write the files to the shared folder, and give per document what the files hold.

    Null texts count as empty: one id, the end. A null doc_id sorts first and comes back null. Repeated rows are written as
    often as they come in; rows with one doc_id are in the order of their texts' checksums, and among equal ones in any. A
    text of any length is encoded whole. An empty table writes no file and gives no rows. Other columns are not read.
    """
    folder = scratch(docs.sparkSession, "ids")
    return read(stored(write(docs, folder, path or vocabulary(), end), "files"))
