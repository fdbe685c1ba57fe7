"""Blocks of texts in the shared folder, and exchanges of packed records between blocks and buckets.

A first pass writes the texts it reads to block files, so that later passes fetch them from the shared folder in place of
shuffling them. What the passes exchange are rows of (bucket, block, kind, payload): many records packed in one payload.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import read_file, write_file

#: Bytes of text in a block; a longer text has a block of its own.
BLOCK_BYTES = 4 << 20
#: Stands for a null id, larger than any other.
NO_ID = np.iinfo(np.int64).max
SCHEMA = "bucket int, block long, kind int, payload binary"
MARK = 0


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed string; the bytes of wide numbers are put apart, which packs better."""
    import zstandard

    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    body = b"".join(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if a.dtype.itemsize > 1 else a.tobytes() for a in map(np.ascontiguousarray, arrays))
    return len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=level).compress(body)


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    size = int.from_bytes(data[:4], "little")
    body, at, out = zstandard.ZstdDecompressor().decompress(data[4 + size :]), 0, []
    for kind, n in json.loads(data[4 : 4 + size]):
        width = np.dtype(kind).itemsize
        part = np.frombuffer(body, np.uint8, n * width, at)
        out.append((part.reshape(width, n).T.copy().view(kind).reshape(n) if width > 1 else part.view(kind)) if n else np.zeros(0, kind))
        at += n * width
    return out


def unpack_all(payloads: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
    """The arrays of several strings end to end, unpacked one at a time, and how many numbers of the first array each has."""
    heads = [json.loads(p[4 : 4 + int.from_bytes(p[:4], "little")]) for p in payloads]
    out = [np.empty(sum(h[c][1] for h in heads), kind) for c, (kind, _) in enumerate(heads[0])]
    at = [0] * len(out)
    for p in payloads:
        for c, part in enumerate(unpack(p)):
            out[c][at[c] : at[c] + len(part)] = part
            at[c] += len(part)
    return out, [h[0][1] for h in heads]


class Block:
    """Texts one after another: ids, starts (one more than texts) and data."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, data: np.ndarray):
        self.ids, self.starts, self.data = ids, starts, data

    @classmethod
    def of(cls, ids: list[int | None], texts: list[bytes]) -> Block:
        names = np.array([NO_ID if i is None else i for i in ids], np.int64)
        return cls(names, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), np.frombuffer(b"".join(texts), np.uint8))

    @classmethod
    def load(cls, folder: str, number: int) -> Block:
        return cls(*unpack(read_file(f"{folder}/{number}.block")))

    def save(self, folder: str, number: int) -> None:
        write_file(f"{folder}/{number}.block", pack(self.ids, self.starts, self.data, level=3))


Row = tuple[int, int, int, bytes]


def _batch(rows: list[Row]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())], ["bucket", "block", "kind", "payload"])


def first_pass(docs: DataFrame, folder: str, make: Callable[[int, Block], Iterator[Row]]) -> DataFrame:
    """Write block files of all texts, and give the rows that make(number, block) gives, with a mark for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            block = Block.of(ids, texts)
            block.save(folder, number)
            yield _batch([(number % 1009, number, MARK, b""), *make(number, block)])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    if ids and size + len(data) > BLOCK_BYTES:
                        yield from flush()
                        ids, texts, size, number = [], [], 0, number + 1
                    ids.append(doc)
                    texts.append(data)
                    size += len(data)
        if ids:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[int, list[Row]]]:
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    for name, group in groupby(rows, key=lambda r: r[key]):
        yield name, list(group)


def by_bucket(rows: DataFrame, parts: int, act: Callable[[int, list[Row]], Iterator[Row]]) -> DataFrame:
    """Deal rows out by bucket and give what act(bucket, its rows) gives. Marks pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, group in _groups(batches, 0):
            marks = [r for r in group if r[2] == MARK]
            out = marks + list(act(bucket, [r for r in group if r[2] != MARK]))
            if out:
                yield _batch(out)

    dealt = rows.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket", "block", "kind")
    return dealt.mapInArrow(run, SCHEMA)


def by_block(rows: DataFrame, parts: int, act: Callable[[int, list[Row]], Iterator], schema: str) -> DataFrame:
    """Deal rows out by block and give the record batches that act(block, its rows) gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, group in _groups(batches, 1):
            yield from act(number, group)

    return rows.repartition(parts, "block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(run, schema)


def dealt(number: int, kind: int, bucket: np.ndarray, *columns: np.ndarray) -> Iterator[Row]:
    """Rows of one block: the records of the columns, packed by bucket."""
    order = np.argsort(bucket, kind="stable")
    names, starts = np.unique(bucket[order], return_index=True)
    for name, s, e in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
        pick = order[s:e]
        yield name, number, kind, pack(*[c[pick] for c in columns])
