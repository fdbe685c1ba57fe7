"""Substring deduplication by content-defined chunking with a gear rolling hash."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.blocks import NO_ID, Block, Row, by_block, by_bucket, dealt, first_pass, unpack, pack
from docloom.llm.common import partitions, scratch

#: The rolling hash covers the last REACH bytes; a cut is where it is the least of the REACH positions on either side.
REACH = 16
#: Longest chunk: periodic text without a clear least is cut here.
LONGEST = 1024
#: A run of repeated chunks is removed from so many bytes on: by chance single short chunks repeat anywhere. A passage loses
#: some 3 REACH bytes and part of a chunk at its edges; of 51 words of 4 letters at least 100 bytes are left.
LEAST_RUN = 80


def gear_table(seed: int = 5) -> np.ndarray:
    """256 random words, from a rule: splitmix64 steps of the seed."""
    x = (np.arange(1, 257, dtype=np.uint64) + np.uint64(seed << 8)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def gear(data: np.ndarray) -> np.ndarray:
    """h(i) = 2 h(i - 1) + GEAR[byte] in 32 bits, at all places at once: the sum of two halves of a window, one shifted."""
    h, size = GEAR[data], 1
    while size < REACH:
        h[size:] += h[:-size] << np.uint32(size) if len(h) > size else h[:0]
        size *= 2
    return h


def cuts(data: np.ndarray) -> np.ndarray:
    """Chunk ends, the last one the length. A cut depends on 2 REACH bytes before and REACH after it only, so an insertion
    moves no cut beyond them."""
    n = len(data)
    if n <= REACH:
        return np.array([n] if n else [], np.int64)
    h = gear(data)
    low, size = h, 1
    while size * 2 <= 2 * REACH + 1:
        low = np.minimum(low[:-size], low[size:]) if len(low) > size else low[:1]
        size *= 2
    more = 2 * REACH + 1 - size
    low = np.minimum(low[: len(low) - more], low[more:]) if len(low) > more else low[:0]
    at = np.flatnonzero(h[REACH : REACH + len(low)] == low) + REACH + 1
    ends = np.unique(np.append(at[at < n], n))
    if len(ends) > 1 and (np.diff(ends[:-1], prepend=0) < REACH).any():  # ties in periodic text: from its first cut on
        kept, last = [], 0
        for e in ends[:-1].tolist():
            if e - last >= REACH:
                kept.append(last := e)
        ends = np.array([*kept, n], np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    if (ends - starts).max() > LONGEST:
        ends = np.concatenate([np.append(np.arange(s + LONGEST, e, LONGEST), e) for s, e in zip(starts, ends)])
    return ends


def digests_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends and digests: 96 bits, as a column of 64 and one of 32."""
    ends = cuts(np.frombuffer(data, np.uint8))
    starts = np.concatenate([[0], ends[:-1]]).tolist() if len(ends) else []
    return ends, np.frombuffer(b"".join([blake2b(data[s:e], digest_size=12).digest() for s, e in zip(starts, ends.tolist())]), DIGEST)


DIGEST = np.dtype([("a", "<u8"), ("b", "<u4")])
DIGESTS, OWNERS = 1, 2
RESULT = "doc_id long, n_bytes long, n_chunks long, n_removed long, n_spans long, owners array<long>, kept_sha256 string"


def _send(buckets: int):
    """A block's distinct digests, each with the smallest and largest id that has it, by bucket."""

    def make(number: int, block: Block) -> Iterator[Row]:
        found = [digests_of(block.data[s:e].tobytes())[1] for s, e in zip(block.starts[:-1], block.starts[1:])]
        ids = np.repeat(block.ids, [len(f) for f in found])
        flat = np.concatenate(found)
        known = ids != NO_ID
        flat, ids = flat[known], ids[known]
        order = np.lexsort((ids, flat["b"], flat["a"]))
        flat, ids = flat[order], ids[order]
        if len(flat):
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            last = np.append(first[1:], len(flat)) - 1
            yield from dealt(number, DIGESTS, (flat["a"][first] % np.uint64(buckets)).astype(np.int32), flat["a"][first], flat["b"][first], ids[first], ids[last])

    return make


def _owners(bucket: int, rows: list[Row]) -> Iterator[Row]:
    """Tell each block the owners of those of its digests that a document with a smaller id has."""
    parts = [unpack(r[3]) for r in rows]
    if not parts:
        return
    a, b, low, high = (np.concatenate(c) for c in zip(*parts))
    block = np.repeat(np.array([r[1] for r in rows]), [len(p[0]) for p in parts])
    order = np.lexsort((b, a))
    a, b, low, high, block = a[order], b[order], low[order], high[order], block[order]
    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    owner = np.repeat(np.minimum.reduceat(low, start), np.diff(np.append(start, len(a))))
    copy = np.flatnonzero(high > owner)
    copy = copy[np.argsort(block[copy], kind="stable")]
    for number in np.unique(block[copy]):
        pick = copy[np.searchsorted(block[copy], number) : np.searchsorted(block[copy], number, "right")]
        yield bucket, int(number), OWNERS, pack(a[pick], b[pick], owner[pick])


def _remove(folder: str, least_run: int):
    def act(number: int, rows: list[Row]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(r[3]) for r in rows if r[2] == OWNERS]
        if not parts:
            return
        owners = {(a, b): o for p in parts for a, b, o in zip(*[c.tolist() for c in p])}
        block, out = Block.load(folder, number), []
        for k, doc in enumerate(block.ids.tolist()):
            data = block.data[block.starts[k] : block.starts[k + 1]].tobytes()
            ends, digests = digests_of(data)
            own = [owners.get(d, doc) for d in digests.tolist()]
            if doc == NO_ID or all(o >= doc for o in own):
                continue
            gone, keepers, kept, at, k0 = [], set(), sha256(), 0, 0
            edges = [0, *ends.tolist()]
            while k0 < len(own):
                k1 = k0
                while k1 < len(own) and own[k1] < doc:
                    k1 += 1
                if edges[k1] - edges[k0] >= least_run:
                    gone.append((edges[k0], edges[k1]))
                    keepers.update(own[k0:k1])
                k0 = max(k1, k0 + 1)
            for s, e in gone:
                kept.update(data[at:s])
                at = e
            kept.update(data[at:])
            if gone:
                out.append((doc, len(data), len(own), sum(e - s for s, e in gone), len(gone), sorted(keepers), kept.hexdigest()))
        if out:
            names = [x.split()[0] for x in RESULT.split(", ")]
            types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return act


def deduplicate(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """Keep each chunk in the document with the smallest doc_id that has it; the later copies are removed.

    A run of adjacent chunks owned by other documents is removed if it has at least `least_run` bytes. One row for each
    row that loses a run: doc_id, n_bytes, n_chunks, n_removed (bytes), n_spans (runs), owners (doc_ids that keep the
    bytes, ascending), kept_sha256 (hex, of what is left). Chunks repeated within a document only are no copies, nor are
    rows with one doc_id copies of each other. Null and empty texts and rows with a null id lose nothing. An empty table
    gives no rows; other columns are not read.
    """
    parts, folder = partitions(docs, 32), scratch(docs.sparkSession, "blocks")
    sent = first_pass(docs, folder, _send(parts))
    told = by_bucket(sent, parts, _owners)
    return by_block(told.filter("kind > 0"), parts, _remove(folder, least_run), RESULT)
