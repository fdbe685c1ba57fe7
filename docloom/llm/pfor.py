"""A file of token ids in patched frame-of-reference blocks.

Layout, little-endian: magic, then six unsigned 64-bit numbers (documents, ids, block length, blocks, exceptions, and
documents without an id, which come first); the documents' ids (signed 64-bit) and id counts (unsigned 32-bit); per block its minimum (unsigned 32-bit), width (a byte),
and the place of its packed bytes (unsigned 64-bit: the index of block starts); the exceptions, as place in the whole
sequence (unsigned 64-bit) and value over the minimum (unsigned 32-bit); then the packed blocks, bit plane by bit plane.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"PFORIDS2"
BLOCK = 128
#: The width of a block holds this share of its values; the rest are exceptions.
SHARE = 0.95


def dump(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, block: int = BLOCK, share: float = SHARE, unnamed: int = 0) -> bytes:
    n = len(ids)
    blocks = -(-n // block)
    grid = np.empty(blocks * block, np.uint32)
    grid[:n] = ids
    grid[n:] = ids[-1] if n else 0
    grid = grid.reshape(blocks, block)
    least = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    over = grid - least[:, None]
    rank = min(block - 1, int(np.ceil(share * block)) - 1)
    chosen = np.partition(over, rank, axis=1)[:, rank] if blocks else np.zeros(0, np.uint32)
    width = np.ceil(np.log2(chosen.astype(np.float64) + 1)).astype(np.uint8)
    limit = (np.uint64(1) << width.astype(np.uint64)).astype(np.uint64)
    wide = over >= limit[:, None]
    places = np.flatnonzero(wide).astype(np.uint64)
    values = over[wide]
    sizes = width.astype(np.int64) * (block // 8)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64)
    body = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            low = over[rows]
            planes = np.stack([np.packbits(((low >> np.uint32(j)) & np.uint32(1)).astype(np.uint8), axis=1) for j in range(int(w))], axis=1)
            body[(starts[rows].astype(np.int64)[:, None] + np.arange(int(w) * block // 8)).ravel()] = planes.reshape(len(rows), -1).ravel()
    head = np.array([len(doc_ids), n, block, blocks, len(places), unnamed], "<u8")
    parts = [head, doc_ids.astype("<i8"), counts.astype("<u4"), least.astype("<u4"), width, starts[:-1].astype("<u8"), places.astype("<u8"), values.astype("<u4"), body]
    return MAGIC + b"".join(p.tobytes() for p in parts)


class Reader:
    """A file's header and index; read() unpacks only the blocks that hold the ids asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of packed ids")
        docs, self.n, self.block, blocks, exceptions, self.unnamed = map(int, np.frombuffer(data, "<u8", 6, 8))
        at = 56
        for name, kind, size in (("doc_ids", "<i8", docs), ("counts", "<u4", docs), ("least", "<u4", blocks), ("width", "u1", blocks), ("starts", "<u8", blocks), ("places", "<u8", exceptions), ("values", "<u4", exceptions)):
            setattr(self, name, np.frombuffer(data, kind, size, at))
            at += size * np.dtype(kind).itemsize
        self.body = np.frombuffer(data, np.uint8, offset=at)

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, -(-stop // self.block)
        width, each = self.width[first:last], self.block // 8
        out = np.zeros((last - first, self.block), np.uint32)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w:
                at = self.starts[first:last][rows].astype(np.int64)[:, None] + np.arange(int(w) * each)
                planes = self.body[at].reshape(len(rows), int(w), each)
                low = np.zeros((len(rows), self.block), np.uint32)
                for j in range(int(w)):
                    low |= np.unpackbits(planes[:, j], axis=1).astype(np.uint32) << np.uint32(j)
                out[rows] = low
        flat = out.ravel()
        a, b = np.searchsorted(self.places, [first * self.block, last * self.block])
        flat[self.places[a:b].astype(np.int64) - first * self.block] = self.values[a:b]
        flat = (flat.reshape(-1, self.block) + self.least[first:last][:, None]).ravel()
        return flat[start - first * self.block : stop - first * self.block]
