"""Exact removal of repeated substrings, by suffix sorting with bucket-pointer refinement.

Sorting every suffix of the corpus would ship each byte many times over. So a lossless sieve comes first: of the 20-byte
strings in any 50-byte string, those with the least hash are its anchors, the same wherever the 50 bytes stand. Only anchors
that stand in two documents can lie in a repeated string. Where all that surrounds two anchors (30 bytes either way) has the
same hash, all their 50-byte strings are equal and no text is needed. The rest, mostly the edges of repeated passages, are
fetched with their surroundings and sorted: buckets of equal 8-byte strings are refined by sorting on the bucket numbers
of later offsets (8, then 16, then 18 on), the refined numbers serving in the next round, until buckets hold equal 50 bytes.

Equal strings hold the same anchor at the same offset. So anchors are sorted a few megabytes at a time, and one that alone has
more than that is sorted once to either side: at each offset, buckets of equal left parts are refined by the bucket numbers of
their right parts. Memory is some 200 bytes for each surroundings of a bucket, and 100 MB.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.blocks import NO_ID, Block, Row, by_block, by_bucket, dealt, first_pass, pack, unpack, unpack_all
from docloom.llm.common import partitions, scratch, stored

SPAN, GRAM = 50, 20
SIDE = SPAN - GRAM
ANCHORS, WHOLE, FETCH, CONTEXTS, PARTS = 1, 2, 3, 4, 5
#: Texts longer than this are hashed in pieces of so many bytes.
PIECE = 4 << 20
#: Bytes of surroundings sorted at once; less than twice as many may be.
AT_ONCE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


WORDS = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n - 1 modulo 2**64, and their inverses."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 4096)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(data: np.ndarray, starts: np.ndarray):
    """Anchors of texts laid end to end: text number, place, hash, and hashes of surroundings (whole, 15 left, 15 right).

    A side with fewer than 15 bytes gets a hash of 0 there, which matches nothing.
    """
    n = len(data)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.uint8, np.uint8))
    if n < SPAN:
        return none
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(WORDS[data] * up[:n], out=sums[1:])
    of = lambda a, b: _mix((sums[b] - sums[a]) * down[a])
    h = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]) | np.uint64(1)
    least = _window_min(h, SIDE + 1)
    bad = np.zeros(len(least) + 1, np.int8)  # windows that leave their text
    for e in starts[1:-1].tolist():
        bad[max(0, e - SPAN + 1) : e] = 1
    least[bad[: len(least)] == 1] = 0
    pad = np.full(SIDE, np.iinfo(np.uint64).max, np.uint64)
    at = np.flatnonzero(h == ~_window_min(np.concatenate([pad, ~least, pad]), SIDE + 1))
    text = np.searchsorted(starts, at, "right") - 1
    lo, hi = np.maximum(starts[text], at - SIDE), np.minimum(starts[text + 1], at + SPAN)
    fits = hi - lo >= SPAN
    at, text, lo, hi = at[fits], text[fits], lo[fits], hi[fits]
    half = SIDE // 2
    byte = lambda a, b, enough: np.where(enough, (of(np.where(enough, a, 0), np.where(enough, b, 0)) % np.uint64(255)).astype(np.uint8) + np.uint8(1), np.uint8(0))
    left = byte(at - half, at, at - half >= lo)
    right = byte(at + GRAM, at + GRAM + half, at + GRAM + half <= hi)
    whole = of(lo, hi) ^ _mix((at - lo + 64 * (hi - at)).astype(np.uint64))
    return text, at - starts[text], h[at], whole, left, right


def _pieces(block: Block) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of a block; a long text is cut into pieces that overlap by what an anchor's surroundings need."""
    size = np.diff(block.starts)
    if len(size) > 1 or size[0] <= PIECE:
        yield anchors(block.data, block.starts)
        return
    for s in range(0, int(size[0]), PIECE):
        lo = max(0, s - 128)
        part = block.data[lo : s + PIECE + 128]
        text, at, *more = anchors(part, np.array([0, len(part)]))
        own = (at + lo >= s) & (at + lo < s + PIECE)
        yield tuple(c[own] for c in (text, at + lo, *more))


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Places where sorted keys change."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _send(buckets: int):
    """A block's anchors by bucket. Of equal anchors in equal surroundings only those of the smallest id in the block are
    sent: what is in later documents of the block is known to be repeated."""

    def make(number: int, block: Block) -> Iterator[Row]:
        for text, at, h, whole, left, right in _pieces(block):
            if not len(at):
                continue
            ids = block.ids[text]
            order = np.lexsort((ids, whole, h))
            start = _first_of(h[order], whole[order])
            low = np.empty(len(at), np.int64)
            low[order] = np.repeat(ids[order][start], np.diff(np.append(start, len(at))))
            again = ids > low
            if again.any():
                yield 0, number, WHOLE, pack(np.diff(text[again], prepend=0).astype(np.int32), at[again].astype(np.uint32))
            text, at, h, whole, left, right, ids = (c[~again] for c in (text, at, h, whole, left, right, ids))
            bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
            six = lambda x: ((x >> np.uint64(32)).astype(np.uint32), ((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16))
            for row in dealt(number, ANCHORS, bucket, text.astype(np.int32), ids, at.astype(np.uint32), *six(h), *six(whole), left, right):
                yield row

    return make


def _match(bucket: int, rows: list[Row]) -> Iterator[Row]:
    """Find anchors of two documents. Tell blocks which are repeated whole, and which need to be fetched."""
    for r in rows:
        if r[2] == WHOLE:
            yield r
    rows = [r for r in rows if r[2] == ANCHORS]
    if not rows:
        return
    (text, ids, at, h1, h2, k1, k2, left, right), counts = unpack_all([r[3] for r in rows])
    block = np.repeat(np.arange(len(rows), dtype=np.int32), counts)
    h, k = (h1.astype(np.uint64) << np.uint64(16)) | h2, (k1.astype(np.uint64) << np.uint64(16)) | k2
    del h1, h2, k1, k2
    order = np.argsort(h, kind="stable")
    start = _first_of(h[order])
    low, high = np.minimum.reduceat(ids[order], start), np.maximum.reduceat(ids[order], start)
    order = order[np.repeat(low != high, np.diff(np.append(start, len(h))))]  # anchors of two documents
    if not len(order):
        return
    block, text, ids, at, h, k, left, right = (c[order] for c in (block, text, ids, at, h, k, left, right))
    order = np.lexsort((ids, k, h))
    block, text, ids, at, h, k, left, right = (c[order] for c in (block, text, ids, at, h, k, left, right))
    start = _first_of(h, k)
    sizes = np.diff(np.append(start, len(h)))
    low = np.repeat(ids[start], sizes)
    group = np.repeat(np.cumsum(np.concatenate([[True], h[start][1:] != h[start][:-1]])) - 1, sizes)
    least = np.minimum.reduceat(ids, _first_of(group))[group]  # of the whole group
    shared = np.zeros(len(start), bool)  # surroundings that share a side with others of their group
    for side in (left, right):
        own = side[start]
        o = np.lexsort((own, h[start]))
        s = _first_of(h[start][o], own[o])
        many = np.repeat(np.diff(np.append(s, len(o))) > 1, np.diff(np.append(s, len(o))))
        shared[o] |= many & (own[o] > 0)
    shared = np.repeat(shared, sizes)
    whole = ids > low
    source = (low == least) & ~whole
    first = np.zeros(len(ids), bool)
    first[start] = True
    fetch = shared & ~whole & (~source | first)
    for kind, pick in ((WHOLE, np.flatnonzero(whole)), (FETCH, np.flatnonzero(fetch))):
        pick = pick[np.lexsort((at[pick], text[pick], block[pick]))]
        cut = np.searchsorted(block[pick], np.arange(len(rows) + 1))
        for n in range(len(rows)):
            if cut[n] < cut[n + 1]:
                p = pick[cut[n] : cut[n + 1]]
                yield bucket, rows[n][1], kind, pack(np.diff(text[p], prepend=0).astype(np.int32), at[p])


def _fetch(folder: str):
    """The surroundings of the anchors asked for."""

    def act(number: int, rows: list[Row]) -> Iterator[pa.RecordBatch]:
        from docloom.llm.blocks import _batch

        block = Block.load(folder, number)
        for bucket, _, _, payload in rows:
            step, at = unpack(payload)
            text = np.cumsum(step)
            lo, hi = block.starts[text], block.starts[text + 1]
            mid = lo + at.astype(np.int64)
            s, e = np.maximum(lo, mid - SIDE), np.minimum(hi, mid + SPAN)
            size = e - s
            spread = np.repeat(s - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
            yield _batch([(bucket, number, CONTEXTS, pack(text.astype(np.int32), block.ids[text], (s - lo).astype(np.uint32), size.astype(np.uint8), (mid - s).astype(np.uint8), block.data[spread]))])

    return act


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Bucket numbers: equal for equal keys, in the order of the keys."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), np.int64)
    change[_first_of(*[k[order] for k in keys])] = 1
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(change) - 1
    return out


def equal_spans(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bucket numbers of the SPAN bytes at each place, by bucket-pointer refinement.

    Depth 8, 16, 32, 50: a round sorts places by their bucket and the bucket of the place one depth later, which the round
    before made. A place whose bucket holds it alone stays alone and is left out of later rounds.
    """
    padded = np.concatenate([data, np.zeros(SPAN + 8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data) + SPAN]
    bucket = _ranks(np.ascontiguousarray(eight).view(">u8").ravel())
    live = np.arange(len(data))
    out = bucket
    for step in (8, 16, SPAN - 32):
        new = _ranks(out[live], out[live + step])
        out = np.arange(len(out), 2 * len(out))  # places left out are alone
        out[live] = new
        live = live[np.bincount(new)[new] > 1]
        if not len(live):
            break
    return out[at]


def _word(data: np.ndarray, at: np.ndarray, step: int, n: int = 8) -> np.ndarray:
    """The n bytes from each place on, forwards or backwards (step 1 or -1), as a number."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = (out << np.uint64(8)) | data[np.clip(at + step * k, 0, len(data) - 1)]
    return out


def _side(data: np.ndarray, at: np.ndarray, step: int):
    """A function of a depth up to SIDE: the bucket numbers of so many bytes from each place on."""
    order = np.lexsort([_word(data, at + step * k, step, min(8, SIDE - k)) for k in range(0, SIDE, 8)][::-1])
    same = np.arange(len(at)) > 0
    common = np.zeros(len(at), np.uint8)  # bytes in common with the one before
    for k in range(SIDE):
        byte = _word(data, at[order] + step * k, step, 1)
        same[1:] &= byte[1:] == byte[:-1]
        common += same

    def numbers(depth: int) -> np.ndarray:
        out = np.empty(len(at), np.int64)
        out[order] = np.cumsum(common < depth)
        return out

    return numbers


def _repeats_of_one(data: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For one anchor at many places, with so many bytes before and after it: a bit for each string that also starts in a
    smaller id, the lowest bit for the one that starts with the surroundings."""
    left, right = _side(data, at - 1, -1), _side(data, at + GRAM, 1)
    out = np.zeros(len(at), np.uint32)
    for n in range(SIDE + 1):  # bytes of the string before the anchor
        live = np.flatnonzero((before >= n) & (after >= SIDE - n))
        bucket, later = left(n)[live], right(SIDE - n)[live]
        if not len(live):
            continue
        many = (np.bincount(bucket)[bucket] > 1) & (np.bincount(later)[later] > 1)
        live, name = live[many], (bucket[many] << 32) | later[many]
        order = np.lexsort((ids[live], name))
        start = _first_of(name[order])
        live = live[order]
        again = live[ids[live] > np.repeat(ids[live][start], np.diff(np.append(start, len(live))))]
        out[again] |= np.uint32(1) << (before[again] - n).astype(np.uint32)
    return out


def _repeats(data: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The same bits for surroundings of any anchors, laid end to end."""
    begin = np.cumsum(size) - size
    room = size - SPAN + 1
    first = np.cumsum(room) - room
    which = np.repeat(np.arange(len(size)), room)
    offset = np.arange(len(which)) - np.repeat(first, room)
    name = equal_spans(data, begin[which] + offset)
    order = np.lexsort((ids[which], name))
    start = _first_of(name[order])
    low = np.empty(len(which), np.int64)
    low[order] = np.repeat(ids[which][order][start], np.diff(np.append(start, len(order))))
    return np.bitwise_or.reduceat((ids[which] > low).astype(np.uint32) << offset.astype(np.uint32), first)


def _refine(bucket: int, rows: list[Row]) -> Iterator[Row]:
    """Sort all strings of the fetched surroundings; of equal ones, all but those of the smallest id are repeated."""
    if not rows:
        return
    (text, ids, first, size, middle, data), counts = unpack_all([r[3] for r in rows])
    block = np.repeat(np.arange(len(rows), dtype=np.int32), counts)
    begin = np.cumsum(size, dtype=np.int64) - size
    anchor = [_word(data, begin + middle + k, 1) for k in (0, 8, GRAM - 8)]
    order = np.lexsort(anchor)
    start = _first_of(*[k[order] for k in anchor])
    del anchor
    many = np.add.reduceat(size[order], start, dtype=np.int64)
    alone = many > AT_ONCE
    turn = np.cumsum(np.where(alone, 0, many)) // AT_ONCE
    turn = np.repeat(np.where(alone, turn[-1] + 1 + np.arange(len(start)), turn), np.diff(np.append(start, len(order))))
    order, alone = order[(by := np.argsort(turn, kind="stable"))], np.repeat(alone, np.diff(np.append(start, len(order))))[by]
    start = _first_of(turn[by])
    found = np.zeros(len(size), np.uint32)
    for s, e in zip(start.tolist(), [*start[1:].tolist(), len(order)]):
        pick = order[s:e]
        wide = size[pick].astype(np.int64)
        if alone[s]:
            before = middle[pick].astype(np.int64)
            found[pick] = _repeats_of_one(data, begin[pick] + before, before, wide - before - GRAM, ids[pick])
        else:
            spread = np.repeat(begin[pick] - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
            found[pick] = _repeats(data[spread], wide, ids[pick])
    del data, order, alone, turn, by
    runs = []
    for edge in (found & ~(found << np.uint32(1)), found & ~(found >> np.uint32(1))):  # first and last strings of runs
        hits = [np.flatnonzero((edge >> np.uint32(o)) & np.uint32(1)) for o in range(SIDE + 1)]
        w, o = np.concatenate(hits), np.repeat(np.arange(SIDE + 1), [len(x) for x in hits])
        by = np.lexsort((o, w))
        runs.append((w[by], o[by]))
    (w, s), (_, e) = runs
    if not len(w):
        return
    s, e = first[w] + s, first[w] + e + SPAN
    by = np.lexsort((s, text[w], block[w]))
    w, s, e = w[by], s[by], e[by]
    own = _first_of(block[w], text[w])  # runs of one text that touch become one
    far = np.repeat(np.arange(len(own)) << 33, np.diff(np.append(own, len(w))))
    reach = np.maximum.accumulate(e + far)
    new = np.flatnonzero(np.concatenate([[True], (s + far)[1:] > reach[:-1]]))
    e = (reach - far)[np.append(new[1:], len(w)) - 1]
    w, s = w[new], s[new]
    cut = np.searchsorted(block[w], np.arange(len(rows) + 1))
    for n in range(len(rows)):
        if cut[n] < cut[n + 1]:
            p = slice(cut[n], cut[n + 1])
            yield bucket, rows[n][1], PARTS, pack(text[w[p]].astype(np.int32), s[p].astype(np.uint32), e[p].astype(np.uint32))


def _finish(folder: str):
    def act(number: int, rows: list[Row]) -> Iterator[pa.RecordBatch]:
        block = Block.load(folder, number)
        level = np.zeros(len(block.data) + 1, np.int32)
        for _, _, kind, payload in rows:
            if kind == WHOLE:
                step, at = unpack(payload)
                text = np.cumsum(step)
                lo, hi = block.starts[text], block.starts[text + 1]
                s, e = np.maximum(lo, lo + at - SIDE), np.minimum(hi, lo + at + SPAN)
            elif kind == PARTS:
                text, s, e = unpack(payload)
                s, e = block.starts[text] + s, block.starts[text] + e
            else:
                continue
            np.add.at(level, s, 1)
            np.add.at(level, e, -1)
        gone = np.cumsum(level[:-1]) > 0
        out = []
        for k, doc in enumerate(block.ids.tolist()):
            own = gone[block.starts[k] : block.starts[k + 1]]
            data = block.data[block.starts[k] : block.starts[k + 1]]
            runs = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(len(own) > 0 and own[0])
            out.append((None if doc == NO_ID else doc, len(own), int(own.sum()), runs, sha256(data[~own].tobytes()).hexdigest()))
        types = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [x.split()[0] for x in RESULT.split(", ")])

    return act


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans (maximal removed runs) and the SHA-256 of the remaining bytes.

    A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id; strings are those of the input
    and never cross documents. Null and empty texts have no bytes; a null doc_id counts as larger than any other, and rows
    with equal ids remove nothing from each other. Every row gives a row; an empty table gives none; other columns are not
    read. Long texts are hashed in pieces, so memory does not grow with the corpus but with the longest text.
    """
    spark = docs.sparkSession
    parts, folder = partitions(docs, 32), scratch(spark, "texts")
    from docloom.llm.blocks import SCHEMA

    matched = stored(by_bucket(first_pass(docs, folder, _send(parts)), parts, _match), "matched")
    asked = matched.filter(f"kind = {FETCH}")
    refined = by_bucket(by_block(asked, parts, _fetch(folder), SCHEMA), parts, _refine)
    return by_block(matched.filter(f"kind <> {FETCH}").unionAll(refined), parts, _finish(folder), RESULT)
