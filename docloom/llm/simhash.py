"""Near-duplicates by SimHash, found with multi-index hashing.

A 64-bit fingerprint has two segments of 32 bits. Two fingerprints at 3 or fewer differing bits differ by at most one bit in
one segment, so each fingerprint is put in a table by each segment and looks up that segment's Hamming ball of radius 1.
Of two segments one bit apart, the one with the 0 looks the other up: 1 + (zero bits) look-ups, not 33.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import partitions, stored
from docloom.llm.components import components

SEED = 42


def shingles(text: str | None, size: int = 3) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[k:] for k in range(size)])))


def _majority(hashes: np.ndarray, counts: list[int]) -> np.ndarray:
    """One fingerprint for each run of hashes: a bit is set if in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    starts = np.concatenate([[0], np.cumsum(counts)])
    for k in full:
        bits = np.zeros(64, np.int64)
        for at in range(starts[k], starts[k + 1], 1 << 16):
            part = hashes[at : min(at + (1 << 16), starts[k + 1])]
            bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(bits * 2 > counts[k], bitorder="little").view(np.uint64)[0]
    return out


def fingerprints_of(texts: list[str | None], size: int = 3) -> np.ndarray:
    from xxhash import xxh64_digest

    found, counts = [], []
    for text in texts:
        parts = shingles(text, size)
        counts.append(len(parts))
        found.append(b"".join([xxh64_digest(p, SEED) for p in parts]))
    hashes = np.frombuffer(b"".join(found), ">u8").astype("<u8")
    return _majority(hashes, counts)


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every whole text; texts without words get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints_of(part.column(1).to_pylist(), size).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def links_within(fps: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among the fingerprints of one bucket (numbers, or rows of them), as places in fps.

    A breadth-first search compares each fingerprint it reaches with those not reached yet, so a dense group of n copies
    costs some n comparisons, not n * n / 2.
    """
    a: list[int] = []
    b: list[int] = []
    left = np.arange(len(fps))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            k = queue.pop()
            differ = np.bitwise_count(fps[left] ^ fps[k])
            near = (differ if differ.ndim == 1 else differ.sum(axis=1)) <= most
            if near.any():
                found = left[near].tolist()
                a += [k] * len(found)
                b += found
                queue += found
                left = left[~near]
    return a, b


#: A bucket with about this many rows or more is split; a bucket's size is told from a share of one in SHARE fingerprints.
HOT, SHARE = 20_000, 32


def _search(most: int, columns: tuple[str, ...] = ("fp",)):
    """Walk rows sorted by (seg, key), bucket by bucket, and give links between representatives. columns: the fingerprint."""

    def bucket(rows: pd.DataFrame) -> pd.DataFrame | None:
        seg, key = rows["seg"].to_numpy(), rows["key"].to_numpy()
        start = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (key[1:] != key[:-1])]))
        end = np.append(start[1:], len(rows))
        own, rep = rows["own"].to_numpy(), rows["rep"].to_numpy()
        fps = np.stack([rows[c].to_numpy().view(np.uint64) for c in columns], axis=1)
        fps = fps[:, 0] if len(columns) == 1 else fps
        any_own = np.maximum.reduceat(own.astype(np.int8), start) > 0
        a, b = [], []
        for s, e in zip(start[(end - start > 1) & any_own], end[(end - start > 1) & any_own]):
            x, y = links_within(fps[s:e], most)
            a.append(rep[s:e][x])
            b.append(rep[s:e][y])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}) if a else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            last = (frame["seg"].to_numpy() == frame["seg"].iat[-1]) & (frame["key"].to_numpy() == frame["key"].iat[-1])
            cut = len(frame) - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut:
                found = bucket(pd.concat([*held, frame.iloc[:cut]], ignore_index=True))
                held = [frame.iloc[cut:]]
                if found is not None:
                    yield found
            elif held and (held[-1]["seg"].iat[-1], held[-1]["key"].iat[-1]) != (frame["seg"].iat[0], frame["key"].iat[0]):
                found = bucket(pd.concat(held, ignore_index=True))
                held = [frame]
                if found is not None:
                    yield found
            else:
                held.append(frame)
        if held and (found := bucket(pd.concat(held, ignore_index=True))) is not None:
            yield found

    return run


def _split_hot(rows: DataFrame, most: int, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of hot buckets dealt to buckets of HOT rows or so, and links of hot rows with their bucket's head.

    The head is the row with the smallest representative. Rows near it (P) need no comparison with each other: the head links
    them. The others (Q) must meet all rows. So P is cut in parts and Q in parts, and each part of Q meets each part of P and
    of Q in a bucket of its own: no pair is lost, and a group of copies, where Q is small, costs no more than its rows.
    Which buckets are hot is told from a share of the fingerprints; that changes the work, not the links' components.
    """
    spark, key = rows.sparkSession, ["seg", "key"]
    few = rows.filter(F.pmod(F.xxhash64(F.lit("share"), "rep"), F.lit(SHARE)) == 0)
    hot = stored(few.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(2, HOT // SHARE)).select(*key), "hot")
    if not hot.head(1):
        return rows, None
    near = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"head.{c}"))) for c in columns) <= most
    heads = rows.join(hot, key).groupBy(*key).agg(F.min(F.struct("rep", *columns)).alias("head"))
    held = stored(rows.join(heads, key).withColumn("p", near), "hot_rows")
    sizes = held.groupBy(*key).agg(*[F.ceil(F.sum(F.when(c, 1).otherwise(0)) / HOT).cast("int").alias(n) for n, c in (("np", F.col("p")), ("nq", ~F.col("p")))])
    held = held.join(sizes, key)
    part = lambda n: F.pmod(F.xxhash64(F.lit("part"), "rep"), F.greatest(n, F.lit(1))).cast("int")
    count = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    meets_q = F.transform(count(F.col("nq")), lambda k: F.xxhash64("key", F.lit("p"), part(F.col("np")), k))
    meets_p = F.transform(count(F.col("np")), lambda k: F.xxhash64("key", F.lit("p"), k, part(F.col("nq"))))
    among_q = F.transform(count(F.col("nq")), lambda k: F.xxhash64("key", F.lit("q"), F.least(k, part(F.col("nq"))), F.greatest(k, part(F.col("nq")))))
    dealt = held.withColumn("key", F.explode(F.when(F.col("p"), meets_q).otherwise(F.concat(meets_p, among_q))))
    star = held.filter("p AND rep <> head.rep").select(F.col("rep").alias("a"), F.col("head.rep").alias("b"))
    cold = rows.join(hot, key, "left_anti")
    return cold.unionByName(dealt.select(*rows.columns).withColumn("own", F.lit(True))), star


def _linked(rows: DataFrame, most: int, count: int, columns: tuple[str, ...] = ("fp",)) -> DataFrame:
    """Links (a, b) between rows (seg, key, rep, own, the fingerprint) of a bucket within `most` bits; enough for components."""
    rows, star = _split_hot(rows, most, columns)
    dealt = rows.repartition(count, "seg", "key").sortWithinPartitions("seg", "key")
    found = dealt.mapInPandas(_search(most, columns), "a long, b long")
    return found if star is None else found.unionByName(star)


def links(distinct: DataFrame, most: int = 3, segments: int = 2) -> DataFrame:
    """Links (a, b) that connect what lies within `most` bits. distinct: fp, rep (a row for each fingerprint).

    Two fingerprints within `most` bits differ by at most most // segments bits in some segment. Each looks up the Hamming
    ball of that radius around its own segment, but of two segments only the smaller looks up the larger.
    """
    ends = [round(64 * k / segments) for k in range(segments + 1)]
    cut = [F.shiftrightunsigned(F.shiftleft("fp", 64 - ends[k + 1]), 64 - ends[k + 1] + ends[k]) for k in range(segments)]
    tables = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("seg"), c.alias("key")) for k, c in enumerate(cut)])
    width = max(ends[k + 1] - ends[k] for k in range(segments))
    masks = [sum(1 << j for j in bits) for n in range(most // segments + 1) for bits in combinations(range(width), n)]
    ball = F.filter(F.transform(F.lit(np.array(masks, np.int64)), lambda m: F.col("t.key").bitwiseXOR(m)), lambda k: k >= F.col("t.key"))
    rows = distinct.select("fp", "rep", F.explode(tables).alias("t")).select("fp", "rep", "t", F.explode(ball).alias("key"))
    rows = rows.select(F.col("t.seg").alias("seg"), "key", "fp", "rep", (F.col("key") == F.col("t.key")).alias("own"))
    return _linked(rows, most, partitions(distinct, 2))  # a row becomes some 34


def _grouped(prints: DataFrame, most: int, segments: int) -> DataFrame:
    """fp and component_id of every fingerprint that a row with an id has."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep is not null"), "distinct")
    roots = components(links(distinct, most, segments))
    return stored(distinct.join(roots, distinct.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id")), "named")


def near_duplicates(docs: DataFrame, most: int = 3, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest doc_id reachable over links of `most` bits (up to 3).

    Words are lower-cased in A-Z only and split at ASCII white space. Null and empty texts have fingerprint zero and are
    linked like any other. Rows without doc_id keep a fingerprint and get the component of their fingerprint, if any.
    Repeated rows come out as often as they came in; very long texts are read whole, their hashes counted in pieces; an empty
    table gives no rows; other columns are not read.
    """
    prints = stored(fingerprints(docs, size), "prints")
    out = prints.join(_grouped(prints, most, 2), "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The stage's fingerprints: BITS bits, of which one byte and one pivot address each of TABLES tables. At a Jaccard similarity
#: of 0.8 a bit differs with a chance of 0.152, so a table finds a pair with a chance of 0.8 (the pivots are equal) times 0.65
#: (the bytes differ by a bit at most), and all twelve miss it once in some 7,000 times; more similar pairs more seldom.
BITS, TABLES = 256, 12
#: Bits that may differ between candidates: 39 do on average at 0.8, and more than so many about once in 100,000 times.
DIFFER = 64
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BITS // 64 + TABLES, np.uint64) << np.uint64(1) | np.uint64(1)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    x = (hashes ^ (hashes >> np.uint64(29))) * _ODD[k]
    return x ^ (x >> np.uint64(32))


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a set of hashes: the pivot of each table, which is the least of the hashes in an order of its own, and the SimHash
    of BITS bits as longs. The empty set has zeros."""
    pivots, words, own = np.zeros(TABLES, np.int64), np.zeros(BITS // 64, np.uint64), hashes.view(np.uint64)
    if len(own):
        for k in range(BITS // 64):
            words[k] = _majority(_mixed(own, k), [len(own)])[0]
        for k in range(TABLES):
            pivots[k] = _mixed(own, BITS // 64 + k).min().view(np.int64)
    return pivots, words.view(np.int64)


def _hashed(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    from xxhash import xxh64_digest

    return np.unique(np.frombuffer(b"".join([xxh64_digest(p, SEED) for p in set(shingles(text, size))]), "<i8"))


def _sets(size: int):
    """doc_id, SHA-256 of the text (its first half), pivots and fingerprint of its distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                digests = [sha256((t or "").encode("utf-8", "surrogatepass")).digest()[:16] for t in texts]
                found = [signature(_hashed(t, size)) for t in texts]
                columns = [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), *columns], ["doc_id", "digest", "pivots", "bits"])

    return run


WORDS = tuple(f"b{k}" for k in range(BITS // 64))


def similar(first: DataFrame) -> DataFrame:
    """Links (a, b) that connect rows of first (doc_id, pivots, bits) which meet in a table and differ in DIFFER bits at most.

    Table k is addressed by pivot k and byte k of the fingerprint. A row stands under its own byte and looks up the Hamming
    ball of radius 1; of two bytes only the smaller looks up the larger. The pivot keeps a table's buckets small at any
    number of rows: rows without a common shingle never meet.
    """
    byte = lambda k: F.shiftrightunsigned(F.get("bits", k // 8), k % 8 * 8).bitwiseAND(F.lit(255))
    tables = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("seg"), F.get("pivots", k).alias("pivot"), byte(k).alias("byte")) for k in range(TABLES)])
    ball = F.filter(F.transform(F.lit(np.array([0, *(1 << j for j in range(8))], np.int64)), lambda m: F.col("t.byte").bitwiseXOR(m)), lambda x: x >= F.col("t.byte"))
    rows = first.select(F.col("doc_id").alias("rep"), *[F.get("bits", k).alias(w) for k, w in enumerate(WORDS)], F.explode(tables).alias("t"))
    rows = rows.select("rep", *WORDS, "t", F.explode(ball).alias("byte"))
    rows = rows.select(F.col("t.seg").alias("seg"), F.xxhash64("t.pivot", "byte").alias("key"), "rep", *WORDS, (F.col("byte") == F.col("t.byte")).alias("own"))
    return _linked(rows, DIFFER, partitions(first, 3), WORDS)  # a row becomes some 60 short ones


def _shingle_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [_hashed(t, size) for t in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(sets, pa.list_(pa.int64()))], list(HELD))

    return run


def _prints(bits) -> np.ndarray:
    return np.stack(list(bits)).astype(np.int64).view(np.uint64) if len(bits) else np.zeros((0, BITS // 64), np.uint64)


def _resembling(words: np.ndarray, print_: np.ndarray, others: list[np.ndarray], prints: np.ndarray, open_: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the open others have a Jaccard similarity of at least `similarity` to the set. Only those whose fingerprints
    are near, as those of candidates are, and whose sizes allow it are compared word for word."""
    near = open_[np.bitwise_count(prints[open_] ^ print_).sum(axis=1) <= DIFFER]
    sizes = np.array([len(others[k]) for k in near], np.int64)
    fits = np.minimum(sizes, len(words)) >= similarity * np.maximum(sizes, len(words)) - 1e-9
    near, sizes = near[fits], sizes[fits]
    if not len(words) or not len(near):
        return near  # sets without words resemble each other
    out, at = [], 0
    while at < len(near):  # in pieces of bounded size
        stop = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), PIECE, "right")))
        flat = np.concatenate([others[k] for k in near[at:stop]])
        hit = words[np.minimum(np.searchsorted(words, flat), len(words) - 1)] == flat
        both = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[at:stop])[:-1]]))
        out.append(near[at:stop][both >= similarity * (len(words) + sizes[at:stop] - both) - 1e-9])
        at = stop
    return np.concatenate(out)


def _greedy(similarity: float):
    """Settle one component in ascending doc_id: who resembles an earlier one that stays goes. Adds alike."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "digest"], kind="stable")
        words, prints = list(pdf["words"]), _prints(pdf["bits"])
        alike, left = np.zeros(len(pdf), bool), np.arange(len(pdf))
        while len(left) > 1:
            head, left = left[0], left[1:]
            gone = _resembling(words[head], prints[head], words, prints, left, similarity)
            alike[gone] = True
            left = left[~alike[left]]
        return pdf.assign(alike=alike)[[*HELD, "alike"]]

    return run


def _against(similarity: float):
    """Rows of one part of a component that resemble one of the component's settled documents."""

    def run(rows: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        words, prints = list(rows["words"]), _prints(rows["bits"])
        alike, left = np.zeros(len(rows), bool), np.arange(len(rows))
        for one, print_ in zip(heads["words"], _prints(heads["bits"])):
            alike[_resembling(one, print_, words, prints, left, similarity)] = True
            left = left[~alike[left]]
        return rows.assign(alike=alike)[[*HELD, "alike"]]

    return run


#: Words that a task settles at once (8 bytes each): components with more are cut in parts, and of such a component documents
#: with some HEADS words are settled first, then compared with all parts, and so on.
TASK, HEADS, PIECE = 1_500_000, 300_000, 1 << 20
HELD = ("doc_id", "digest", "component_id", "bits", "words")
HELD_SCHEMA = "doc_id long, digest binary, component_id long, bits array<long>, words array<long>"
SET = HELD_SCHEMA + ", alike boolean"


def _settle(left: DataFrame, similarity: float) -> DataFrame:
    """doc_id and digest of the rows (HELD) that resemble a row of their component with a smaller id that stays."""
    gone: list[DataFrame] = []
    while True:
        counts = left.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("words") + 16).alias("w"))
        few = left.join(counts.filter(F.col("w") <= TASK), "component_id").select(*HELD)
        gone.append(stored(few.groupBy("component_id").applyInPandas(_greedy(similarity), SET).filter("alike").select("doc_id", "digest"), "gone"))
        big = stored(counts.filter(F.col("w") > TASK), "big")
        if not big.head(1):
            return reduce(DataFrame.unionAll, gone)
        rows = stored(left.join(big, "component_id"), "rows")
        # A cut below which a component has some HEADS words: the smallest id that a hash draws with the chance for it.
        drawn = F.pmod(F.xxhash64(F.lit("cut"), "doc_id"), F.greatest(F.lit(1), F.floor(F.lit(HEADS) * F.col("n") / F.col("w")))) == 0
        parts = F.ceil(F.col("w") / TASK).cast("int")
        cut = rows.groupBy("component_id").agg(F.coalesce(F.min(F.when(drawn, F.col("doc_id"))), F.max("doc_id")).alias("cut"))
        rows = stored(rows.join(cut, "component_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int")), "rows")
        heads = rows.filter("doc_id <= cut").select(*HELD)
        settled = stored(heads.groupBy("component_id").applyInPandas(_greedy(similarity), SET), "settled")
        gone.append(settled.filter("alike").select("doc_id", "digest"))
        spread = settled.filter("not alike").join(big, "component_id").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        rest = rows.filter("doc_id > cut").groupBy("component_id", "part").cogroup(spread.groupBy("component_id", "part"))
        judged = stored(rest.applyInPandas(_against(similarity), SET), "judged")
        gone.append(judged.filter("alike").select("doc_id", "digest"))
        left = judged.filter("not alike").select(*HELD)


def deduplicate(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay when one document of each group of near copies is kept.

    Equal texts are one group; the row with the smallest doc_id stays, and a repeated row once. Distinct texts get SimHash
    fingerprints of their sets of `size`-word shingles; multi-index hashing (see similar) finds and verifies candidates, and
    linked ones are compared by those sets, in ascending doc_id: what has a Jaccard similarity of at least `similarity` to a
    document that stays goes. Null and empty texts are equal to each other; of those one stays, as it does of texts without
    words. A null doc_id counts as larger than any other, and such a text is only compared with equal ones. Very long texts
    are read whole, one at a time. An empty table stays empty; all columns are kept, whatever their names.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = held.withColumn("digest", F.unhex(F.substring(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256), 1, 32)))
    seen = stored(held.select("doc_id", "text").mapInArrow(_sets(size), "doc_id long, digest binary, pivots array<long>, bits array<long>"), "seen")
    first = stored(seen.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("pivots").alias("pivots"), F.first("bits").alias("bits")), "first")
    known = first.filter("doc_id is not null")
    roots = components(similar(known)).select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))
    members = stored(known.select("doc_id", "digest", "bits").join(roots, "doc_id"), "members")
    texts = held.select("doc_id", "digest", "text").join(members, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select("doc_id", "digest", "component_id", "bits", "text")
    sets = stored(texts.mapInArrow(_shingle_sets(size), HELD_SCHEMA), "sets")
    gone = _settle(sets, similarity).distinct()
    keepers = first.join(gone, ["doc_id", "digest"], "left_anti").select(F.col("doc_id").alias("keeper"), "digest")
    kept = held.join(keepers, "digest").filter(F.col("doc_id").eqNullSafe(F.col("keeper"))).dropDuplicates(["digest"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
