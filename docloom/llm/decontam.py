"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question asked with other numbers or names keeps its template.
Template windows of documents are joined by hash with those of the benchmark; aligned matches count if their slots agree:
one benchmark value stands for one document value throughout, and the other way round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import stored

#: Words in a window; an item with fewer is one window, but one with fewer than SHORTEST is never looked for.
WIDTH, SHORTEST = 8, 5
#: Words in a window that must be no placeholder; a window with fewer is looked for word by word.
LITERALS = 3
#: Share of an item's words that matching windows must cover for a document to count as contaminated.
SHARE = 0.5
#: Bits of the filter that drops windows before the join: its size is fixed, and it lets every true match through.
FILTER_BITS = 23
# Unit names and number words that become placeholders.
UNITS = set("mm cm m km in inch inches ft feet yd yards mile miles mg g kg t lb lbs oz ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years mph kmh percent % $ € £ usd eur gbp dollar dollars euro euros pound pounds cent cents degree degrees °c °f".split())
NUMBERS = set("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half twice".split())
PUNCTUATION = ".,;:!?\"'()[]{}…“”‘’«»|*_"
LITERAL, CAPITAL, NUMBER, UNIT = 0, 1, 2, 3
MASK = (1 << 64) - 1


class Words:
    """What is known of each raw word: hash of its plain form, kind, whether a sentence ends after it."""

    def __init__(self, most: int = 400_000):
        from xxhash import xxh64_intdigest

        self.hash, self.most, self.number = xxh64_intdigest, most, {}
        self.rows: list[tuple[int, int, bool]] = []
        self.mark = np.array([0] + [xxh64_intdigest(f"<{k}>", 7) for k in ("name", "number", "unit")], np.uint64)

    def _add(self, raw: str) -> int:
        plain = raw.strip(PUNCTUATION) or raw
        low = plain.lower()
        kind = NUMBER if low in NUMBERS or any(c.isdigit() for c in low) else UNIT if low in UNITS else CAPITAL if plain[:1].isupper() else LITERAL
        self.rows.append((self.hash(low.encode("utf-8", "surrogatepass"), 7), kind, raw.rstrip("\"')]”’»")[-1:] in (".", "!", "?", ":")))
        self.number[raw] = len(self.rows) - 1
        return len(self.rows) - 1

    def look(self, words: list[str], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Template hash and kind of each word, hash of its plain form, and whether it is no name for its place only. first:
        places where a text starts. A capital letter makes a name only inside a sentence."""
        if len(self.rows) > self.most:
            self.rows, self.number = [], {}
        get, add = self.number.get, self._add
        ids = np.array([k if (k := get(w)) is not None else add(w) for w in words], np.int64)
        table = np.array(self.rows, dtype=[("h", "<u8"), ("k", "u1"), ("e", "?")]) if self.rows else None
        h, kind, ends = (table[c][ids] for c in ("h", "k", "e"))
        begins = np.zeros(len(ids), bool)
        begins[1:] = ends[:-1]
        begins[first[first < len(ids)]] = True
        opens = (kind == CAPITAL) & begins
        kind = np.where(opens, LITERAL, kind)
        return np.where(kind > 0, self.mark[kind], h), kind, h, opens


_WORDS: list[Words] = []


def windows(texts: list[str | None], widths: list[int], whole: bool = False):
    """All windows of texts: text number, place, hash, width, is it raw; and the words, their kinds and where texts start.

    A window with LITERALS plain words has its template's hash. One that has fewer, or would have inside a sentence, has
    the hash of its raw words (too), so that windows full of placeholders are found where they are copied word for word.
    whole: texts shorter than WIDTH words are one window of their own length (benchmark items).
    """
    if not _WORDS:
        _WORDS.append(Words())
    none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))
    split = [(t or "").split() for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    words = [w for s in split for w in s]
    if not words:
        return *none, words, np.zeros(0, np.uint8), starts
    tokens, kinds, plain_hash, opens = _WORDS[0].look(words, starts[:-1][sizes > 0])
    owner = np.repeat(np.arange(len(texts)), sizes)
    plain = np.concatenate([[0], np.cumsum(kinds == LITERAL)])
    out = []
    for width in widths:
        n = len(words) - width + 1
        if n <= 0:
            continue
        h = np.full(n, width, np.uint64)
        for j in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + tokens[j : j + n]
            h ^= h >> np.uint64(29)
        one, literals = owner[:n] == owner[width - 1 :], plain[width:][:n] - plain[:n]
        for raw in (False, True):
            at = np.flatnonzero(one & (literals - opens[:n] < min(LITERALS, width) if raw else literals >= min(LITERALS, width)))
            if whole:
                at = at[sizes[owner[at]] == width] if width < WIDTH else at
            key = h[at]
            if raw:
                key = np.full(len(at), width ^ MASK, np.uint64)
                for j in range(width):
                    key = key * np.uint64(0x9E3779B97F4A7C15) + plain_hash[at + j]
                    key ^= key >> np.uint64(29)
            out.append((owner[at], at - starts[owner[at]], key, np.full(len(at), width), np.full(len(at), raw)))
    return (*(np.concatenate(c) for c in zip(*out)), words, kinds, starts) if out else (*none, words, kinds, starts)


def _slots(words: list[str], kinds: np.ndarray, at: int, width: int) -> list[str]:
    return [words[k].strip(PUNCTUATION).lower() for k in range(at, at + width) if kinds[k] != LITERAL]


def _emit(batches: Iterator[pa.RecordBatch], widths: list[int], whole: bool, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows: id, key, words of the text, place, width, hash, slot values."""
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            owner, place, h, width, raw, words, kinds, starts = windows(part.column(2).to_pylist(), widths, whole)
            if bits is not None:
                size = np.uint64(len(bits) * 8 - 1)
                a, b = h & size, (h >> np.uint64(32)) & size
                hit = (bits[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & (bits[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1
                owner, place, h, width, raw = (c[hit == 1] for c in (owner, place, h, width, raw))
            slots = [[] if r else _slots(words, kinds, s, w) for s, w, r in zip((starts[owner] + place).tolist(), width.tolist(), raw.tolist())]
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(take), part.column(1).take(take), pa.array((starts[owner + 1] - starts[owner]).astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(width.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(slots, pa.list_(pa.string()))],
                ["id", "key", "size", "place", "width", "h", "slots"],
            )


SCHEMA = "id long, key long, size int, place int, width int, h long, slots array<string>"


def _filter_bits(items: DataFrame) -> np.ndarray:
    """The filter over all window hashes: made in pieces of 64 bits where the windows are, and 1 MB at most here."""
    size = (1 << FILTER_BITS) - 1
    bit = F.explode(F.array(F.col("h").bitwiseAND(size), F.shiftrightunsigned("h", 32).bitwiseAND(size)))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(63).cast("int"))
    found = items.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(one).alias("bits")).collect()
    out = np.zeros((size + 1) // 64, np.int64)
    for r in found:
        out[r.w] = r.bits
    return out.view(np.uint8)


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """Pairs of documents and benchmark items whose template they hold: doc_id, key, item_id, item_words, n_matched, exact.

    A pair counts if windows aligned with consistent slots cover at least `share` of the item's words. exact: all slot
    values are the item's own. Windows with fewer than LITERALS plain words match word for word only. Slots must agree among
    the windows of one alignment. Words split at white space; whole texts, however long, are read. Null and empty texts match
    nothing, nor do items of fewer than SHORTEST words. key is a hash of id and text, which tells apart rows with equal or null ids; equal
    rows give one pair. Either table empty: no rows. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    row = lambda df, name: df.select(F.col(name).cast("long").alias("id"), F.xxhash64(F.col(name).cast("long"), F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    short = list(range(SHORTEST, WIDTH))
    items = row(benchmark, "item_id").mapInArrow(lambda b: _emit(b, [*short, WIDTH], True, None), SCHEMA)
    items = stored(items.distinct(), "items")
    bits = _filter_bits(items)
    widths = sorted(r.width for r in items.select("width").distinct().collect())
    shared = spark.sparkContext.broadcast(bits)  # 1 MB
    found = row(docs, "doc_id").mapInArrow(lambda b: _emit(b, widths, False, shared.value), SCHEMA) if widths else spark.createDataFrame([], SCHEMA)
    found = stored(found, "windows")
    it = items.select("h", "width", *[F.col(c).alias(f"i_{c}") for c in ("id", "key", "size", "place", "slots")])
    pairs = found.join(it, ["h", "width"]).filter(F.size("slots") == F.size("i_slots"))
    values = F.arrays_zip(F.col("i_slots").alias("a"), F.col("slots").alias("b"))
    runs = pairs.groupBy("id", "key", "i_id", "i_key", "i_size", (F.col("place") - F.col("i_place")).alias("shift")).agg(
        F.collect_set(F.struct("i_place", "width")).alias("places"), F.array_distinct(F.flatten(F.collect_set(values))).alias("values")
    )
    one = lambda c: F.size(F.array_distinct(F.transform("values", lambda v: v[c]))) == F.size("values")
    runs = runs.filter(one("a") & one("b"))
    exact = F.forall("values", lambda v: v["a"] == v["b"])
    both = runs.groupBy("id", "key", "i_id", "i_key", "i_size").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"), F.bool_and(exact).alias("exact"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    reach = lambda s, p: F.struct(F.greatest(s.end, p.i_place + p.width).alias("end"), (s.n + F.greatest(F.lit(0), p.i_place + p.width - F.greatest(s.end, p.i_place))).alias("n"))
    both = both.withColumn("n", F.aggregate("places", start, reach).n)
    out = both.filter(F.col("n") >= F.col("i_size") * share)
    return out.select(F.col("id").alias("doc_id"), "key", F.col("i_id").alias("item_id"), F.col("i_size").cast("long").alias("item_words"), F.col("n").cast("long").alias("n_matched"), "exact")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """docs without the rows that contaminated() finds; all columns stay, whatever their names."""
    bad = stored(contaminated(docs, benchmark, share).select("key").distinct(), "bad")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("key"))
    return rows.join(bad, "key", "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
