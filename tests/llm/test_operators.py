import random
import re
from collections import Counter, defaultdict
from hashlib import md5, sha256
from zlib import crc32

import numpy as np
import pytest
import xxhash

from docloom.llm import chunks, decontam, html_text, mixing, pfor, pii, quality, sharding, simhash, suffix, tokens
from docloom.llm.components import components
from docloom.llm.tagger import KINDS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, copy string, n_words string, _x int"


def corpus() -> list[tuple]:
    rng = random.Random(4)
    words = ["".join(rng.choice(["an", "er", "th", "ou", "st", "ea", "li", "ß", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    passage = text(70)
    out = [(k, text(rng.randint(60, 200))) for k in range(40)]
    out += [(100 + k, text(30) + " " + passage + "\n" + text(20)) for k in range(8)]
    out += [(200 + k, out[3][1]) for k in range(5)]
    long = text(300)
    out += [(300 + k, long.replace(long.split()[10 + k], "changed", 1)) for k in range(4)]
    out += [(400, None), (401, ""), (402, None), (403, " \n\t "), (404, "word " * 3000), (405, "x" * 50000), (7, out[7][1]), (7, "another text with the same id"), (None, text(60)), (None, passage)]
    out += [(406, "Der " * 200), (407, text(4000))]
    return [(d, t, "en", "src0" if (d or 0) % 3 else None, 0, "s", "c", "w", 1) for d, t in out]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


# 1
def test_base_patterns_equal_plain_regular_expressions():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
    rng = random.Random(1)
    for _ in range(20000):
        s = "".join(rng.choice("a1.@@-+ (é") for _ in range(rng.randint(1, 30)))
        assert [m.span() for m in email.finditer(s)] == pii.emails(s)
        want = [m.span() for m in ip.finditer(s) if all(int(p) <= 255 for p in m[0].split("."))]
        assert pii.base_spans(s)["ip"] == want
    assert pii.base_spans("card 4111 1111-1111 1111, not 4111 1111 1111 1112")["card"] == [(5, 24)]
    assert pii.base_spans("ring +1 (487) 555-7209 now, +12 no")["phone"] == [(5, 22)]


def plain_spans(text):
    """All base spans by the plain patterns."""
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda x: True),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", lambda x: 16 <= len(digits(x)) <= 19 and luhn(digits(x))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(digits(x)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok(m[0])] if k != "email" or "@" in text else [] for k, (p, ok) in kinds.items()}


def test_base_spans_equal_plain_patterns_on_whole_tables():
    import pyarrow.parquet as pq

    texts, rng = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()], random.Random(11)
    made = lambda: "".join(rng.choice(["4111 1111 1111 1111", "4111111111111111", "1234-5678-9012-3456", "+1 (415) 555-0123", "+49 30 1234567", "10.0.0.256", "192.168.0.1", "a.b@c-d.org", "12", "7", " ", "-", ".", "+", "(", "x", "@"]) for _ in range(rng.randint(1, 12)))
    found = Counter()
    for t in texts + [made() for _ in range(5000)]:
        got = pii.base_spans(t)
        assert got == plain_spans(t)
        found += Counter({k: len(v) for k, v in got.items()})
    assert all(found[k] > 100 for k in KINDS)


def test_tagger_learns_and_windows_agree():
    model = pii.trained()
    _, ids, tags = pii.labelled(200, seed=99)
    hit = sum((np.array(model.viterbi(e)) == t).mean() for e, t in zip(model.emissions(ids), tags)) / 200
    assert hit > 0.9
    text = "an er th " * 30 + "mail 10[.]20[.]30[.]40 is " + "an er th " * 40
    shifted = "ea st " * 5 + text
    a, b = pii.tag_texts(model, [text, shifted])
    assert [(k, s + 30, e + 30) for k, s, e in a] == b
    assert pii.tag_texts(model, ["no digits here " * 50, ""]) == [[], []]


def test_long_stretches_are_decoded_as_one():
    rng, model = random.Random(5), pii.trained()
    text = " ".join("an er th " + "[.]".join(str(rng.randint(10, 255)) for _ in range(4)) + " is" for _ in range(900))
    total, mass = np.zeros((len(text), len(pii.TAGS))), np.zeros((len(text), 1))
    weight = np.minimum(np.arange(1, 97), np.arange(96, 0, -1)).astype(float)[:, None]
    for at in range(0, len(text), 48):
        part = text[at : at + 96]
        total[at : at + 96] += (model.emissions(np.stack([pii.encode(part, 96)]))[0] * weight)[: len(part)]
        mass[at : at + 96] += weight[: len(part)]
    want, path = [], [*model.viterbi(total / mass), 0]
    for k in range(len(text)):
        if path[k] % 2:
            stop = next(j for j in range(k + 1, len(path)) if path[j] != path[k] + 1)
            want += [(pii.TAGS[path[k]][2:], k, stop)] if pii.plausible(pii.TAGS[path[k]][2:], text[k:stop]) else []
    found = pii.tag_texts(model, ["", text, "x 1"])[1]
    assert len(text) > 20000 and len(want) > 200 and found == want and all(a[2] <= b[1] for a, b in zip(found, found[1:]))


def test_personal_data(docs, rows, empty):
    model = pii.trained()
    got = pii.personal_data(docs, model).collect()
    assert len(got) == len(rows) and pii.personal_data(empty, model).count() == 0
    for r in got:
        assert r.base_sha256 == sha256(b"").hexdigest() and (r.n_email, r.n_ip, r.n_card, r.n_phone) == (0, 0, 0, 0)


# 2
def test_sharding(docs, rows, empty):
    got = sharding.shard_documents(docs, 40, rows_each=5).collect()
    assert len(got) == len(rows) and sharding.shard_documents(empty).count() == 0
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 16, crc32((t or "").encode())) for d, t in pairs(rows))


def test_shards_grow_only_into_the_new_one_and_evenly(spark):
    ids = spark.range(20000)
    from pyspark.sql import functions as F

    got = ids.select(*[sharding.place(F.col("id"), sharding.layout(n)).alias(f"s{n}") for n in (40, 41, 42)]).collect()
    assert all(r.s41 in (r.s40, 40) and r.s42 in (r.s41, 41) for r in got)
    sizes = Counter(r.s40 for r in got)
    assert len(sizes) == 40 and max(sizes.values()) < 1.3 * 500 and min(sizes.values()) > 0.7 * 500


# 3
def plain_removal(rows):
    seen, out = {}, {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            seen[s] = min(seen.get(s, 1 << 62), (1 << 61) if d is None else d)
    for n, (d, t) in enumerate(rows):
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for i in range(len(b) - 49):
            if seen[b[i : i + 50]] < ((1 << 61) if d is None else d):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[n] = (d, len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), sha256(kept).hexdigest())
    return Counter(out.values())


def test_substring_removal_is_exact(docs, rows, empty):
    assert Counter(map(tuple, suffix.remove_repeats(docs).collect())) == plain_removal(pairs(rows))
    assert suffix.remove_repeats(empty).count() == 0


def test_substring_removal_on_hard_texts(spark, monkeypatch):
    rng = random.Random(9)
    base = "".join(rng.choice("ab") for _ in range(400))
    texts = [base, base[100:300], "x" + base[60:190] + "y" + base[200:260], "a" * 300, "ab" * 200, base[:49], base[:50], "é" * 60, "b" + "a" * 120]
    texts += ["".join(rng.choice("ab") for _ in range(30)) + base[k : k + rng.randint(45, 90)] + "".join(rng.choice("ab") for _ in range(30)) for k in range(0, 300, 12)]
    rows = [(rng.randint(0, 20), t) for t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, suffix.remove_repeats(df).collect())) == plain_removal(rows)


def test_bucket_refinement_equals_comparison():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1200] = data[100:300]
    at = np.arange(0, 2900)
    names = suffix.equal_spans(data, at)
    texts = [data[k : k + 50].tobytes() for k in at]
    assert len(set(zip(names.tolist(), texts))) == len(set(texts)) == len(set(names.tolist()))


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abc ") for _ in range(6000)).encode()
    block = suffix.Block.of([1], [text])
    whole = sorted(zip(*[c.tolist() for c in next(suffix._pieces(block))]))
    monkeypatch.setattr(suffix, "PIECE", 1000)
    assert sorted(x for part in suffix._pieces(block) for x in zip(*[c.tolist() for c in part])) == whole


def edges(n):
    """Texts around one phrase, in varied surroundings that share a few bytes with others."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(30)]
    around = lambda: " ".join(rng.choice(words) for _ in range(9))
    return [(rng.randint(0, n), (around() + " an unusually common phrase of forty-odd bytes " + around())[rng.randint(0, 40) :]) for _ in range(n)]


def refined(folder, rows, buckets=1):
    """What the refinement says of one block of rows, and the most memory that it took, in bytes."""
    import tracemalloc

    block = suffix.Block.of([d for d, _ in rows], [t.encode() for _, t in rows])
    block.save(folder, 0)
    asked = [r for r in suffix._match(0, list(suffix._send(buckets)(0, block))) if r[2] == suffix.FETCH]
    fetched = [tuple(r.values()) for b in suffix._fetch(folder)(0, asked) for r in b.to_pylist()]
    tracemalloc.start()
    parts = [suffix.unpack(r[3]) for r in suffix._refine(0, fetched)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    gone = {(t, k) for p in parts for t, s, e in zip(*[c.tolist() for c in p]) for k in range(s, e)}
    return gone, peak


def test_memory_of_refinement_for_a_frequent_anchor(tmp_path):
    peak = refined(str(tmp_path), edges(30000))[1]
    assert peak < 200 << 20


def test_substring_removal_around_a_frequent_anchor(spark):
    rows = edges(30000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, suffix.remove_repeats(df).collect())) == plain_removal(rows)


def test_refinement_does_not_depend_on_what_is_sorted_at_once(tmp_path, monkeypatch):
    rows = edges(400) + [(k, "ab" * 60 + str(k % 3)) for k in range(40)]
    whole = refined(str(tmp_path), rows)[0]
    for size in (1, 100, 5000):
        monkeypatch.setattr(suffix, "AT_ONCE", size)
        assert refined(str(tmp_path), rows)[0] == whole


# 4
def plain_cuts(data):
    """Chunk ends by the definition: where the hash of the last bytes is the least of those around."""
    R, n = chunks.REACH, len(data)
    h = [sum(int(chunks.GEAR[data[i - k]]) << k for k in range(min(R, i + 1))) % (1 << 32) for i in range(n)]
    ends = [i + 1 for i in range(R, n - R) if h[i] == min(h[i - R : i + R + 1]) and i + 1 < n]
    if any(b - a < R for a, b in zip([0, *ends], ends)):
        kept = []
        for e in ends:
            if e - (kept[-1] if kept else 0) >= R:
                kept.append(e)
        ends = kept
    out = []
    for a, b in zip([0, *ends], [*ends, n]):
        out += [*range(a + chunks.LONGEST, b, chunks.LONGEST), b]
    return out if n else []


def test_cuts_equal_their_definition():
    rng = random.Random(9)
    for _ in range(60):
        data = bytes(rng.choice(b"abc de") if rng.random() < 0.9 else rng.randint(0, 255) for _ in range(rng.choice([0, 1, 15, 16, 17, 33, 200, 900])))
        data += rng.choice([b"", b"x" * 300, b"ab" * 100, data[:50]])
        assert chunks.cuts(np.frombuffer(data, np.uint8)).tolist() == plain_cuts(data)


def test_periodic_passages_keep_their_cuts():
    for unit in (b"ab", b"word ", b"0123456789" * 3):
        passage = unit * 400
        found = [chunks.digests_of(before + passage)[1].tolist() for before in (b"one text that stands here before it ", b"quite another start, and longer than the first one was, ")]
        assert sum(d in found[0] for d in found[1]) > 0.9 * len(found[1]) and len(found[1]) > 20


def test_cuts_resist_insertions():
    rng = random.Random(8)
    text = bytes(rng.randrange(97, 123) for _ in range(5000))
    a = set(chunks.cuts(np.frombuffer(text, np.uint8)).tolist())
    b = {e - 7 for e in chunks.cuts(np.frombuffer(text[:2000] + b"INSERT!" + text[2000:], np.uint8)).tolist()}
    assert {e for e in a if e > 2100} == {e for e in b if e > 2100}
    assert chunks.cuts(np.zeros(5000, np.uint8)).tolist()[-1] == 5000 and len(chunks.cuts(np.zeros(0, np.uint8))) == 0


def test_chunk_deduplication(docs, rows, empty):
    owner = {}
    for d, t in pairs(rows):
        if d is not None:
            for x in chunks.digests_of((t or "").encode())[1].tolist():
                owner[x] = min(owner.get(x, 1 << 62), d)
    want = Counter()
    for d, t in pairs(rows):
        data = (t or "").encode()
        ends, found = chunks.digests_of(data)
        own = [owner[x] < d for x in found.tolist()] if d is not None else []
        runs, k, edges = [], 0, [0, *ends.tolist()]
        while k < len(own):
            j = k
            while j < len(own) and own[j]:
                j += 1
            if edges[j] - edges[k] >= chunks.LEAST_RUN:
                runs.append((edges[k], edges[j]))
            k = max(j, k + 1)
        if runs:
            want[(d, sum(e - s for s, e in runs), len(runs))] += 1
    got = chunks.deduplicate(docs).collect()
    assert Counter((r.doc_id, r.n_removed, r.n_spans) for r in got) == want and chunks.deduplicate(empty).count() == 0
    assert {200, 201, 202, 203, 204} <= {r.doc_id for r in got} and {101, 107} <= {r.doc_id for r in got}


def test_short_passages_in_other_contexts_are_found(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.choice([2, 3, 3, 4, 4, 5, 6]))) for _ in range(4000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    made = []
    for n in range(300):
        passage = some(51)
        made += [(n, " ".join(some(60) + passage + some(60))), (1000 + n, " ".join(some(90) + passage + some(60)))]
    got = {r.doc_id: r for r in chunks.deduplicate(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert set(got) == set(range(1000, 1300)) and all(r.owners == [d - 1000] for d, r in got.items())


# 5
def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs, rows, empty):
    prints = [(d, plain_print(t)) for d, t in pairs(rows)]
    known = [(d, p) for d, p in prints if d is not None]
    root = {p: min(d for d, q in known if q == p) for _, p in known}
    changed = True
    while changed:
        changed = False
        for p in root:
            low = min(root[q] for q in root if (p ^ q).bit_count() <= 3)
            changed |= low < root[p]
            root[p] = low
    want = Counter((d, f"{p:016x}", root.get(p)) for d, p in prints)
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want and simhash.near_duplicates(empty).count() == 0


def test_links_reach_every_pair(spark):
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for n in range(1, 9):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), n)))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)], "fp long, rep long")
    for most, segments in ((3, 2), (7, 4), (5, 3)):
        got = {r.node: r.root for r in components(simhash.links(df, most, segments)).collect()}
        root = list(range(len(fps)))
        for _ in range(20):
            for i in range(len(fps)):
                root[i] = min(root[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= most)
        assert all(got.get(i, i) == root[i] for i in range(len(fps)))


def jaccard(a, b):
    s = [set(simhash.shingles(t, 5)) for t in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_one_of_each_near_copy_stays(docs, rows, empty):
    got = simhash.deduplicate(docs)
    assert got.columns == docs.columns and simhash.deduplicate(empty).count() == 0
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len({t or "" for _, t in kept}) == len(kept)
    ids = {d for d, _ in kept}
    assert not ids & {200, 201, 202, 203, 204, 401, 402} and 3 in ids and 300 in ids and set(range(40)) <= ids
    assert not ids & {301, 302, 303} and jaccard(rows[-1][1], rows[0][1]) < 0.1


def near_copies() -> list[tuple[int, str, int | None]]:
    """Originals, and a copy of each at a similarity of 0.8 to 0.9 or just below 0.8: a block added at the end, at the start, or
    words replaced. Rows: doc_id, text, doc_id of the original."""
    rng, out = random.Random(8), []
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    for n in range(240):
        w = [word() for _ in range((60, 200, 600)[n % 3])]
        more = [word() for _ in range(int(len(w) * (0.12, 0.2, 0.24)[n // 3 % 3]))]
        if n % 4 < 2:
            copy = w + more if n % 4 else more + w
        else:
            at = set(rng.sample(range(len(w)), max(1, len(w) // (50, 46, 42)[n // 3 % 3])))
            copy = [word() if k in at else x for k, x in enumerate(w)]
        out += [(2 * n, " ".join(w), None), (2 * n + 1, " ".join(copy), 2 * n)]
    return out


@pytest.mark.parametrize("hot", [20_000, 64])
def test_no_pair_of_near_copies_is_missed(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    made = near_copies()
    text = {d: t for d, t, _ in made}
    gone = {d for d, t, of in made if of is not None and jaccard(t, text[of]) >= 0.8}
    assert 150 < len(gone) < 240
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame([r[:2] for r in made], "doc_id long, text string")).collect()}
    assert set(text) - kept == gone


@pytest.mark.parametrize("task, heads", [(1_500_000, 300_000), (2000, 400), (700, 5000)])
def test_large_components_are_settled_alike(spark, monkeypatch, task, heads):
    monkeypatch.setattr(simhash, "TASK", task)
    monkeypatch.setattr(simhash, "HEADS", heads)
    monkeypatch.setattr(simhash, "PIECE", 500)
    rng, sets = random.Random(3), []
    for c in (1, 2):
        for d in range(50):
            w = set(range(100)) - set(rng.sample(range(100), rng.choice([2, 5, 12, 20]))) | set(rng.sample(range(1000, 1100), rng.choice([1, 4, 10])))
            sets.append((d * 2 + c, b"%d" % d, c, [0, 0, 0, 0], sorted(w)))
    gone = set()
    for c in (1, 2):
        stay = []
        for d, _, _, _, w in sorted(r for r in sets if r[2] == c):
            if any(len(set(w) & s) / len(set(w) | s) >= 0.8 for s in stay):
                gone.add(d)
            else:
                stay.append(set(w))
    df = spark.createDataFrame(sets, simhash.HELD_SCHEMA)
    assert {r[0] for r in simhash._settle(df, 0.8).collect()} == gone


def test_long_half_similar_texts_are_settled_in_bounded_time_and_memory():
    import tracemalloc
    from time import process_time

    import pandas as pd

    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 62, 4500)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 62, 1500)])) for _ in range(240)]  # 1.4 million words: a whole task
    rows = pd.DataFrame({"doc_id": range(240), "digest": [b""] * 240, "component_id": 1, "bits": [simhash.signature(s)[1] for s in sets], "words": sets})
    tracemalloc.start()
    began = process_time()
    out = simhash._greedy(0.8)(rows)
    took, peak = process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not out["alike"].any() and took < 60 and peak < 200e6


def test_hot_buckets_are_split_without_losing_links(spark, monkeypatch):
    rng, fps = random.Random(5), set()
    for group in range(3):
        seed = rng.getrandbits(32) << 32 | 0xABCD0123  # one low segment for all: a hot bucket
        while len(fps) < 150 * (group + 1):
            fps.add(seed ^ sum(1 << b for b in rng.sample(range(32, 64), rng.choice([1, 2, 3, 4]))))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)], "fp long, rep long")
    plain = {(r.node, r.root) for r in components(simhash.links(df)).collect()}
    monkeypatch.setattr(simhash, "HOT", 40)
    monkeypatch.setattr(simhash, "SHARE", 2)
    assert {(r.node, r.root) for r in components(simhash.links(df)).collect()} == plain and len(plain) > 100


# 6
def test_encoder_equals_the_library():
    coder, rng = tokens.Encoder(tokens.vocabulary()), random.Random(7)
    texts = ["".join(rng.choice(["a", "the", " ", " ", "\n", "'s", "12", ".", ",", "é", "ß", "_", "¼", "-", "日", "\xa0", "<|endoftext|>", "\0"]) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert coder.encode(texts) == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_encoder_equals_the_library_on_whole_tables(sf):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    coder = tokens.Encoder(tokens.vocabulary())
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        assert coder.encode(part) == [np.array(e.ids, "<u4").tobytes() for e in coder.tokenizer.encode_batch(part, add_special_tokens=False)]


@pytest.mark.parametrize("top", [1, 2, 300, 50257, 2**32 - 1])
def test_packed_blocks_round_trip(top):
    rng = np.random.default_rng(top % 1000)
    for n in (0, 1, 127, 128, 129, 5000):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        ids[rng.random(n) < 0.02] = top
        data = pfor.Reader(pfor.dump(np.array([1]), np.array([n]), ids))
        assert (data.read(0, n) == ids).all()
        for s in (0, n // 3, max(0, n - 130)):
            assert (data.read(s, n) == ids[s:]).all()


def test_token_files(docs, rows, empty):
    coder = tokens.Encoder(tokens.vocabulary())
    got = sorted(map(tuple, tokens.token_files(docs).collect()), key=lambda r: r[1])
    assert tokens.token_files(empty).count() == 0 and len(got) == len(rows)
    ids = [r[0] for r in got]
    unnamed = ids.count(None)
    assert ids[:unnamed] == [None] * unnamed and unnamed == 2 and ids[unnamed:] == sorted(ids[unnamed:]) and [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    want = Counter((d, len(x) // 4 + 1, crc32(x + b"\0\0\0\0")) for (d, _), x in zip(pairs(rows), coder.encode([t or "" for _, t in pairs(rows)])))
    assert Counter((r[0], r[2], r[3]) for r in got) == want


# 7
BENCH = [(1, "A train with Anna leaves Paris at 5 pm and goes 80 km per hour for 3 hours so how far does Anna travel."), (2, "the quick brown fox jumps over the lazy dog and runs away from it all"), (3, "one two three"), (4, None), (5, "short but enough words here")]


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    extra = [(900, "Before. " + BENCH[0][1] + " After."), (901, "Well then. A train with Berta leaves Rome at 7 pm and goes 95 km per hour for 4 hours so how far does Berta travel. Fine."), (902, "A train with Berta leaves Rome at 7 pm and goes 95 km per hour for 4 hours so how far does Carla travel."), (903, "The quick brown fox jumps over nothing"), (904, BENCH[1][1].replace(" ", "\n")), (905, "say short but enough words here now"), (906, "one two three")]
    all_ = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(all_, bench).collect()}
    assert set(got) == {(900, 1), (901, 1), (904, 2), (905, 5)}
    assert got[(900, 1)].exact and not got[(901, 1)].exact
    left = {r.doc_id for r in decontam.drop_contaminated(all_, bench).collect()}
    assert not left & {900, 901, 904, 905} and {902, 903, 906, 400, None} <= left
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_contaminated_pairs_equal_the_plain_version(spark, sf_dir):
    import plain

    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: plain.tokens_of(r.text) for r in bench.collect()}
    want = set()
    for r in docs.select("doc_id", "text").collect():
        words = plain.tokens_of(r.text)
        found = {w: plain.keyed(words, w) for w in {min(8, len(i)) for i in items.values() if len(i) >= 5}}
        want |= {(r.doc_id, k) for k, i in items.items() if len(i) >= 5 and plain.holds(words, found[min(8, len(i))], i)}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == want and want


def test_items_of_numbers_and_names_are_found_word_for_word(spark):
    items = ["12, 15, 18, 21, 24, 27, 30, 33, 36, 39, 42, 45", "Anna Berta Carla Dora Emma Frida Greta Hanna Ida Jana", "GIVE THE SUM OF ALL PRIME NUMBERS BELOW NINETY AND TEN", "3 4 5 6 7"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"And so it goes on: {t} and then it ends here." for t in items] + [f"we know {t} and more of it" for t in items] + ["we saw 12, 15, 18, 99, 24, 27, 31, 33, 36, 40, 42, 45 in it", "we met Anna Berta Carla Zoe Emma Frida Xenia Hanna Ida there", "3 4 5 6 8"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.exact) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(k, k % 4, True) for k in range(8)}


# 8
@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>a<b>b</b>c</p><p>&lt;x &amp;amp; y", "abc <x &amp; y"),
        ("<nav>menu</nav><article><header>H</header><h1>T</h1><p>One</p><aside>no</aside><div class='comment'>c</div><p>Two<br>three</article><footer>f</footer>", "T One Two three"),
        ("<body><div id=main-menu>m</div><div class=sidebar>s</div><main><p>x  y\n z</p></main><script>var a='<p>'</script>", "x y z"),
        ("<div class='cookie-notice'>We use</div><div>" + "word " * 40 + "</div><div>tail</div>", ("word " * 40).strip() + " tail"),
        ("<article><p>kept<form><input><button>b</button></form><p>also<!-- c --><style>p{}</style></article>", "kept also"),
        ("<!-- open", ""), ("", ""), (None, ""), ("<article><p>1 &lt; 2 <p>last", "1 < 2 last"), ("plain text only", "plain text only"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_markup_only_weighs():
    prose = "Some words that make a line of running text which is as long as prose in an article usually is."
    # An article element that holds a teaser only does not win over the text beside it.
    assert html_text.main_text(f"<article><p>Read this</p></article><div><p>{prose}</p><p>{prose}</p><p>{prose}</p></div>") == " ".join(["Read this", prose, prose, prose])
    # Hints in names say nothing against prose, but go with short lines.
    for hint in ("id=related-work", 'class="header-image"', 'class="social-history"'):
        assert html_text.main_text(f"<article><p>{prose}</p><section {hint}><p>{prose}</p></section><p>Fin.</p></article>") == f"{prose} {prose} Fin."
        assert html_text.main_text(f"<article><p>{prose}</p><section {hint}><p>One</p><p>Two</p></section><p>Fin.</p></article>") == f"{prose} Fin."
    # Without an article element: lists of links go, a short paragraph between adverts stays, and so does a link in prose.
    links = "".join(f"<li><a href=/{k}>Page number {k}</a></li>" for k in range(9))
    body = f"<p>{prose}</p><p>{prose}</p><div class=ad>Buy</div><p>Short.</p><div class=ad>Buy</div><p><a href=x>See the report</a></p><p>{prose}</p>"
    assert html_text.main_text(f"<body><ul>{links}</ul><div>{body}</div><ul>{links}</ul></body>") == f"{prose} {prose} Short. See the report {prose}"


def test_quotes_open_only_values():
    assert html_text.main_text('<article><a title="5" tall">link</a> <b x=\'a>b\'>bold</b> <i q="open>lost') == "link bold"
    assert html_text.main_text("<article><p class='comment'>gone</p><p data-x=y>kept</p></article>") == "kept"


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "deep", "</b>" * 200_000 + "<p>" * 100_000 + "x", "<p><b>" * 100_000 + "t</i>" * 50_000, "<" * 1_000_000, "<a b=" * 200_000, "<li><b>" * 100_000])
def test_a_megabyte_of_odd_markup_is_linear(html):
    from time import process_time

    began = process_time()
    html_text.main_text(html)
    assert process_time() - began < 8


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>é" + "x" * 10000 + "</article>", 9), (1, "u", None, 9), (None, None, "", 9)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id or 0, r.n_chars) for r in html_text.extract(pages).collect()) == [(0, 0), (1, 0), (1, 10001)]
    assert html_text.extract(pages.limit(0)).count() == 0


# 9
def test_mixing(docs, rows, empty):
    from math import exp

    got = mixing.replicate(docs, {"src0": 4.0}).collect()
    n = Counter(r[3] or "" for r in rows)
    rate = {s: (4.0 if s == "src0" else 1.0) / (4.0 + 1.0) * len(rows) / k for s, k in n.items()}
    want = Counter()
    for d, t, _, s, *_ in rows:
        u = int(md5(f"42:{'' if d is None else d}:1".encode()).hexdigest()[:13], 16) / 2**52
        p = c = exp(-rate[s or ""])
        k = 0
        while c <= u:
            k += 1
            p *= rate[s or ""] / k
            c += p
        want[(d, t)] += k
    assert Counter((r.doc_id, r.text) for r in got) == +want and mixing.replicate(empty, {}).count() == 0
    assert all(1 <= r["copy"] <= r.n_copies for r in got)


def test_mixing_reaches_large_rates(spark):
    df = spark.createDataFrame([(k, "t", "a") for k in range(300)], "doc_id long, text string, source string")
    total = mixing.replicate(df, {}, total=60000).count()
    assert abs(total - 60000) < 5 * 60000**0.5


CLASHES = ["_id", "_digest", "_key", "_cdf", "_parts", "_source", "_rate", "row", "id", "key", "digest", "n", "part", "start", "first", "k", "run", "crc", "keeper", "component_id", "bits", "words", "_doc", "kept", "n_distinct", "shard", "spans", "n_email", "item_id", "place"]


def test_columns_may_have_any_name(spark):
    rows = [(k, f"{'word ' * 30}{k} " * 3, "src0", *[f"{c}{k}" for c in CLASHES]) for k in range(6)] + [(None, None, None, *[None] * len(CLASHES))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    bench = spark.createDataFrame([(1, "none of these words are in any of the texts")], "item_id long, text string")
    want = {r[0]: tuple(r) for r in df.collect()}
    for out in (simhash.deduplicate(df), decontam.drop_contaminated(df, bench), quality.filter_documents(df), mixing.replicate(df, {"src0": 4.0}).select(*df.columns)):
        assert out.columns == df.columns and all(tuple(r) == want[r.doc_id] for r in out.collect())
    kept = sharding.shard_documents(df, 4, keep=[c for c in df.columns if c != "doc_id"])
    assert kept.count() == 7 and all(r["key"] == (r.doc_id is not None and f"key{r.doc_id}" or None) for r in kept.collect())
    assert pii.personal_data(df).count() == 7 and decontam.contaminated(df, bench).count() == 0 and simhash.near_duplicates(df).count() == 7


def test_one_id_and_text_may_hold_most_rows(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 3 > 0 THEN 7 ELSE id END AS doc_id", "CASE WHEN id % 3 > 0 THEN 'same' ELSE 'other' END AS text")
    got = sharding.shard_documents(df, 5, rows_each=100).collect()
    for s in range(5):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len(got) == 5000


# 10
def plain_measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    cover = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines, seen, dup = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)


def test_quality_measures(docs, rows, empty):
    got = quality.judge(docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter((r.doc_id, *[r[n] for n in names]) for r in got.collect()) == Counter((d, *plain_measures(t)) for d, t in pairs(rows))
    for r in got.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert quality.judge(empty).count() == 0
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(40))


def test_measures_of_odd_texts(spark):
    texts = ["a\n\na\n \n b \x0b c\n b \x0b c", "x y z x y z x y", "| # *\t<>&$%\r\n| # *", "\x1c\x85 é\xa0ß", "the the the the", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert {r.doc_id: tuple(r[n] for n in names) for r in quality.judge(df).collect()} == {k: plain_measures(t) for k, t in enumerate(texts)}


def test_variety_sees_the_whole_text(spark):
    rng = random.Random(2)
    rich = lambda n: [f"word{rng.randint(0, 10**6)}" for _ in range(n)]
    poor = lambda n: [rng.choice(["aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh"]) for _ in range(n)]
    texts = [rich(400) + poor(4000), poor(400) + rich(4000), rich(300), poor(300), poor(400), rich(401), []]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    got = quality.measures(df).select("doc_id", "n_distinct", quality.vote("variety").alias("v")).collect()
    blocks = lambda w: sum(len(set(w[k : k + 400])) for k in range(0, len(w), 400))
    assert {r.doc_id: r.n_distinct for r in got} == {k: blocks(w) for k, w in enumerate(texts)}
    assert [r.v for r in sorted(got)] == [0, 1, 1, 0, 0, 1, 0]


def test_weak_supervision_learns_from_votes():
    patterns = [((1,) * 8, 850), ((0, *[1] * 7), 40), ((1, 0, *[1] * 6), 40), ((0, 0, *[1] * 6), 20), ((-1,) * 8, 5)]
    prior, table = quality.fit(patterns)
    p = lambda x: quality._odds(x, prior, table)
    assert p((1,) * 8) > 0 > p((0, 0, *[1] * 6)) and p((0, *[1] * 7)) < 0
    assert quality.fit([])[0] > 0


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 160), (160, 130)] + [(200, k) for k in range(201, 260)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(61)} == {0} and got[130] == got[160] == got[100] == 100 and {got[k] for k in range(200, 260)} == {200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_kinds_are_in_contract_order():
    assert KINDS == ("email", "ip", "card", "phone")
