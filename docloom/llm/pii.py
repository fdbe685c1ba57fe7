"""Personal data: fixed patterns, and spans that a trained character tagger adds."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.tagger import KINDS, TAGS, Tagger, encode

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: No span lies where none of these is near: the tagger need not look there.
TRIGGER = re.compile(r"[0-9@]|\(at\)|\[at\]", re.I)
WINDOW, STRIDE = 96, 48
#: Labelled windows, their length, and steps of training.
SAMPLES, LENGTH, STEPS = 8000, 64, 700
Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """A match starts where the run of local characters before an @ starts, so only the places of @ are looked at."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> dict[str, list[Span]]:
    """The spans of the fixed patterns, leftmost and non-overlapping for each kind."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if DIGIT.search(text):
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def _sample(rng: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """A window of invented words with labelled spans in plain and disguised forms, or numbers that are no personal data."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(["an", "er", "th", "ou", "st", "li", "ko", "ra", "me", "te", "ß", "é", "ción"], rng.integers(1, 5)))
    name = lambda: word() if rng.random() < 0.3 else "".join(rng.choice(list("aaabcdeeefghiiijklmnooopqrstuuvwxyz"), rng.integers(2, 9)))

    def card() -> str:
        head = digits(15)
        return head + next(c for c in "0123456789" if luhn(head + c))

    def made(kind: str) -> str:
        p = rng.integers(0, 4)
        if kind == "email":
            host = f"{name()}{digits(rng.integers(0, 3))}.{rng.choice(['com', 'org', 'net', 'de', 'io', 'example.com'])}"
            local = [f"{name()}.{name()}", f"{name()}{digits(rng.integers(1, 6))}", f"{name()}{digits(rng.integers(0, 3))}", f"{name()}_{name()}"][rng.integers(0, 4)]
            return [f"{local}@{host}", f"{local} at {host}".replace(" at ", "@"), f"{local} (at) {host.replace('.', ' (dot) ')}", f"{local}[at]{host.replace('.', '[dot]')}"][p]
        if kind == "ip":
            four = [str(x) for x in rng.integers(0, 256, 4)]
            return [".".join(four), ".".join(four), "[.]".join(four), " . ".join(four)][p]
        if kind == "card":
            c = card()
            return [c, " ".join(c[k : k + 4] for k in range(0, 16, 4)), "-".join(c[k : k + 4] for k in range(0, 16, 4)), ".".join(c[k : k + 4] for k in range(0, 16, 4))][p]
        a, b, c = digits(3), digits(3), digits(4)
        s = rng.choice(["-", ".", " "])
        return [f"+1 ({a}) {b}-{c}", f"{a}{s}{b}{s}{c}", f"({a}) {b}-{c}", f"00{rng.integers(20, 99)} {a} {b} {c}"][p]

    def other() -> str:
        p = rng.integers(0, 8)
        return [digits(4), f"{digits(2)}.{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f'token = "{"".join(rng.choice(list("0123456789abcdef"), 40))}"', f"${digits(3)},{digits(3)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"@{word()}", digits(rng.integers(5, 15))][p]

    text, spans = "", []
    for _ in range(rng.integers(6, 14)):
        draw = rng.random()
        piece = made(kind := KINDS[rng.integers(0, 4)]) if draw < 0.16 else other() if draw < 0.3 else word()
        if draw < 0.16:
            spans.append((kind, len(text), len(text) + len(piece)))
        text += piece + ("\n" if rng.random() < 0.08 else rng.choice([" ", " ", " ", ", ", ". "]))
    cut = int(rng.integers(0, max(1, len(text) - LENGTH + 1)))
    return text[cut : cut + LENGTH], [(k, s - cut, e - cut) for k, s, e in spans if s >= cut and e <= cut + LENGTH]


def labelled(samples: int, seed: int = 3) -> tuple[list[str], np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    texts, tags = [], np.zeros((samples, LENGTH), np.int64)
    for n in range(samples):
        text, spans = _sample(rng)
        texts.append(text)
        for kind, s, e in spans:
            tags[n, s] = TAGS.index(f"B-{kind}")
            tags[n, s + 1 : e] = TAGS.index(f"I-{kind}")
    return texts, np.stack([encode(t, LENGTH) for t in texts]), tags


@lru_cache(1)
def trained(samples: int = SAMPLES, steps: int = STEPS) -> Tagger:
    """The tagger, trained on `samples` labelled windows: the same in every run but for the last digits."""
    _, ids, tags = labelled(samples)
    model = Tagger()
    model.train(ids, tags, steps)
    return model


_MODELS: list[bytes] = []


def model_for(spark: SparkSession) -> Tagger:
    """The trained tagger. One task trains it, on one thread, once in a driver's life; the weights are some 40 KB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(trained().w)]})

    if not _MODELS:
        _MODELS.append(bytes(spark.range(1, numPartitions=1).mapInArrow(run, "model binary").first()[0]))
    model = Tagger()
    model.w = pickle.loads(_MODELS[0])
    return model


def plausible(kind: str, piece: str) -> bool:
    """What a tagged piece must hold to count: the tagger proposes, the form decides."""
    digits = re.sub("[^0-9]", "", piece)
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]{2,64} ?(@|\(at\)|\[at\]) ?[\w-]{2,}( ?(\.|\(dot\)|\[dot\]) ?[\w-]{2,})+", piece, re.I))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}( ?(\[\.\]|\.) ?[0-9]{1,3}){3}", piece)) and all(int(x) <= 255 for x in re.findall("[0-9]+", piece))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9]+([ ./-][0-9]+)*", piece))
    return 10 <= len(digits) <= 15 and bool(re.fullmatch(r"(00[0-9]{1,3} ?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}", piece))


def tag_texts(model: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans of each text. Windows overlap by half; their scores are averaged, the middle of a window counting most, and
    each stretch of windows, however long, is decoded as one, so that no span depends on where a window ends. Of a stretch
    only the best scores so far and a byte for each tag and place are held."""
    jobs: list[tuple[int, int]] = []
    for n, text in enumerate(texts):
        at, seen = TRIGGER.search(text), -1
        while at:
            last = at.start() // STRIDE  # the windows that hold this place start at (last - 1) and last strides
            for w in range(max(seen + 1, last - 1, 0), last + 1):
                jobs.append((n, w))
            seen = max(seen, last)
            at = TRIGGER.search(text, (last + 1) * STRIDE) if at.end() < (last + 1) * STRIDE else TRIGGER.search(text, at.end())
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(float)[:, None]
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    score, backs, start = None, [], 0
    held: tuple[np.ndarray, np.ndarray] | None = None  # what the last window adds to the next one's first half

    def add(n: int, w: int, em: np.ndarray) -> None:
        nonlocal score, held, start
        size = min(WINDOW, len(texts[n]) - w * STRIDE)
        total, mass = (em * weight)[:size], weight[:size].copy()
        if held is None:
            start = w * STRIDE
        else:
            total[: len(held[0])] += held[0]
            mass[: len(held[1])] += held[1]
        score, back = model.forward(total[:STRIDE] / mass[:STRIDE], score)
        backs.append(back)
        held = total[STRIDE:], mass[STRIDE:]

    def decode(n: int) -> None:
        nonlocal score, held
        score, back = model.forward(held[0] / held[1], score)
        path, k = model.trace(score, np.concatenate([*backs, back])), 0
        score, held = None, None
        backs.clear()
        while k < len(path):
            if path[k] % 2:
                stop = k + 1
                while stop < len(path) and path[stop] == path[k] + 1:
                    stop += 1
                kind, s, e = TAGS[path[k]][2:], start + k, start + stop
                if plausible(kind, texts[n][s:e]):
                    found[n].append((kind, s, e))
                k = stop
            else:
                k += 1

    last: tuple[int, int] | None = None
    for at in range(0, len(jobs), 256):
        part = jobs[at : at + 256]
        for (n, w), em in zip(part, model.emissions(np.stack([encode(texts[n][w * STRIDE : w * STRIDE + WINDOW], WINDOW) for n, w in part]))):
            if last and last != (n, w - 1):
                decode(last[0])
            add(n, w, em)
            last = n, w
    if last:
        decode(last[0])
    return found


def find(model: Tagger, texts: list[str]) -> list[tuple[dict[str, list[Span]], dict[str, list[Span]]]]:
    """For each text the base spans and the added ones, which overlap no base span."""
    out = []
    for text, tagged in zip(texts, tag_texts(model, texts)):
        base = base_spans(text)
        taken = sorted(s for spans in base.values() for s in spans)
        added: dict[str, list[Span]] = {k: [] for k in KINDS}
        for kind, s, e in tagged:
            if not any(a < e and s < b for a, b in taken):
                added[kind].append((s, e))
        out.append((base, added))
    return out


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal_data(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """Counts of the base spans of each kind, a digest of them, and all spans as kind:start:end (code points).

    Base spans come from fixed patterns. The tagger, a character-level bidirectional LSTM with CRF transitions, adds spans
    that overlap none of them and have a plausible form (disguised addresses, national phone numbers). Null and empty texts
    have no spans; whole texts are read; every row gives a row, repeated ones too; other columns are not read.
    """
    model = model or model_for(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = find(model, [t or "" for t in part.column(1).to_pylist()])
                whole = [joined({k: b[k] + a[k] for k in KINDS}) for b, a in found]
                counts = [pa.array([len(b[k]) for b, _ in found], pa.int64()) for k in KINDS]
                digests = pa.array([sha256(joined(b).encode()).hexdigest() for b, _ in found])
                more = pa.array([sum(map(len, a.values())) for _, a in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digests, pa.array(whole, pa.string()), more], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
