"""The stages of the corpus pipeline in plain Python, over lists of rows: written for clarity, and slow."""

import math
import re
from collections import Counter
from hashlib import md5

from docloom.llm import decontam, quality

WORD = r"[^\x20\x09-\x0D]+"


def measured(text):
    t = text or ""
    w = re.findall(WORD, t)
    grams = Counter(zip(w, w[1:], w[2:]))
    cover = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    names = dict(n_words=len(w), word_chars=sum(map(len, w)), n_symbols=sum(c in "#*$%&|<>" for c in t), n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(cover), n_lines=len(lines), n_exclaims=t.count("!"))
    import regex

    names |= dict(n_upper=len(regex.findall(r"\p{Lu}", t)), n_letters=len(regex.findall(r"\p{L}", t)), n_bare=sum(not regex.search(r"[\p{L}\p{N}]", x) for x in w))
    return names | dict(n_distinct=sum(len(set(w[k : k + 400])) for k in range(0, len(w), 400)))


def votes(m):
    out = []
    for measure, kind, good, bad in quality.RULES.values():
        x = eval(measure.replace("greatest", "max"), {"max": max}, m)  # the measures are fixed texts of the library
        out.append(1 if (x <= good if kind == "most" else x >= good) else 0 if (x > bad if kind == "most" else x < bad) else -1)
    return out


def posterior(rows):
    """Expectation-maximisation over documents, one by one: the probability that each is good."""
    cast, n = [votes(m) for m in rows], len(rows)
    good = [0.05 if 0 in v else 0.95 for v in cast]
    for _ in range(50):
        share = (sum(good) + 1) / (n + 2)
        rates = []
        for r in range(len(quality.RULES)):
            used = [k for k in range(n) if cast[k][r] != -1]
            on_good = (sum(good[k] for k in used if cast[k][r] == 0) + 0.01 * 0.2 * n) / (sum(good[k] for k in used) + 0.2 * n)
            on_bad = (sum(1 - good[k] for k in used if cast[k][r] == 0) + 0.3 * 0.02 * n) / (sum(1 - good[k] for k in used) + 0.02 * n)
            on_good = min(on_good, 0.01)
            rates.append((max(on_bad, on_good), on_good))
        new = []
        for v in cast:
            odds = math.log(share / (1 - share))
            for x, (b, g) in zip(v, rates):
                odds += math.log(g / b) if x == 0 else math.log((1 - g) / (1 - b)) if x == 1 else 0
            new.append(1 / (1 + math.exp(-odds)))
        good = new
    return good


def good_documents(docs):
    rows = [measured(d["text"]) for d in docs]
    keep = [p >= 0.5 and m["n_words"] >= 50 and 100 * m["n_repeat_words"] <= 50 * m["n_words"] for p, m in zip(posterior(rows), rows)]
    return [d for d, k in zip(docs, keep) if k]


def shingled(text, size=5):
    w = re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def without_near_copies(docs, similarity=0.8):
    kept = []
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        s = shingled(d["text"])
        if not any((len(s & o) >= similarity * len(s | o)) for _, o in kept):
            kept.append((d, s))
    return [d for d, _ in kept]


def tokens_of(text):
    """(form, value, kind) of each word: what the template shows, the plain word, and its kind."""
    out, begins = [], True
    for line in [text or ""]:
        for raw in line.split():
            plain = raw.strip(decontam.PUNCTUATION) or raw
            low = plain.lower()
            if low in decontam.NUMBERS or any(c.isdigit() for c in low):
                kind = "number"
            elif low in decontam.UNITS:
                kind = "unit"
            elif plain[:1].isupper() and not begins:
                kind = "name"
            else:
                kind = ""
            out.append((f"<{kind}>" if kind else low, low, kind, plain[:1].isupper() and begins and kind == ""))
            begins = raw.rstrip("\"')]”’»")[-1:] in (".", "!", "?", ":")
    return out


def keyed(tokens, width):
    """Windows by what they must share with others: their template, or, with few plain words, their words."""
    out = {}
    for k in range(len(tokens) - width + 1):
        w = tokens[k : k + width]
        if sum(not x[2] for x in w) >= min(3, width):
            out.setdefault(("template", *[x[0] for x in w]), []).append(k)
        if sum(not x[2] and not x[3] for x in w) < min(3, width):
            out.setdefault(("words", *[x[1] for x in w]), []).append(k)
    return out


def holds(doc, found, item, share=0.5):
    """Does a document hold an item's template? doc, item: tokens_of(); found: keyed() of the document for the item's width."""
    width, shifts = min(8, len(item)), {}
    for key, places in keyed(item, width).items():
        for k in places:
            for at in found.get(key, ()):
                shifts.setdefault(at - k, []).append((k, at, key[0] == "template"))
    covered = set()
    for matches in shifts.values():
        pairs = {(x[1], y[1]) for k, at, typed in matches if typed for x, y in zip(item[k : k + width], doc[at : at + width]) if x[2]}
        if len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs):
            covered |= {k + j for k, _, _ in matches for j in range(width)}
    return len(covered) >= share * len(item)


def without_benchmark(docs, bench):
    items, kept = [i for i in map(tokens_of, bench) if len(i) >= 5], []
    for d in docs:
        t = tokens_of(d["text"])
        found = {w: keyed(t, w) for w in {min(8, len(i)) for i in items}}
        if not any(holds(t, found[min(8, len(i))], i) for i in items):
            kept.append(d)
    return kept


def mixed(docs, weights, other=1.0, seed=42):
    counts = Counter(d["source"] or "" for d in docs)
    total = sum(weights.get(s, other) for s in counts)
    out = Counter()
    for d in docs:
        s = d["source"] or ""
        rate = weights.get(s, other) / total * len(docs) / counts[s]
        u = int(md5(f"{seed}:{d['doc_id']}:1".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate)
        k = 0
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        out[d["doc_id"], d["text"]] += k
    return +out
