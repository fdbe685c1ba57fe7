"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them. Spark SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

#: name: (measure, good if at most / at least, bad if beyond); a vote is 1 good, 0 bad, -1 abstain.
RULES = {
    "length": ("n_words", "least", 100, 50),
    "symbols": ("n_symbols / greatest(word_chars, 1)", "most", 0.01, 0.05),
    "word_length": ("word_chars / greatest(n_words, 1)", "most", 9.0, 12.0),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", "most", 0.1, 0.3),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", "most", 0.1, 0.3),
    "capitals": ("n_upper / greatest(word_chars, 1)", "most", 0.15, 0.4),
    "exclaims": ("n_exclaims / greatest(n_words, 1)", "most", 0.05, 0.3),
    "letters": ("n_letters / greatest(word_chars, 1)", "least", 0.9, 0.8),
    "bare_symbols": ("n_bare / greatest(n_words, 1)", "most", 0.02, 0.1),
    "variety": ("n_distinct / greatest(n_words, 1)", "least", 0.3, 0.15),
}

#: Words of a block in which distinct words are counted: in a whole text their share would fall with its length.
BLOCK = 400


def measures(docs: DataFrame) -> DataFrame:
    """Counts over every whole text; a null text has no words. All times are linear or n log n in the words of a text.

    n_distinct adds up the distinct words of each block of BLOCK words, so n_distinct / n_words is the mean variety of the
    blocks, weighed by their words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("*", F.filter(F.split(text, SPACE), lambda w: w != "").alias("_words"), F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0).alias("_lines"))
    base = base.withColumn("_n", F.size("_words"))
    base = base.withColumn("_w3", F.when(F.col("_n") >= 3, F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    again = F.size(F.array_distinct("_w3")) < F.size("_w3")
    base = base.withColumn("_sorted", F.when(again, F.array_sort(F.transform("_w3", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    repeated = F.filter("_sorted", lambda x, k: (F.get("_sorted", k - 1).h == x.h) | (F.get("_sorted", k + 1).h == x.h))
    base = base.withColumn("_at", F.when(F.col("_sorted").isNotNull(), F.array_sort(F.transform(repeated, lambda x: x.i))))
    covered = F.aggregate("_at", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda s, i: F.struct(i.alias("last"), (s.n + F.least(F.lit(3), i - s.last)).alias("n"))).n
    count = lambda c: c.cast("long")
    less = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    return base.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        count(F.col("_n")).alias("n_words"),
        count(F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
        count(less(SYMBOLS)).alias("n_symbols"),
        count(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        count(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"),
        count(F.size("_lines")).alias("n_lines"),
        count(F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}+", ""))).alias("n_upper"),
        count(less("!")).alias("n_exclaims"),
        count(F.length(text) - F.length(F.regexp_replace(text, "\\p{L}+", ""))).alias("n_letters"),
        count(F.size(F.filter("_words", lambda w: ~w.rlike("[\\p{L}\\p{N}]")))).alias("n_bare"),
        count(F.aggregate(F.sequence(F.lit(0), F.greatest(F.floor((F.col("_n") - 1) / BLOCK), F.lit(0)).cast("int")), F.lit(0), lambda n, k: n + F.size(F.array_distinct(F.slice("_words", k * BLOCK + 1, BLOCK))))).alias("n_distinct"),
    )


def vote(name: str) -> F.Column:
    measure, kind, good, bad = RULES[name]
    x = F.expr(measure)
    return F.when(x <= good if kind == "most" else x >= good, 1).when(x > bad if kind == "most" else x < bad, 0).otherwise(-1).cast("int")


#: Prior knowledge of rules, as shares of all texts that count for it: a rule votes against one good text in a hundred at
#: most, and against a bad text, of which there are many kinds, more often. Without the bound, bad votes that hardly agree
#: would be explained as false alarms.
FALSE_ALARM, HITS = (0.01, 0.2), (0.3, 0.02)


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[tuple[float, float]]]:
    """EM over vote patterns with their counts: the share of good texts, and per rule how often it votes against a bad and a
    good text, where it votes. Accuracies are learned from where rules agree; abstentions say nothing.

    It starts from: a text is good if no rule votes against it.
    """
    rules = len(next(iter(patterns), ((),))[0])
    mass = sum(n for _, n in patterns) or 1
    good = [0.05 if 0 in p else 0.95 for p, _ in patterns]
    prior, table = 0.5, [(0.5, 0.5)] * rules
    for _ in range(rounds):
        prior = min(max((sum(q * n for q, (_, n) in zip(good, patterns)) + 1) / (mass + 2), 1e-6), 1 - 1e-6)
        for r in range(rules):
            cast = [(q, n, p[r] == 0) for q, (p, n) in zip(good, patterns) if p[r] != -1]
            rate = lambda of, known: (sum(of(q) * n for q, n, no in cast if no) + known[0] * known[1] * mass) / (sum(of(q) * n for q, n, _ in cast) + known[1] * mass)
            on_good = min(rate(lambda q: q, FALSE_ALARM), FALSE_ALARM[0])
            table[r] = (max(rate(lambda q: 1 - q, HITS), on_good), on_good)
        good = [1 / (1 + math.exp(min(700, max(-700, -_odds(p, prior, table))))) for p, _ in patterns]
    return prior, table


def _weights(rule: tuple[float, float]) -> dict[int, float]:
    """What a vote adds to the log odds of quality."""
    bad, good = rule
    return {0: math.log(good / bad), 1: math.log((1 - good) / (1 - bad)), -1: 0.0}


def _odds(pattern: tuple[int, ...], prior: float, table: list[tuple[float, float]]) -> float:
    return math.log(prior / (1 - prior)) + sum(_weights(t)[v] for t, v in zip(table, pattern))


def judge(docs: DataFrame, threshold: float = 0.5, measured: DataFrame | None = None) -> DataFrame:
    """docs with the measures, base_failed, p_good (posterior probability of quality) and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated windows. kept: not base_failed and p_good at
    least the threshold. Only counts of vote patterns (at most 3 to the number of rules) reach the driver. Null and empty
    texts fail the base; very long texts are measured whole; repeated rows get the same verdict; an empty table gives no rows. Input columns that clash with
    a measure are replaced.
    """
    own = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims", "n_letters", "n_bare", "n_distinct", "base_failed", "p_good", "kept"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own and not c.startswith("_v_")])
    seen = measured if measured is not None else measures(docs)
    votes = seen.select("*", *[vote(k).alias(f"_v_{k}") for k in RULES])
    counts = votes.groupBy(*[f"_v_{k}" for k in RULES]).count().collect()
    prior, table = fit(sorted((tuple(r[:-1]), r[-1]) for r in counts))
    odds = F.lit(math.log(prior / (1 - prior)))
    for k, t in zip(RULES, table):
        w = _weights(t)
        odds = odds + F.when(F.col(f"_v_{k}") == 1, w[1]).when(F.col(f"_v_{k}") == 0, w[0]).otherwise(w[-1])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = votes.withColumn("base_failed", failed).withColumn("p_good", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)).drop(*[f"_v_{k}" for k in RULES])


def filter_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that judge() keeps, with the columns they came with, whatever their names. Null, empty and very short
    texts go, very long ones are judged whole, repeated rows share their fate, and an empty table stays empty."""
    from docloom.llm.common import stored

    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").cast("string").alias("text"))
    seen = stored(measures(held).drop("text"), "quality")
    return judge(held, threshold, seen).filter("kept").select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
