"""Quality rules by weak supervision, with DataFrame functions only.

Each rule looks at one statistic of a text and votes good, bad, or abstains between its two limits. A rule is right with
one probability on good and another on bad documents; expectation-maximisation over the counts of vote patterns (at most
3 to the number of rules, whatever the input) estimates these and the share of good documents without any label: rules
that agree with each other come out as right, and one that stands alone in its vote for bad counts for little. A
document is kept when the posterior probability of good is at least KEEP and the base test passes. The fit is over what
the base test leaves, all of it: the rest is decided already and would draw the bad class to its own kind.

A null text has no words; texts of any length are read whole. Texts without words get the votes of their statistics as
zero. Rows are independent and may repeat; extra columns are ignored (``keep`` keeps them). An empty table gives an empty
result. Nothing is shuffled but pattern counts; statistics are written once to the shared checkpoint folder, so that texts
are read once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, WORD, aside, documents, durable, let, n_of, words

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
#: Characters that are counted, by the statistic.
COUNTED = {"n_symbols": SYMBOLS, "n_capitals": CAPITALS, "n_bars": "|", "n_digits": "0123456789", "n_stops": ".,;:"}
KEEP = 0.5
#: Rule: statistic, good up to, bad from. A rule abstains between the two.
RULES = {
    "word_length": ("abs(word_chars / greatest(n_words, 1) - 6.0)", 3.5, 5.0),
    "symbols": ("n_symbols / greatest(n_words, 1)", 0.02, 0.08),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 0.05, 0.5),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 0.1, 0.3),
    "capitals": ("n_capitals / greatest(word_chars, 1)", 0.12, 0.25),
    "noise": ("(n_symbols + n_digits) / greatest(word_chars, 1)", 0.06, 0.12),
    "bars": ("n_bars / greatest(n_words, 1)", 0.02, 0.2),
    "stops": ("abs(n_stops / greatest(n_words, 1) - 0.15)", 0.1, 0.25),
}
#: Each rule starts as right with these probabilities on good and on bad documents, and is drawn back to them as by PULL
#: times all documents: enough to tell the classes apart by name, and to say what rules are worth that the data never test.
RIGHT, PULL, ROUNDS = (0.98, 0.3), 0.01, 60


def repeated(w: Column) -> Column:
    """Words of an array that stand in a window of three found twice or more in it."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def starts(s: Column) -> Column:
            same = lambda x, y: F.coalesce(F.get(s, y)["h"] == x["h"], F.lit(False))
            found = F.transform(s, lambda x, i: F.when(((i > 0) & same(x, i - 1)) | same(x, i + 1), x["at"]).otherwise(-1))
            return F.sort_array(F.filter(found, lambda at: at >= 0))

        begin = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda a, at: F.struct((a["n"] + F.least(F.lit(3), at - a["last"])).alias("n"), at.alias("last"))
        slow = F.aggregate(let(pairs, starts), begin, step, lambda a: a["n"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(slow)

    hashes = F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(hashes, covered))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics that the rules read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    blanks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + n_of(text, BLANKS[1:])
    counted = docs.withColumns(
        {
            "_words": let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), repeated(w).alias("repeats"))),
            "_lines": let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct"))),
        }
    )
    return counted.withColumns(
        {
            "n_words": F.col("_words.n").cast("long"),
            "word_chars": (F.length(text) - blanks).cast("long"),
            "n_dup_lines": (F.col("_lines.n") - F.col("_lines.distinct")).cast("long"),
            "n_repeat_words": F.col("_words.repeats").cast("long"),
            "n_lines": F.col("_lines.n").cast("long"),
            **{name: n_of(text, chars) for name, chars in COUNTED.items()},
        }
    ).drop("_words", "_lines")


def votes() -> list[Column]:
    """For each rule 1 (good), -1 (bad) or 0."""
    return [F.when(F.expr(x) <= good, 1).when(F.expr(x) >= bad, -1).otherwise(0).alias(f"vote_{k}") for k, (x, good, bad) in RULES.items()]


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[tuple[float, float]]]:
    """Share of good documents and each rule's accuracy on good and on bad ones, from counts of vote patterns."""
    total = sum(n for _, n in patterns) or 1
    share, right = 0.8, [RIGHT] * len(RULES)
    for _ in range(ROUNDS):
        good_of = [(v, n, posterior(share, right, v)) for v, n in patterns]
        share = min(0.99, max(0.01, math.fsum(n * g for _, n, g in good_of) / total)) if patterns else share
        found = []
        for j in range(len(RULES)):
            good = [(n * g, v[j] > 0) for v, n, g in good_of if v[j]]
            bad = [(n * (1 - g), v[j] < 0) for v, n, g in good_of if v[j]]
            fit = [(math.fsum(w for w, ok in x if ok) + PULL * total * r) / (math.fsum(w for w, _ in x) + PULL * total) for x, r in zip((good, bad), RIGHT, strict=True)]
            # a vote for bad never speaks for good: without this, the two classes could change places
            found.append((min(max(fit[0], 1.001 - fit[1]), 1 - 1e-6), min(max(fit[1], 1e-3), 1 - 1e-6)))
        right = found
    return share, right


def posterior(share: float, right: list[tuple[float, float]], v: tuple[int, ...]) -> float:
    good, bad = math.log(share), math.log(1 - share)
    for (a, b), x in zip(right, v, strict=True):
        if x:
            good += math.log(a if x > 0 else 1 - a)
            bad += math.log(b if x < 0 else 1 - b)
    return 1 / (1 + math.exp(min(700.0, bad - good)))


def posterior_column(share: float, right: list[tuple[float, float]]) -> Column:
    odds = F.lit(math.log(share / (1 - share)))
    for (a, b), k in zip(right, RULES, strict=True):
        v = F.col(f"vote_{k}")
        odds = odds + F.when(v > 0, math.log(a / (1 - b))).when(v < 0, math.log((1 - a) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Statistics, votes, base verdict, posterior ``quality`` and ``kept`` of every row, with the columns in ``carry``.

    The statistics are written with ``carry`` once, since both the fit and the verdict read them.
    """
    counted = statistics(docs)
    voted = counted.select(*[F.col(c) for c in dict.fromkeys([*carry, *counted.columns[len(docs.columns) :]])]).select("*", *votes())
    voted = durable(voted)
    names = [f"vote_{k}" for k in RULES]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.filter(~failed).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()]
    share, right = estimate(sorted(patterns))
    return voted.withColumn("base_failed", failed).withColumn("quality", posterior_column(share, right)).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))


def keep(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the rules keep, with their own columns."""
    moved, back = aside(docs)
    moved = moved.withColumn("text", F.col(f"_d{docs.columns.index('text')}"))
    names = [c for c in moved.columns if c != "text"]
    return judge(moved, names).filter("kept").select(*back)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 9).alias("quality"))
