"""Quality rules by weak supervision: rules vote good, bad or abstain, expectation-maximisation estimates how each rule votes
on good and on bad documents, and the posterior probability of quality replaces all-must-pass filtering.

DataFrame functions only. The corpus is reduced to counts of vote patterns (at most 3 ** rules rows), on which each round of
expectation-maximisation is one aggregation; the fitted weights are a handful of numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlytics.llm.common import WORD_SPLIT, set_aside, staged

RULES = ("symbols", "capitals", "repeats", "stutter", "word_length", "lines", "length", "letters")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_chars_", "n_stutter", "n_lines", "n_bare")
WINDOW = 8
ROUNDS = 15
#: Where expectation-maximisation starts: share of good documents; chances that a rule votes bad, abstains, votes good.
START_GOOD = 0.85
START_ON_GOOD = (0.005, 0.195, 0.8)
START_ON_BAD = (0.3, 0.3, 0.4)
SYMBOLS = "#*$%&|<>"
#: A word without any letter or digit.
BARE_WORD = r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])"


@dataclass(frozen=True)
class LabelModel:
    """Log-odds of quality: offset plus one weight for each rule and vote (bad, abstain, good)."""

    offset: float
    weights: tuple[float, ...]

    def posterior(self, votes: list[Column]) -> Column:
        first = [self.offset + w for w in self.weights[:3]]  # all numbers in one array: every round compiles to the same code
        table = F.lit([*first, *self.weights[3:]])
        odds = F.get(table, votes[0] + 1)
        for k, vote in enumerate(votes[1:], 1):
            odds = odds + F.get(table, vote + F.lit(3 * k + 1))
        return 1 / (1 + F.exp(-odds))


def start_model() -> LabelModel:
    weights = [math.log(g / b) for g, b in zip(START_ON_GOOD, START_ON_BAD, strict=True)]
    return LabelModel(math.log(START_GOOD / (1 - START_GOOD)), tuple(weights * len(RULES)))


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_word_count(windows: Column) -> Column:
    """Words covered by windows whose hash occurs at least twice: equal hashes are neighbours once sorted, and a window
    adds the words up to the next repeated window, at most its own length."""

    def covered(ordered: Column) -> Column:
        places = F.array_sort(
            F.filter(
                F.transform(
                    ordered,
                    lambda s, k: F.when(
                        (s["h"] == F.get(ordered, k - 1)["h"]) | (s["h"] == F.get(ordered, k + 1)["h"]), s["at"]
                    ),
                ),
                lambda at: at.isNotNull(),
            )
        )
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda at, k: F.coalesce(F.least(F.lit(WINDOW), F.get(p, k + 1) - at), F.lit(WINDOW))),
                F.lit(0).cast("long"),
                lambda total, n: total + n,
            ),
        )

    ordered = F.array_sort(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(ordered, covered))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts that the rules read. Null texts count like empty ones; a 64-bit hash stands for a window."""
    text = F.coalesce(docs[text_col], F.lit(""))
    has_word = lambda line: line.rlike("[^\\x20\\x09-\\x0D]")
    df = docs.withColumns(
        {
            "__hashes": F.transform(F.filter(F.split(text, WORD_SPLIT), lambda w: w != ""), lambda w: F.xxhash64(w)),
            "__lines": F.filter(F.split(text, "\n"), has_word),
            "__row": F.monotonically_increasing_id(),  # keeps filters above from being pushed below, where they would be computed twice
            "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
            "n_bare": F.regexp_count(text, F.lit(BARE_WORD)).cast("long"),
            "n_chars_": F.length(text).cast("long"),
        }
    )
    hashes = F.col("__hashes")
    windows = F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))),
        lambda h, k: F.xxhash64(h, *[F.get(hashes, k + j) for j in range(1, WINDOW)]),
    )
    df = df.withColumns(
        {
            "__windows": windows,
            "n_words": F.size(hashes).cast("long"),
            "n_stutter": F.size(F.filter(hashes, lambda h, k: h == F.get(hashes, k - 1))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__row": F.col("__row") + F.monotonically_increasing_id() * 0,
        }
    )
    return df.withColumn("n_repeat_words", repeated_word_count(F.col("__windows"))).drop("__hashes", "__lines", "__windows")


def votes() -> list[Column]:
    """-1 bad, 0 abstain, 1 good, in the order of RULES; whole-number comparisons, so no rounding decides."""
    n, c = F.col("n_words"), F.col

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return [
        vote(5 * c("n_symbols") > n, 50 * c("n_symbols") < n),
        vote(10 * c("n_capitals") > 3 * c("n_chars_"), 10 * c("n_capitals") < c("n_chars_")),
        vote(10 * c("n_repeat_words") > 3 * n, 10 * c("n_repeat_words") < n),
        vote(5 * c("n_stutter") > n, 20 * c("n_stutter") < n),
        vote((n >= 20) & ((2 * c("word_chars") > 13 * n) | (c("word_chars") < 3 * n)), (n >= 20) & (c("word_chars") >= 4 * n) & (2 * c("word_chars") <= 11 * n)),
        vote(2 * c("n_dup_lines") > c("n_lines"), (n > 0) & (50 * c("n_dup_lines") < c("n_lines"))),
        vote(n < 20, n >= 50),
        vote(10 * c("n_bare") > n, 50 * c("n_bare") < n),
    ]


def fit(counts: DataFrame, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation from counts of all documents. Vote chances are smoothed by (count + 0.5) / (all + 1.5);
    without documents the start model stays."""
    columns = [f"v{k}" for k in range(len(RULES))]
    patterns = staged(
        counts.select(*[v.cast("int").alias(c) for v, c in zip(votes(), columns, strict=True)])
        .groupBy(*columns)
        .agg(F.count(F.lit(1)).cast("double").alias("n")),
        "patterns",
    )  # at most 3 ** 8 rows, whatever the corpus
    model = start_model()
    for _ in range(rounds):
        scored = patterns.withColumn("good", model.posterior([F.col(c) for c in columns]))
        sums = [F.sum("n"), F.sum(F.col("n") * F.col("good"))]
        for c in columns:
            for v in (-1, 0, 1):
                here = F.when(F.col(c) == v, F.col("n")).otherwise(0.0)
                sums += [F.sum(here), F.sum(here * F.col("good"))]
        total, good, *rest = scored.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()
        if not total:
            break
        bad = total - good
        weights = [
            math.log((on_good + 0.5) / (good + 1.5)) - math.log((both - on_good + 0.5) / (bad + 1.5))
            for both, on_good in zip(rest[::2], rest[1::2], strict=True)
        ]
        model = LabelModel(math.log((good + 0.5) / (bad + 0.5)), tuple(weights))
    return model


def score(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """docs with counts, base_failed and the posterior quality of each document, after fitting on all of them.

    Input columns named like an added one come back as <name>_in. Null and empty texts have no words: they fail the base
    rules. Ties at a posterior of exactly one half count as good. Repeated rows get equal verdicts; an empty table
    returns no rows.
    """
    docs = set_aside(docs, (*COUNTS, "base_failed", "quality_posterior", "kept"))
    text_col = text_col if text_col in docs.columns else f"{text_col}_in"
    counted = with_counts(docs, text_col)
    model = fit(counted.select(*COUNTS), rounds)
    return judge(counted, model)


def judge(counted: DataFrame, model: LabelModel) -> DataFrame:
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumns({"base_failed": base_failed, "quality_posterior": model.posterior(votes())})


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: the counts, base_failed and kept (not base_failed, and a posterior of at least one half).
    The counts are written once; fitting and judging read them, not the texts."""
    counted = with_counts(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")))
    counted = staged(counted.select("doc_id", *COUNTS), "counts")
    judged = judge(counted, fit(counted, rounds))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality_posterior") >= 0.5))


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose posterior quality reaches the threshold, with their own columns only.

    Texts are counted in two passes, to fit and to judge: writing them out beside their votes would cost the input's size on
    disk. Null and empty texts have no words and count as bad; repeated rows stay or go together; an empty table gives no
    rows."""
    columns = docs.columns
    inside = docs.select(*[docs[c].alias(f"__c{k}") for k, c in enumerate(columns)])
    counted = with_counts(inside, f"__c{columns.index(text_col)}")
    model = fit(counted.select(*COUNTS))
    good = judge(counted, model).where((F.col("quality_posterior") >= threshold) & (F.col("__row") >= 0))
    return good.select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(columns)])
