"""Learned decision lists over text statistics, as ordered Spark conditional expressions.

Statistics, learning and verdict use DataFrame functions only. Rules are found by sequential covering: a rule grows
by the threshold condition of most information gain on two thirds of the labelled rows, is pruned on the other
third, and what it covers is set aside. Spark counts; the driver sees counts by statistic, interval and label.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.shared import stored

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Words of a window, and windows found twice that count as repeats.
REPEAT_WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, with `value` worked out once for a row however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def count_of(text: Column, pattern: str) -> Column:
    return F.size(F.split(text, pattern, -1)) - 1


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_BREAK, -1), "")


def repeat_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words that lie in a window of words found twice or more in the text; windows are compared by 64-bit hash."""
    def marked(sorted_: Column) -> Column:
        """Places of the windows whose hash stands beside an equal one in hash order."""
        def place(x: Column, i: Column) -> Column:
            same = (x["h"] == F.get(sorted_, i - 1)["h"]) | (x["h"] == F.get(sorted_, i + 1)["h"])
            return F.when(F.coalesce(same, F.lit(False)), x["i"])
        return F.sort_array(F.array_compact(F.transform(sorted_, place)))

    def covered(places: Column) -> Column:
        """Each window covers up to the next one, at most its own words."""
        own = F.transform(places, lambda x, i: F.least(F.coalesce(F.get(places, i + 1) - x, F.lit(window)), F.lit(window)))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

    def of(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes), let(by_hash, lambda s: let(marked(s), covered))
        ).otherwise(0)

    def windows(each: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(each) - window), lambda i: F.xxhash64(*(F.get(each, i + k) for k in range(window))))

    enough = F.size(words) >= window
    return F.when(enough, let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), of)).otherwise(0).cast("long")


#: The statistics that rules may test, by name; all are numbers that do not grow with the length of a text.
FEATURES = (
    "symbols_per_word", "capitals_per_char", "exclamations_per_word", "marks_per_word", "digits_per_word",
    "chars_per_word", "words_per_line", "duplicate_line_share", "repeat_word_share", "distinct_word_share",
)


def with_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`row` (a struct of the columns `keep`), doc_id and the statistics of every text; a null text has no words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    first = docs.select(
        F.struct(*(F.col(f"`{x}`") for x in keep)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"), words_of(text).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0).alias("lines"),
    )
    counts = first.select(
        "row", "doc_id", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"), F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        count_of(F.col("text"), "[A-Z]").alias("n_capitals"), count_of(F.col("text"), "[!?]").alias("n_exclamations"),
        count_of(F.col("text"), "[.,;:]").alias("n_marks"), count_of(F.col("text"), "[0-9]").alias("n_digits"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    ratios = {
        "symbols_per_word": F.col("n_symbols") / n, "exclamations_per_word": F.col("n_exclamations") / n,
        "capitals_per_char": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "marks_per_word": F.col("n_marks") / n, "digits_per_word": F.col("n_digits") / n,
        "chars_per_word": F.col("word_chars") / n, "words_per_line": F.col("n_words") / lines,
        "duplicate_line_share": F.col("n_dup_lines") / lines, "repeat_word_share": F.col("n_repeat_words") / n,
        "distinct_word_share": F.col("n_distinct") / n,
    }
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counts.select("row", "doc_id", *base, *(ratios[x].alias(x) for x in FEATURES), failed.alias("base_failed"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= self.threshold if self.at_least else value < self.threshold


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def decision(rules: list[Rule]) -> Column:
    """Number of the first rule that holds (from 1), else 0: one ordered conditional expression."""
    if not rules:
        return F.lit(0)
    out = F.when(holds(rules[0]), 1)
    for number, rule in enumerate(rules[1:], 2):
        out = out.when(holds(rule), number)
    return out.otherwise(0)


def _gain(covered: int, wrong: int, of: int, of_wrong: int) -> float:
    if not covered:
        return 0.0
    return covered * (math.log2(covered / (covered + wrong)) - math.log2(of / (of + of_wrong)))


def _interval(value: Column, thresholds: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= value))


def learn_rules(
    labelled: DataFrame, most_rules: int = 12, most_conditions: int = 3, steps: int = 16, precision: float = 0.9,
    least: int = 5,
) -> list[Rule]:
    """Ordered rules for the rows with `bad` true, from a stored table of FEATURES, `bad` and `prune` (booleans).

    Thresholds are quantiles, `steps` of either label. A rule is taken if on the pruning rows at least `precision`
    of what it covers is bad, and so on the growing rows, where it covers `least` bad rows or more; learning ends
    with the first rule that is not. No labelled rows of either kind: no rules.
    """
    quantiles = [i / (steps - 1) for i in range(steps)]
    grow = labelled.where(~F.col("prune"))
    found = grow.groupBy("bad").agg(
        F.count("*").alias("n"), *(F.percentile_approx(x, quantiles, 2000).alias(x) for x in FEATURES)).collect()
    if len(found) < 2:
        return []
    thresholds = {x: sorted({t for r in found for t in r[x]}) for x in FEATURES}
    # The interval of each statistic: how many of its thresholds are at or below it.
    bins = labelled.select("bad", "prune", *FEATURES, F.array(*(
        _interval(F.col(x), thresholds[x]) for x in FEATURES)).alias("bins"))
    bins = stored(bins, "rule-bins")
    rules: list[Rule] = []
    while len(rules) < most_rules:
        left = bins.where(decision(rules) == 0)
        rule: Rule = ()
        while len(rule) < most_conditions:
            counts = (
                left.where(~F.col("prune") & holds(rule)).select("bad", F.posexplode("bins").alias("feature", "bin"))
                .groupBy("feature", "bin").agg(F.sum(F.col("bad").cast("int")).alias("bad"), F.count("*").alias("n")).collect())
            best = _best_condition([(r["feature"], r["bin"], r["bad"], r["n"] - r["bad"]) for r in counts], thresholds, least)
            if best is None:
                break
            rule = (*rule, best)
        if not rule:
            break
        rule = _pruned(left, rule, precision, least)
        if not rule:
            break
        rules.append(rule)
    return rules


def _best_condition(counts: list[tuple], thresholds: dict[str, list[float]], least: int) -> Condition | None:
    """The condition of most gain that covers `least` bad rows; none if every row is bad already or nothing gains."""
    best, best_gain = None, 1e-9
    for f, name in enumerate(FEATURES):
        own = [x for x in counts if x[0] == f]
        bad, good = sum(x[2] for x in own), sum(x[3] for x in own)
        if not bad or not good:
            return best
        for i, threshold in enumerate(thresholds[name]):
            above = [x for x in own if x[1] > i]
            b, g = sum(x[2] for x in above), sum(x[3] for x in above)
            for at_least, cb, cg in ((True, b, g), (False, bad - b, good - g)):
                gain = _gain(cb, cg, bad, good) if cb >= least else 0.0
                if gain > best_gain:
                    best, best_gain = Condition(name, at_least, threshold), gain
    return best


def _pruned(left: DataFrame, rule: Rule, precision: float, least: int) -> Rule:
    """The start of the rule that does best on the pruning rows, or () if none is precise enough there."""
    starts = [rule[:k] for k in range(1, len(rule) + 1)]
    sums = []
    for k, start in enumerate(starts):
        for name, rows in (("p", F.col("prune")), ("g", ~F.col("prune"))):
            for label, want in (("bad", F.col("bad")), ("good", ~F.col("bad"))):
                sums.append(F.count_if(rows & want & holds(start)).alias(f"{name}{label}{k}"))
    r = left.agg(*sums).first()
    best, value = (), 0.0
    for k, start in enumerate(starts):
        bad, good = r[f"pbad{k}"], r[f"pgood{k}"]
        grown = r[f"gbad{k}"] / max(1, r[f"gbad{k}"] + r[f"ggood{k}"])
        if bad and r[f"gbad{k}"] >= least and bad / (bad + good) >= precision and grown >= precision:
            if (bad - good) > value:
                best, value = start, bad - good
    return best


def labelled_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of documents with a label (doc_id, quality), but for those the base conditions reject anyway.

    A document is bad if any of its labels is 0. A third, by hash of doc_id, is for pruning.
    """
    bad = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.min(F.col("quality").cast("int")) == 0).alias("bad"))
    return stats.where("not base_failed").join(bad, "doc_id").select(
        *FEATURES, "bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"))


def judge(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, **learning: float) -> DataFrame:
    """Every row of `docs` (as struct `row`, its columns `keep`) with statistics, `rule` and `kept`.

    The statistics are stored once; learning and verdict read them back. `rule` is the number of the first rule
    that holds, 0 if none. Repeated rows and ties get equal verdicts; an empty table gives an empty result.
    """
    stats = stored(with_stats(docs, keep or docs.columns), "quality-stats")
    rules = learn_rules(stored(labelled_rows(stats, labels), "quality-labelled"), **learning)
    return stats.withColumn("rule", decision(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_by_rules(docs: DataFrame, labels: DataFrame, **learning: float) -> DataFrame:
    """The rows of `docs`, all their columns, that neither base conditions nor learned rules reject."""
    return judge(docs, labels, **learning).where("kept").select("row.*")
