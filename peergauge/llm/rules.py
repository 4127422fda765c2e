"""Quality rules with cutoffs that labelled documents justify; DataFrame functions only.

Every rule is a ratio that is high in bad text. A cutoff of a rule rejects documents above it. Which
cutoff is used follows from labelled documents, per stratum (such as the language): a cutoff is
certified if the good documents it rejects are so few that, were its true false-rejection rate
``alpha / rules`` or more, so few would be seen with a probability of at most ``delta`` divided by the
number of all tests (exact binomial, Bonferroni). So with probability ``1 - delta`` the rules together
reject at most the share ``alpha`` of the good documents of every stratum. Of the certified cutoffs that
reject more bad than good documents the one with the largest surplus is taken, and the loosest of
several. A stratum with too few labels gets no cutoff, and nothing of it is rejected by that rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peergauge.llm.common import whole_text
from peergauge.session import write_shared

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
UPPER = r"\p{Lu}"
# Cutoffs tried for each rule, fixed before any label is seen.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 1.0),
    "marks_per_word": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 1.0),
    "upper_share": (0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6),
    "duplicate_lines": (0.1, 0.2, 0.3, 0.35, 0.4, 0.5, 0.6, 0.8),
    "repeated_words": (0.1, 0.2, 0.3, 0.35, 0.4, 0.45, 0.5, 0.8),
}
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice."""
    windows = F.when(
        F.size(words) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        """Words under three-word windows that begin at these sorted places."""
        gaps = F.transform(
            starts,
            lambda at, k: F.when(
                k < F.size(starts) - 1, F.least(F.lit(3), F.get(starts, k + 1) - at)
            ).otherwise(3),
        )
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def repeats(ordered: Column) -> Column:
        """From (hash, place) in order: the places whose hash a neighbour shares."""
        again = F.filter(
            ordered,
            lambda e, k: (F.get(ordered, k - 1)["h"] == e["h"])
            | (F.get(ordered, k + 1)["h"] == e["h"]),
        )
        return F.sort_array(F.transform(again, lambda e: e["i"]))

    def count(hashes: Column) -> Column:
        # Only texts with some repeat pay for the sort.
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), F.lit(0)).otherwise(
            _let(_let(F.sort_array(pairs), repeats), covered)
        )

    return _let(windows, count)


def count_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with their counts: n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_marks and n_upper. A null text has no words; columns so named are replaced.

    Write the result before filtering by a count: Spark would move the filter below the counting and
    compute the words anew for each of them.
    """
    whole = whole_text(text)
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.withColumns(
        {"_words": F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), "_lines": lines}
    )
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOL)),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeated(F.col("_words")),
        "n_marks": F.length(whole) - F.length(F.replace(whole, F.lit("!"), F.lit(""))),
        "n_upper": F.regexp_count(whole, F.lit(UPPER)),
    }
    counted = split.withColumns({name: c.cast("long") for name, c in counts.items()})
    return counted.drop("_words", "_lines")


def _ratios() -> dict[str, Column]:
    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "marks_per_word": share("n_marks", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "duplicate_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )


def binomial_log_tail(seen: Column, n: Column, rate: float) -> Column:
    """log P(X <= seen) for X ~ Bin(n, rate); 0 where ``seen`` is not below the mean.

    Terms are added in log space, so that no size of n underflows.
    """
    odds = rate / (1 - rate)
    first = n * F.log1p(F.lit(-rate))
    start = F.struct(first.alias("term"), first.alias("total"))

    def add(state: Column, j: Column) -> Column:
        term = state["term"] + F.log((n - j + 1) / j * odds)
        high, low = F.greatest(term, state["total"]), F.least(term, state["total"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(seen > 0, F.sequence(F.lit(1), F.greatest(seen, F.lit(1)).cast("int")))
    steps = F.coalesce(steps, F.array().cast("array<int>"))
    summed = F.aggregate(steps, start, add, lambda state: state["total"])
    return F.when(seen < n * rate, summed).otherwise(0.0)


def fit_cutoffs(
    counted: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    alpha: float = 0.05,
    delta: float = 0.05,
) -> DataFrame:
    """One row per stratum: ``_stratum`` and a cutoff per rule, null where none is certified.

    ``labels`` has doc_id and quality (1 good, 0 bad); null labels are not used, and a document
    labelled both ways counts as good. A null stratum is a stratum. The result has a row per
    stratum that has labels, and none without labels.
    """
    judged = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy(F.col("doc_id").alias("_labelled"))
        .agg(F.max("quality").alias("_quality"))
    )
    rules = list(RULES)
    ratios = _ratios()
    levels = [
        F.struct(
            F.lit(rule).alias("rule"),
            sum((ratios[rule] > cut).cast("int") for cut in RULES[rule]).alias("level"),
        )
        for rule in rules
    ]
    histogram = write_shared(
        counted.join(judged, counted.doc_id == F.col("_labelled"))
        .select(F.col(stratum).alias("_stratum"), "_quality", F.inline(F.array(*levels)))
        .groupBy("_stratum", "rule", "level")
        .agg(
            F.count_if(F.col("_quality") > 0).alias("good"),
            F.count_if(F.col("_quality") <= 0).alias("bad"),
        ),
        "label-histogram",
    )
    # A row per rule and level of each stratum from here on.
    of_rule = histogram.groupBy("_stratum", "rule").agg(
        F.sum("good").alias("n_good"),
        F.collect_list(F.struct("level", "good", "bad")).alias("levels"),
    )
    grid = F.array(
        *(
            F.struct(
                F.lit(rule).alias("of"), F.lit(i + 1).alias("level_from"), F.lit(cut).alias("cut")
            )
            for rule in rules
            for i, cut in enumerate(RULES[rule])
        )
    )
    tests = sum(map(len, RULES.values()))

    def above(part: str) -> Column:
        kept = F.filter("levels", lambda x: x["level"] >= F.col("level_from"))
        return F.aggregate(kept, F.lit(0).cast("long"), lambda total, x: total + x[part])

    tried = (
        of_rule.select("*", F.inline(grid))
        .where("of = rule")
        .select(
            "_stratum", "rule", "cut", "n_good", above("good").alias("g"), above("bad").alias("b")
        )
    )
    strata = max(histogram.select("_stratum").distinct().count(), 1)
    tail = binomial_log_tail(F.col("g"), F.col("n_good"), alpha / len(rules))
    certified = (tail <= F.log(F.lit(delta / tests / strata))) & (F.col("b") > F.col("g"))
    found = (
        tried.withColumn("certified", certified)
        .groupBy("_stratum")
        .agg(*(_best_cut(rule) for rule in rules))
    )
    return write_shared(found, "cutoffs")


def _best_cut(rule: str) -> Column:
    usable = F.col("certified") & (F.col("rule") == rule)
    order = F.when(usable, F.struct(F.col("b") - F.col("g"), F.col("cut")))
    return F.max_by(F.when(usable, F.col("cut")), order).alias(f"_cut_{rule}")


def judge(counted: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Counted rows with ``base_failed`` and ``kept``; columns so named are replaced.

    ``cutoffs`` has a row per stratum; a stratum without one keeps all that the base keeps.
    """
    rejected = F.lit(False)
    for rule, ratio in _ratios().items():
        rejected = rejected | F.coalesce(ratio > F.col(f"_cut_{rule}"), F.lit(False))
    joined = counted.join(cutoffs, counted[stratum].eqNullSafe(cutoffs["_stratum"]), "left")
    return joined.withColumns(
        {"base_failed": base_failed(), "kept": ~base_failed() & ~rejected}
    ).drop("_stratum", *(f"_cut_{rule}" for rule in RULES))
