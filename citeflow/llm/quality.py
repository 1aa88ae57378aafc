"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule is a share (of symbols, of repeated lines, of repeated words, of capitals): a document is rejected when its
share exceeds the cutoff of its stratum. A cutoff may be used only if the labelled documents prove, by an exact binomial
test, that it rejects few good ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.llm.frames import col, stored

#: Most of a stratum's good documents that all rules together may reject, and the chance that any cutoff breaks this.
FALSE_REJECTION, FAILURE = 0.02, 0.05
#: Cutoffs are searched among these shares, fixed before any label is seen.
CUTOFFS = [k / 50 for k in range(1, 50)]
RULES = ("symbol_share", "dup_line_share", "repeat_word_share", "capital_share")
WHITE = "[ \\t\\n\\x0B\\f\\r]"


def _log_factorial(n: Column) -> Column:
    """log n! by Stirling's series at n + 8, brought back by the factors between; exact to about 1e-12."""
    z = n + F.lit(9.0)
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    below = F.lit(0.0)
    for k in range(1, 9):
        below = below + F.log(n + F.lit(float(k)))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - below


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p) where k < n * p, and 1 for larger k, which no test needs.

    The terms fall from k downward; those more than 40 standard deviations below are left out.
    """
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    steps = F.least(k, F.ceil(40 * F.sqrt(n * p * (1 - p)) + 100)).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * (k - i + 1) / (n - k + i) * ((1 - p) / p)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    downward = F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(top * F.aggregate(downward, start, add)["total"])


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Counts over each whole text: ``key``, ``stratum``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines (with a word) and n_capitals. Null is as empty.

    Repeated words are found without leaving the row: the hashes of all 3-word windows are sorted with their places,
    equal neighbours give the repeated places, and the words that these windows cover are added up.
    """
    rows = docs.select(col(key).alias("key"), col(stratum).alias("stratum"), F.coalesce(col(text), F.lit("")).alias("text"))
    words = rows.select(
        "key",
        "stratum",
        F.filter(F.split("text", f"{WHITE}+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(f"[^{WHITE[1:-1]}]")).alias("lines"),
        F.length(F.regexp_replace("text", f"{WHITE}+", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace("text", "[^A-ZÀ-ÖØ-Þ]+", "")).cast("bigint").alias("n_capitals"),
    )
    w = F.col("words")

    def window(word: Column, i: Column) -> Column:
        return F.struct(F.xxhash64(word, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))

    windows = F.when(F.size("words") >= 4, F.sort_array(F.transform(F.slice("words", 1, F.size("words") - 2), window)))
    windowed = words.select("*", windows.alias("windows"), F.size(w).cast("bigint").alias("n_words")).drop("words")
    n = F.size("windows")
    same = F.zip_with(
        F.slice("windows", 1, n - 1),
        F.slice("windows", 2, n - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    places = F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda pair: pair.isNotNull()))))
    placed = windowed.select("*", places.alias("places")).drop("windows")
    start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))

    def cover(acc: Column, i: Column) -> Column:
        return F.struct((acc["covered"] + i + 3 - F.greatest(acc["end"], i)).alias("covered"), (i + 3).alias("end"))

    return placed.select(
        "key",
        "stratum",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.aggregate("places", start, cover)["covered"], F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        "n_capitals",
    )


def shares(measured: DataFrame) -> DataFrame:
    """Add the shares the rules look at; 0 where there is nothing to take a share of."""

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    return measured.select(
        "*",
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_word_share"),
        share("n_capitals", "word_chars").alias("capital_share"),
    )


def certified_cutoffs(
    labelled: DataFrame, false_rejection: float = FALSE_REJECTION, failure: float = FAILURE
) -> DataFrame:
    """Per stratum one column per rule with its cutoff, null where none is proven.

    ``labelled`` has ``stratum``, ``good`` (boolean) and the shares. For each stratum and rule the cutoffs are tested
    from the laxest on: does it reject more than its part of the allowed share of good documents? The p-value is the
    exact binomial chance of so few rejections. Testing in this fixed order needs no correction within a rule; over
    strata and rules the level is divided by their number (Bonferroni), so with probability ``1 - failure`` all cutoffs
    together keep the promise in every stratum. Among the proven cutoffs the one that separates bad from good
    documents best is used, the laxest of equally good ones.
    """
    each = false_rejection / len(RULES)
    grid = F.array(*[F.lit(c) for c in CUTOFFS])
    long = labelled.select(
        "stratum",
        "good",
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES])).alias("r"),
    ).select("stratum", "good", "r.rule", F.size(F.filter(grid, lambda c: c < F.col("r.value"))).alias("above"))
    cells = long.groupBy("stratum", "rule", "above").agg(
        F.sum(F.col("good").cast("bigint")).alias("good"), F.sum((~F.col("good")).cast("bigint")).alias("bad")
    )
    everyone = cells.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good")).where("n_good > 0")
    tests = everyone.withColumn("n_tests", everyone.agg(F.count("*")).scalar())
    numbered = F.transform(grid, lambda c, i: F.struct((i + 1).alias("at"), c.alias("cutoff")))
    candidates = tests.withColumn("cut", F.explode(numbered))
    reject = (
        candidates.alias("t")
        .join(
            cells.alias("c"),
            F.col("t.stratum").eqNullSafe(F.col("c.stratum")) & (F.col("t.rule") == F.col("c.rule")) & (F.col("c.above") >= F.col("t.cut.at")),
            "left",
        )
        .groupBy("t.stratum", "t.rule", "t.n_good", "t.n_tests", F.col("t.cut.cutoff").alias("cutoff"))
        .agg(F.coalesce(F.sum("c.good"), F.lit(0)).alias("k_good"), F.coalesce(F.sum("c.bad"), F.lit(0)).alias("k_bad"))
    )
    proven = reject.where(binomial_at_most(F.col("k_good"), F.col("n_good"), each) <= F.lit(failure) / F.col("n_tests"))
    useful = proven.where("k_bad > 0").groupBy("stratum", "rule").agg(
        F.max_by("cutoff", F.struct((F.col("k_bad") - F.col("k_good")).alias("gain"), "cutoff")).alias("cutoff")
    )
    return useful.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    false_rejection: float = FALSE_REJECTION,
    failure: float = FAILURE,
) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every row of ``docs``; other columns are ignored.

    ``labels`` has the key and ``quality`` (1: good); of several labels of a document the best counts, null labels teach
    nothing. A null stratum is a stratum of its own. Without labels, or with too few to prove a cutoff, only the base
    rule rejects. Empty and null texts fail the base rule, as they have fewer than 50 words.
    """
    measured = shares(stored(measure(docs, key, text, stratum), "quality"))
    known = labels.where(F.col("quality").isNotNull()).groupBy(col(key).alias("key")).agg((F.max("quality") == 1).alias("good"))
    cutoffs = certified_cutoffs(measured.join(known, "key"), false_rejection, failure)
    cutoffs = stored(cutoffs.select(F.col("stratum").alias("_stratum"), *[F.col(r).alias(f"_{r}") for r in RULES]), "cutoffs")
    judged = measured.join(cutoffs, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(F.col(rule) > F.col(f"_{rule}"), F.lit(False))
    return judged.select(
        F.col("key").alias(key),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & ~rejected).alias("kept"),
    )
