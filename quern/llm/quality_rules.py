"""Operator 7: quality rules with adaptive thresholds, in DataFrame functions only.

Every text gets counts of words, symbols, repeated lines, words in repeated windows and words that echo the one before. Each
rule's figure is summed into a sketch per language and source: a table of bucket counts, where a bucket holds the values that share their leading
SKETCH_BITS bits (a log-linear histogram, relative error 2**-(SKETCH_BITS - 1)). Such sketches merge by adding counts, so the
partial aggregation before the shuffle is the merge, and the result does not depend on how rows are dealt. A group's
limit is its upper quartile plus FENCE times its interquartile range; there is no least spread and no fixed cutoff, so the group's own sketch
sets every limit. The documents are joined to their group's limits and filtered: one is rejected if its count is above what
its size times the limit gives by more than chance. Chance is CHANCE standard deviations of a Poisson count, so a short document isn't rejected for one symbol in a
group that has none, and a long one is for many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BLANKS, let, stored, text_column, words

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
SYMBOLS = "#*$%&|<>"
SKETCH_BITS = 7
FENCE = 3
#: Standard deviations that a count may be above its limit, by Poisson's distribution.
CHANCE = 3
#: Rule: (what it counts, of how many). A document above its group's limit by more than chance is rejected.
RULES = {
    "symbol_rate": ("n_symbols", "n_words"),
    "dup_line_rate": ("n_dup_lines", "n_lines"),
    "echo_rate": ("n_echoes", "n_words"),
    "word_length": ("word_chars", "n_words"),
}


def rate(rule: str, divide: str = "DIV") -> str:
    """A rule's figure per mille, as SQL over the counts."""
    count, size = RULES[rule]
    return f"1000 * {count} {divide} greatest({size}, 1)"


def above(rule: str) -> str:
    """Whether a count k is above its limit by more than chance, as SQL: k > m + c sqrt(m) + c**2, where m = size * limit / 1000."""
    count, size = RULES[rule]
    most = f"CAST({size} AS DOUBLE) * CAST({rule}_limit AS DOUBLE) / 1000"
    return f"coalesce(CAST({count} AS DOUBLE) > {most} + {CHANCE} * sqrt({most}) + {CHANCE**2}, false)"


def _windows(hashes: Column) -> Column:
    """The hash of each window, from those of its words, which are hashed once."""
    return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))


def _repeated_words(hashes: Column) -> Column:
    """Words covered by the windows whose hash occurs more than once. hashes: one per window start.

    Sorted by hash, equal windows are neighbours; the starts that have an equal neighbour, in order, cover
    min(gap, WINDOW) words each.
    """

    def covered(starts: Column) -> Column:
        gap = F.transform(starts, lambda p, i: F.when(i + 1 < F.size(starts), F.least(F.get(starts, i + 1) - p, F.lit(WINDOW))).otherwise(F.lit(WINDOW)))
        return F.aggregate(gap, F.lit(0).cast("bigint"), lambda total, g: total + g)

    def starts(sorted_: Column) -> Column:
        equal = F.filter(sorted_, lambda x, i: (F.get(sorted_, i + 1)["h"] == x["h"]) | (F.get(sorted_, i - 1)["h"] == x["h"]))
        return F.array_sort(F.transform(equal, lambda x: x["p"]))

    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    return let(F.array_sort(placed), lambda s: let(starts(s), covered))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text; null text is empty, null lang and source stay null."""
    text = text_column(docs)
    own = {c: docs[c] if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")}
    base = docs.select(docs["doc_id"], own["lang"].alias("lang"), own["source"].alias("source"), text.alias("text")).withColumn("w", words("text"))
    hashed = base.withColumn("h", F.when(F.size("w") >= WINDOW, let(F.transform("w", lambda x: F.xxhash64(x)), _windows)).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return hashed.withColumn("lines", lines).select(
        "doc_id", "lang", "source",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x, i: (i > 0) & (x == F.get("w", i - 1)))).cast("bigint").alias("n_echoes"),
        F.when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(0).cast("bigint")).otherwise(_repeated_words(F.col("h"))).alias("n_repeat_words"),
    )


def _bucket(value: str) -> Column:
    """The greatest value that shares the leading SKETCH_BITS bits of a non-negative value, so that no value is above its own bucket."""
    drop = f"greatest(length(bin({value})) - {SKETCH_BITS}, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {drop}) + 1, {drop}) - 1")


def limits(measured: DataFrame) -> DataFrame:
    """lang, source, rule and limit, from mergeable bucket counts over the documents that pass the base rules."""
    rates = measured.filter(~F.col("base_failed")).unpivot(["lang", "source"], list(RULES), "rule", "value")
    sketch = rates.groupBy("lang", "source", "rule", _bucket("value").alias("bucket")).agg(F.count("*").alias("n"))
    # A sketch has at most 57 * 2**(SKETCH_BITS - 1) buckets, so gathering one group's is bounded.
    group = sketch.groupBy("lang", "source", "rule").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("total"))

    def quantile(part: int) -> Column:
        rank = F.expr(f"(total * {part} + 3) DIV 4")
        return F.aggregate(
            "b",
            F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(0).cast("bigint").alias("at")),
            lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.when(s["seen"] < rank, x["bucket"]).otherwise(s["at"]).alias("at")),
            lambda s: s["at"],
        )

    return group.select("lang", "source", "rule", quantile(1).alias("q1"), quantile(3).alias("q3")).select("lang", "source", "rule", (F.col("q3") + FENCE * (F.col("q3") - F.col("q1"))).alias("limit"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the rules' figures and limits.

    docs: doc_id, text, and lang and source if there are any (others ignored). One row per input row, repeated rows
    included. Null or empty text has no words and fails the base rules; null lang or source is a group of its own. A group
    of which no document passes the base rules has no limits and needs none.
    """
    base = counts(docs).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))
    measured = stored(base.withColumns({k: F.expr(rate(k)) for k in RULES}), "counts")
    wide = limits(measured).groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == k, F.col("limit"))).alias(f"{k}_limit") for k in RULES])
    wide = wide.withColumnsRenamed({"lang": "l", "source": "s"})
    met = measured.join(wide, measured["lang"].eqNullSafe(wide["l"]) & measured["source"].eqNullSafe(wide["s"]), "left")
    return met.withColumn("kept", ~F.col("base_failed") & ~F.expr(" OR ".join(above(k) for k in RULES))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *RULES, *[f"{k}_limit" for k in RULES]
    )
