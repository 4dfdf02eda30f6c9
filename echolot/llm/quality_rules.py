"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document: the ledger holds the measurements and one failure bit for each rule.
Policies are versioned sets of rules; applying one is a bitwise test of the stored bits, so another version needs no
second look at the texts. Ablations are computed from the ledger's histogram of bit patterns, at most 2**rules rows.

Words are the runs outside [\\x20\\x09-\\x0D], lines are split at \\n. A null or empty text has no words, fails
too_few_words and is not kept. Repeated rows are judged each for itself. Other columns are ignored. Windows of five
words are compared by 64-bit hashes within their document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_RUN

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _let(value: Column, body) -> Column:
    """body(value) with value computed once; a lambda that captures an expression would compute it for each element."""
    return F.transform(F.array(value), body)[0]


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_shouts, places of !!."""
    given = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), given.alias("_t"), F.btrim(given, F.lit(WS)).alias("_b"))
    text, solid = F.col("_t"), F.translate("_t", WS, "")
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(WS))) > 0)
    hashes = _let(
        F.transform(F.split("_b", WS_RUN), lambda w: F.xxhash64(w)),
        lambda h: F.when(F.size(h) <= WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(h, (i + k).cast("int")) for k in range(WINDOW)]))))
    d = d.select(
        "doc_id",
        F.when(F.length("_b") == 0, 0).otherwise(F.size(F.split("_b", WS_RUN))).cast("long").alias("n_words"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.regexp_count(text, F.lit("!!")).cast("long").alias("n_shouts"),
        hashes.alias("_h"))
    # only documents with a repeated window sort their windows by hash and place
    placed = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return d.withColumn("_p", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("_p").isNull(), F.lit(0)).otherwise(_covered(F.col("_p"))).cast("long").alias("n_repeat_words"), "n_shouts")


def _covered(placed: Column) -> Column:
    """Words in windows whose hash occurs twice or more; placed: structs (h, i) sorted by both."""
    equal = _let(placed, lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: a["h"] == b["h"]))
    # a window repeats if it equals the next or the one before
    either = _let(equal, lambda e: F.zip_with(F.concat(F.array(F.lit(False)), e), F.concat(e, F.array(F.lit(False))), lambda a, b: a | b))
    marked = F.zip_with(placed, either, lambda p, e: F.when(e, p["i"]))
    at = F.array_sort(F.filter(marked, lambda i: i.isNotNull()))
    return _let(at, lambda x: F.aggregate(
        F.zip_with(x, F.slice(x, 2, F.size(x)), lambda a, b: F.when(b.isNull(), F.lit(WINDOW)).otherwise(F.least(b - a, F.lit(WINDOW)))),
        F.lit(0), lambda s, y: s + y))


@dataclass(frozen=True)
class Rule:
    """fails: an SQL condition over the measurements that is never null."""

    name: str
    fails: str


RULES = (
    Rule("too_few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("short_words", "2 * word_chars < 3 * n_words"),
    Rule("long_words", "word_chars > 40 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_words"),
    Rule("shouting", "2 * n_shouts > n_words"),
)
#: Versions of what counts; base_v1 is the contract's base.
POLICIES = {
    "base_v1": ("too_few_words", "repeated_words"),
    "quality_v1": ("too_few_words", "repeated_words", "symbols", "short_words", "long_words", "repeated_lines", "shouting"),
}


def mask(policy: str, rules: tuple[Rule, ...] = RULES) -> int:
    names = [r.name for r in rules]
    return sum(1 << names.index(x) for x in POLICIES[policy])


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements and fail_bits: bit k is set where rule k fails."""
    bits = " | ".join(f"if({r.fails}, {1 << k}L, 0L)" for k, r in enumerate(rules)) or "0L"
    return measurements(docs).withColumn("fail_bits", F.expr(bits))


def apply_policy(book: DataFrame, policy: str, to: str = "kept") -> DataFrame:
    return book.withColumn(to, F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablation(book: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: failing documents, those that fail it alone, and what is kept without it."""
    m = mask(policy, rules)
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    own = [(r.name, 1 << k) for k, r in enumerate(rules) if m >> k & 1]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in own]))
    return patterns.select("bits", "n", each.alias("r")).groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failing"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failing_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"))


def judged(docs: DataFrame, policy: str = "quality_v1") -> DataFrame:
    book = apply_policy(apply_policy(ledger(docs), "base_v1", "_base"), policy, "_kept")
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("_base")).alias("base_failed"), (F.col("_base") & F.col("_kept")).alias("kept"), "fail_bits", "n_shouts")
