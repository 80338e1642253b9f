"""Quality rules by a rule bitmask ledger, in SQL functions only.

Every rule is evaluated once per document. Its outcome is one bit of ``failures``; the
measurements that it used stay beside it. A policy is a set of rule names under a version:
applying one is ``failures & mask = 0``, without reading a text again, and ablations (what
would each rule drop on its own, or what would come back without it) are sums over bits.

Cases: a null or empty text has no words and fails ``few_words``; a null id stays null;
repeated rows each get a row; an empty table gives an empty ledger. Words are maximal runs
of characters other than space, \\t, \\n, \\v, \\f and \\r. Texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "[#*$%&|<>]"
SPACES, NOT_SPACE = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]"
#: Rule name -> condition of failure, in bit order. New rules go to the end: bits in
#: stored ledgers keep their meaning.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > word_chars",
    "duplicate_lines": "n_lines >= 4 and 2 * n_dup_lines > n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)",
}
BASE = ("few_words", "repeated_words")
#: Policy version -> the rules that reject.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "many_symbols", "duplicate_lines", "word_length"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: The words of a window of n_repeat_words.
WINDOW = 3


def mask(rules) -> int:
    """The bits of some rules."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in set(rules))


def _window_order(df: DataFrame) -> DataFrame:
    """Adds __order: the indexes of __windows, equal windows side by side.

    Each hash keeps its upper 40 bits above its index in one long, so that the sort is one
    of plain longs. Where different hashes share these bits (or indexes need more than 24
    bits) the sort runs over whole hashes instead.
    """
    df = df.withColumn("__packed", F.expr("sort_array(transform(__windows, (h, i) -> (h & -16777216L) | i))"))
    unclear = (
        "size(__windows) >= 16777216 or exists(sequence(1, greatest(1, size(__packed) - 1)), i ->"
        " (get(__packed, i) & -16777216L) = (__packed[i - 1] & -16777216L)"
        " and __windows[int(__packed[i] & 16777215L)] != __windows[int(__packed[i - 1] & 16777215L)])"
    )
    return df.withColumn(
        "__order",
        F.expr(
            f"case when size(__windows) = 0 then cast(array() as array<int>) when {unclear}"
            " then transform(sort_array(transform(__windows, (h, i) -> struct(h, i))), x -> x.i)"
            " else transform(__packed, p -> int(p & 16777215L)) end"
        ),
    )


def _covered(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: how many words lie in windows that occur at least twice.

    The indexes of windows with an equal neighbour in __order, sorted, give it as a sum of
    gaps of at most WINDOW.
    """
    df = df.withColumn(
        "__repeated",
        F.expr(
            "sort_array(filter(transform(__order, (w, i) -> if("
            "__windows[w] = __windows[get(__order, i - 1)] or __windows[w] = __windows[get(__order, i + 1)], w, -1)), x -> x >= 0))"
        ),
    )
    return df.withColumn(
        "n_repeat_words",
        F.expr(
            f"aggregate(__repeated, named_struct('sum', 0L, 'last', {-WINDOW}),"
            f" (a, s) -> named_struct('sum', a.sum + least({WINDOW}, s - a.last), 'last', s), a -> a.sum)"
        ),
    )


def measure(docs: DataFrame, carry: bool = False) -> DataFrame:
    """One row per document: doc_id and MEASURES, all long. carry: also __row, a struct of
    all columns of docs."""
    row = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row")] if carry else []
    kept = ["__row"] * carry
    df = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("__text"), *row)
    df = df.withColumn("__words", F.array_remove(F.split("__text", SPACES + "+"), ""))
    df = df.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(NOT_SPACE)))
    df = df.select(
        "doc_id",
        *kept,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            f"if(size(__words) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, size(__words) - {WINDOW}),"
            f" i -> xxhash64({', '.join(f'__words[i + {k}]' for k in range(WINDOW))})))"
        ).alias("__windows"),
    )
    # where no window repeats, the rest has nothing to do
    df = df.withColumn("__windows", F.expr("if(size(array_distinct(__windows)) = size(__windows), cast(array() as array<bigint>), __windows)"))
    return _covered(_window_order(df)).select("doc_id", *kept, *MEASURES)


def ledger(docs: DataFrame, carry: bool = False) -> DataFrame:
    """measure() with ``failures``: the bit of each rule that a document fails."""
    bits = F.lit(0).cast("long")
    for i, failed in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, carry).withColumn("failures", bits)


def rejects(policy: str = "v1") -> Column:
    """Of a ledger: the policy rejects the document."""
    return F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) != 0


def ablation(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: failed (its bit is set) and alone (the only set bit of the
    policy, so the rows that come back without the rule). One pass, one row per rule."""
    names, all_bits, sums = POLICIES[policy], mask(POLICIES[policy]), []
    for r in names:
        bit = mask([r])
        sums += [F.count_if(F.col("failures").bitwiseAND(F.lit(bit)) != 0).alias(f"f_{r}"), F.count_if(F.col("failures").bitwiseAND(F.lit(all_bits)) == bit).alias(f"a_{r}")]
    stack = ", ".join(f"'{r}', f_{r}, a_{r}" for r in names)
    return led.agg(F.count("*").alias("rows"), *sums).selectExpr("rows", f"stack({len(names)}, {stack}) as (rule, failed, alone)")


def keep_clean(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of docs that the policy doesn't reject, with all their columns.

    The row number holds the filter above the ledger: pushed below it, the condition would hold
    every measure's expression, and evaluate it anew for each word."""
    led = ledger(docs, carry=True).withColumn("__number", F.monotonically_increasing_id())
    return led.where(~rejects(policy) & (F.col("__number") >= 0)).select("__row.*")
