"""Quality rules as a bitmask ledger.

Each rule is evaluated once a document. The ledger keeps the measurements and one failure bit a rule, so any
policy (a named, versioned set of rules) is a bitwise test on the ledger, and what each rule costs a policy is
a bitwise aggregation over the distinct bit patterns; no text is read again.

Defined cases: a null text has no words and fails as an empty one does; repeated rows each get their row; an
empty table gives an empty ledger; other columns of the input, whatever their names, are left out of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenfold.llm.common import BLANKS, let

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_marked")

#: In the order of their bits. Each is a condition on the measurements under which a document fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "n_lines >= 4 and 10 * n_dup_lines > 6 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "shouting": "10 * n_shouts > 3 * n_words",
    "marked_words": "10 * n_marked > 3 * n_words",
}

POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "many_symbols", "duplicate_lines", "short_words", "long_words"),
    "v2": tuple(RULES),
}


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def _repeated(words: Column) -> Column:
    """Words in three-word windows that the text holds twice or more.

    Windows are compared by a 64-bit hash; sorted with their places, equal ones stand side by side.
    """
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    windows = F.sort_array(
        F.transform(
            starts,
            lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
        )
    )

    def covered(ws: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            h = x["h"]
            return (F.get(ws, i - 1)["h"].eqNullSafe(h)) | (F.get(ws, i + 1)["h"].eqNullSafe(h))

        places = F.transform(F.filter(ws, twin), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
        return F.size(F.array_distinct(F.flatten(places)))

    return let(windows, covered)


def measure(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a document: its id and MEASURES, each a long."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    measured = docs.select(
        F.col(id_col),
        let(
            F.array_remove(F.split(text, BLANKS), ""),
            lambda words: F.struct(
                F.size(words).alias("n_words"),
                F.length(F.array_join(words, "")).alias("word_chars"),
                _repeated(words).alias("n_repeat_words"),
            ),
        ).alias("w"),
        let(
            lines,
            lambda ls: F.struct(F.size(ls).alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines")),
        ).alias("l"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).alias("n_symbols"),
        F.regexp_count(text, F.lit(r"!!")).alias("n_shouts"),
        F.regexp_count(text, F.lit(r"[*%$&#]{3}")).alias("n_marked"),
    ).select(id_col, "w.*", "l.*", "n_symbols", "n_shouts", "n_marked")
    return measured.select(id_col, *[F.col(m).cast("long").alias(m) for m in MEASURES])


def ledger(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The measurements and fail_bits, in which bit k stands for the k-th of RULES."""
    bits = F.lit(0).cast("long")
    for k, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, text_col, id_col).withColumn("fail_bits", bits)


def verdict(policy: str, bits: str = "fail_bits") -> Column:
    """True where a document of the ledger fails no rule of the policy."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(entries: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that the policy without it keeps.

    The ledger is first summed by bit pattern, of which there are at most 2 to the number of rules.
    """
    patterns = (
        entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("bits"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    names = list(RULES)
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    return (
        patterns.select("bits", "n", F.inline(rules))
        .groupBy("rule", "bit")
        .agg(
            F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("n_failed_alone"),
            F.coalesce(F.sum(F.when((F.col("bits") == 0) | alone, F.col("n"))), F.lit(0)).alias("n_kept_without"),
        )
    )
