"""Rule bitmask ledger: every rule is evaluated once, and policies are bit tests over what was stored.

``ledger`` makes one row a document: its measurements and ``failed_mask``, a bit for each rule that it fails.
``apply_policy`` keeps the rows of which no bit of a versioned policy is set, and ``ablations`` tells for every
rule of a policy how many documents it rejects, alone or with others, from counts by mask.  Built-in expressions
only; a document is measured inside its own row, so nothing is shuffled and no key can be hot.

Defined results: a null text counts as a text without words, which fails the rules that ask for words; repeated
rows are measured each for itself; an empty table gives an empty ledger; other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, as characters for TRIM and TRANSLATE and as a pattern.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHOUTS = "!?"


@dataclass(frozen=True)
class Rule:
    """A document fails the rule if ``fails``, SQL over the measurements, holds.  bit: its place in the mask, never reused."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "short_mean_word", "word_chars < 2 * n_words"),
    Rule(3, "long_mean_word", "word_chars > 20 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(5, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(6, "digits", "100 * n_digits > 30 * word_chars"),
    Rule(7, "capitals", "100 * n_capitals > 60 * word_chars"),
    Rule(8, "shouts", "2 * n_shouts > n_words"),
)

#: Policies by version.  A version is never changed once used; a new one is added.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": tuple(r.name for r in RULES),
}


def policy_mask(policy: str, rules: tuple[Rule, ...] = RULES) -> int:
    names = POLICIES[policy]
    known = {r.name: r.bit for r in rules}
    return sum(1 << known[n] for n in names)


def _literal(chars: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" for c in chars) + "'"


def _count(chars: str) -> str:
    return f"cast(char_length(__text) - char_length(translate(__text, {_literal(chars)}, '')) as bigint)"


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The measurements of every whole text, one row a row of docs.

    Windows of three words are first compared by the upper 33 bits of a hash, which lie with the window's place in
    one sorted array of longs; those that agree with a neighbour are then compared as text, so that a clash of
    hashes cannot count.
    """
    spaces = _literal(SPACES)
    out = docs.select(F.col(id_column).alias(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("__text"))
    out = out.withColumn("__trimmed", F.expr(f"trim(BOTH {spaces} FROM __text)"))
    out = out.withColumn("__words", F.when(F.col("__trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("__trimmed", SPACE_RUN, -1)))
    out = out.withColumn("__lines", F.expr(f"filter(split(__text, '\\n', -1), l -> trim(BOTH {spaces} FROM l) <> '')"))
    out = out.select(
        id_column,
        "__words",
        F.size("__words").cast("bigint").alias("n_words"),
        F.expr(f"cast(char_length(translate(__text, {spaces}, '')) as bigint)").alias("word_chars"),
        F.expr(_count(SYMBOLS)).alias("n_symbols"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        F.size(F.array_distinct("__lines")).cast("bigint").alias("__distinct_lines"),
        F.expr(_count(DIGITS)).alias("n_digits"),
        F.expr(_count(CAPITALS)).alias("n_capitals"),
        F.expr(_count(SHOUTS)).alias("n_shouts"),
    )
    out = out.withColumn("n_dup_lines", F.col("n_lines") - F.col("__distinct_lines"))
    out = out.withColumn(
        "__sorted",
        F.expr(
            "if(n_words < 4, cast(array() as array<bigint>), sort_array(transform(sequence(0, cast(n_words as int) - 3), "
            "i -> (xxhash64(get(__words, i), get(__words, i + 1), get(__words, i + 2)) & -2147483648L) | cast(i as bigint))))"
        ),
    )
    out = out.withColumn(
        "__near",
        F.expr(
            "filter(__sorted, (x, j) -> coalesce(shiftright(x ^ get(__sorted, j - 1), 31) = 0, false) "
            "or coalesce(shiftright(x ^ get(__sorted, j + 1), 31) = 0, false))"
        ),
    )
    out = out.withColumn(
        "__texts",
        F.expr(
            "if(size(__near) = 0, null, sort_array(transform(transform(__near, x -> cast(x & 2147483647L as int)), "
            "p -> struct(concat_ws(' ', get(__words, p), get(__words, p + 1), get(__words, p + 2)) as s, p as p))))"
        ),
    )
    out = out.withColumn(
        "n_repeat_words",
        F.expr(
            "if(__texts is null, 0L, cast(size(array_distinct(flatten(transform(filter(__texts, (x, j) -> "
            "coalesce(get(__texts, j - 1).s = x.s, false) or coalesce(get(__texts, j + 1).s = x.s, false)), "
            "x -> array(x.p, x.p + 1, x.p + 2))))) as bigint))"
        ),
    )
    return out.select(id_column, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_capitals", "n_shouts")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The measurements and failed_mask, a long with bit ``rule.bit`` set for every failed rule."""
    mask: Column = F.lit(0).cast("bigint")
    for r in rules:
        mask = mask.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return measure(docs, id_column, text_column).withColumn("failed_mask", mask)


def apply_policy(kept_ledger: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with kept: whether no rule of the policy failed."""
    return kept_ledger.withColumn("kept", F.col("failed_mask").bitwiseAND(F.lit(policy_mask(policy, rules)).cast("bigint")) == 0)


def ablations(kept_ledger: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rule, rejected (documents that fail it), only_rule (those that no other rule of the policy rejects), without_rule
    (documents rejected once it is taken out).  One aggregation by mask comes first; the rest works on its few rows."""
    mask = policy_mask(policy, rules)
    by_mask = kept_ledger.groupBy(F.col("failed_mask").bitwiseAND(F.lit(mask).cast("bigint")).alias("mask")).agg(F.count("*").alias("n"))
    wanted = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in rules if mask >> r.bit & 1])
    each = by_mask.select("mask", "n", F.explode(wanted).alias("r"))
    has = F.col("mask").bitwiseAND(F.col("r.bit")) != 0
    others = F.col("mask").bitwiseAND(F.bitwise_not(F.col("r.bit"))) != 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(total(has).alias("rejected"), total(has & ~others).alias("only_rule"), total(others).alias("without_rule"))


def filter_documents(docs: DataFrame, policy: str = "v1", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with all their columns.  The verdict is reached within the row, so that
    repeated ids do no harm."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text_column).alias("__doc_text"))
    judged = apply_policy(ledger(row, id_column="__row", text_column="__doc_text"), policy)
    # A filter pushed below the measurements would hold a copy of each for every use, some of them inside loops over words.
    # The optimizer moves none past a column whose value depends on the row's place.
    judged = judged.select("__row", "kept", F.monotonically_increasing_id().alias("__place"))
    return judged.where("kept and __place >= 0").select("__row.*")
