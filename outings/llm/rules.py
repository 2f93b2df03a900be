"""Quality rules as a ledger: every rule is evaluated once, policies and ablations only read its bits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outings.llm.common import prepared

# Words end at these characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements."""

    name: str
    fails: str


RULES = (
    Rule("too_short", "n_words < 50"),
    Rule("repeats", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "20 * n_symbols > n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("no_letters", "NOT has_letter"),
    Rule("shouting", "2 * n_capital_runs > n_words"),
    Rule("separators", "5 * n_bars > n_words"),
)
BASE = ("too_short", "repeats")


@dataclass(frozen=True)
class Policy:
    """A version of the decision: a document fails if it fails one rule of ``any_of`` or ``at_most`` + 1 of ``counted``."""

    version: str
    any_of: tuple[str, ...]
    counted: tuple[str, ...] = ()
    at_most: int = 0


POLICIES = (
    Policy("v1", BASE + ("no_letters", "symbols")),
    Policy("v2", BASE + ("no_letters", "symbols", "shouting", "separators"), ("duplicate_lines", "word_length"), 1),
)


def bit_of(name: str, rules: tuple[Rule, ...] = RULES) -> int:
    return 1 << [r.name for r in rules].index(name)


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    return sum(bit_of(n, rules) for n in set(names))


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements that the rules read, over whole texts; a null text has no words and no lines.

    Repeated windows stay inside one row, nothing is shuffled. Half of the hash of every window of three words and its
    position are packed into one long and sorted; equal neighbours are candidates, which the whole hash confirms, and
    the words that the confirmed windows cover are counted from their sorted positions.
    """
    df = prepared(docs).select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    df = df.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    df = df.withColumns({"n_words": F.size("words").cast("long"), "hashes": F.transform("words", lambda w: F.xxhash64(w)),
                         "word_chars": F.char_length(F.array_join("words", "")).cast("long")})
    df = df.withColumn("windows", F.expr("""
        CASE WHEN n_words >= 3 THEN transform(sequence(0, CAST(n_words AS int) - 3),
             i -> xxhash64(get(hashes, i), get(hashes, i + 1), get(hashes, i + 2))) END"""))
    df = df.withColumn("packed", F.expr("""
        CASE WHEN size(array_distinct(windows)) < size(windows)
             THEN sort_array(transform(windows, (h, i) -> shiftleft(shiftright(h, 32), 32) | CAST(i AS bigint))) END"""))
    df = df.withColumn("near", F.expr("""
        CASE WHEN packed IS NOT NULL THEN filter(sequence(1, size(packed) - 1),
             j -> shiftright(get(packed, j) ^ get(packed, j - 1), 32) = 0) END"""))
    df = df.withColumn("candidates", F.expr("""
        CASE WHEN near IS NOT NULL THEN sort_array(transform(array_distinct(flatten(transform(near, j -> array(
             CAST(get(packed, j - 1) & 4294967295L AS int), CAST(get(packed, j) & 4294967295L AS int))))),
             i -> named_struct('h', get(windows, i), 'i', i))) END"""))
    df = df.withColumn("positions", F.expr("""
        sort_array(transform(filter(candidates, (x, j) ->
            x.h <=> get(candidates, j - 1).h OR x.h <=> get(candidates, j + 1).h), x -> x.i))"""))
    covered = F.expr("""
        coalesce(aggregate(transform(positions, (a, k) -> least(3, coalesce(get(positions, k + 1) - a, 3))), 0L,
                           (n, x) -> n + x), 0L)""")
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    return df.select(
        "doc_id", "n_words", "word_chars", sum_of("text", SYMBOLS).alias("n_symbols"),
        covered.alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("text").rlike(r"\p{L}").alias("has_letter"),
        F.regexp_count("text", F.lit(r"\p{Lu}{2,}")).cast("long").alias("n_capital_runs"),
        sum_of("text", "|").alias("n_bars"))


def sum_of(column: str, symbols: str) -> Column:
    """How often the given one-byte characters occur."""
    size = F.octet_length(column)
    total = F.lit(0)
    for symbol in symbols:
        total = total + size - F.octet_length(F.replace(column, F.lit(symbol), F.lit("")))
    return total.cast("long")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the measurements and ``rule_bits``, bit i set where rule i failed.

    Defined cases: null or empty text fails ``too_short`` and has zeros everywhere; repeated rows stay repeated; extra
    columns are ignored; an empty table gives an empty ledger.
    """
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measurements(docs, id_col, text_col).withColumn("rule_bits", bits)


def fails_policy(policy: Policy, rules: tuple[Rule, ...] = RULES, bits: str = "rule_bits") -> Column:
    hard = F.col(bits).bitwiseAND(F.lit(mask_of(policy.any_of, rules)).cast("long")) != 0
    if not policy.counted:
        return hard
    soft = F.bit_count(F.col(bits).bitwiseAND(F.lit(mask_of(policy.counted, rules)).cast("long")))
    return hard | (soft > policy.at_most)


def apply_policies(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with one boolean ``kept_<version>`` per policy; no rule is evaluated again."""
    return entries.withColumns({f"kept_{p.version}": ~fails_policy(p, rules) for p in policies})


def ablations(entries: DataFrame, policy: Policy = POLICIES[-1], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For every rule: documents failing it, failing it alone, and kept if the policy did without it.

    The ledger is first reduced to one row per combination of bits (2^rules at most), with a partial aggregation in
    every task; the ablations read only those rows.
    """
    combos = entries.groupBy("rule_bits").agg(F.count("*").alias("n"))
    out = None
    for rule in rules:
        bit = F.lit(bit_of(rule.name, rules)).cast("long")
        without = F.col("rule_bits").bitwiseAND(F.bitwise_not(bit))
        kept = ~fails_policy(policy, rules, "without")
        row = combos.withColumn("without", without).agg(
            F.coalesce(F.sum(F.when(F.col("rule_bits").bitwiseAND(bit) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("rule_bits") == bit, F.col("n"))), F.lit(0)).alias("n_failed_alone"),
            F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("n_kept_without"))
        row = row.select(F.lit(rule.name).alias("rule"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def rule_rows(docs: DataFrame) -> DataFrame:
    """The query's columns: base measurements, base verdict, and the verdict of the newest policy."""
    entries = apply_policies(ledger(docs))
    failed = F.col("rule_bits").bitwiseAND(F.lit(mask_of(BASE)).cast("long")) != 0
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
                          failed.alias("base_failed"), F.col(f"kept_{POLICIES[-1].version}").alias("kept"),
                          "kept_v1", "rule_bits")
