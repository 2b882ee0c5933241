"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations are bit operations.

A ledger row holds the measurements of one document and a ``failed`` long whose bit b is set if rule b fails. A policy is
a version and a mask of the rules that it enforces; changing the policy, or asking what a rule costs, never reads the
texts again.

Cases: a null or empty text has no words (all measurements 0) and fails the base rule; null ids, repeated rows and rows
that tie stay as they are, one output row for each input row; an empty table gives an empty ledger; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import WORD_GAP, WORD_TRIM, let

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A failure condition in SQL over the ledger's measurements; its place in ``RULES`` is its bit."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("shouting", "100 * n_upper > 50 * word_chars"),
)
BASE_RULES = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    version: str
    enforced: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        known = [r.name for r in rules]
        return sum(1 << known.index(name) for name in set(self.enforced))


BASE_POLICY = Policy("base", BASE_RULES)
STRICT_POLICY = Policy("2", tuple(r.name for r in RULES))


def _repeat_words(words: Column, n_words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in ``words``."""

    def marked(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            twice = F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(ordered, covered))

    def windowed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(n_words < 3, 0).otherwise(let(let(words, windowed), marked))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: the id, its measurements (long) and the ``failed`` bits of ``rules``."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_words", F.split(F.btrim(text, F.lit(WORD_TRIM)), WORD_GAP))
    rows = rows.withColumn("n_words", F.when(F.get("_words", F.lit(0)) == "", 0).otherwise(F.size("_words")).cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WORD_TRIM)) != "")
    rows = rows.select(
        id_col,
        "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("_lines"),
        _repeat_words(F.col("_words"), F.col("n_words")).cast("long").alias("n_repeat_words"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    rows = rows.select(id_col, "n_words", "word_chars", "n_symbols", F.col("_lines.d").alias("n_dup_lines"), "n_repeat_words", F.col("_lines.n").alias("n_lines"), "n_upper")
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b, r in enumerate(rules)), F.lit(0).cast("long"))
    return rows.withColumn("failed", bits)


def apply_policy(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``policy_version`` and ``kept``: no enforced rule failed."""
    return rows.withColumns({"policy_version": F.lit(policy.version), "kept": F.col("failed").bitwiseAND(F.lit(policy.mask(rules))) == 0})


def ablations(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each enforced rule: documents it fails, documents only it fails, and documents kept without it.

    The ledger is first counted by its masked bits, so what follows has at most 2 ** len(rules) rows.
    """
    mask = policy.mask(rules)
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << b).cast("long").alias("bit")) for b, r in enumerate(rules) if mask >> b & 1]))
    cells = counts.select("bits", "n", each.alias("r")).select("bits", "n", "r.rule", "r.bit")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return cells.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        total((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"),
    )
