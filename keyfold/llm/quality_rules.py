"""Rule bitmask ledger: every rule is evaluated once and its outcome kept.

``ledger`` measures each whole text with built-in SQL functions and stores one
bit per failed rule next to the measurements. Policies are versioned masks over
those bits, so a new policy or an ablation never reads the texts again.

Defined results: a null text counts as empty; a text of any length is measured
whole; an empty table gives an empty ledger; repeated rows and rows with a null id
each get their own row; columns of the input other than the id and the text are not
read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
NOT_SYMBOL = r"[^#*$%&|<>]+"
WINDOW = 8

#: Rule names in bit order, each with its condition over the measurements.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_heavy", "2 * n_symbols > n_words"),
    ("duplicate_lines", "n_lines > 3 and 2 * n_dup_lines > n_lines"),
    ("long_words", "word_chars > 40 * n_words"),
]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules; a document that fails any of them is rejected."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        order = [name for name, _ in RULES]
        return sum(1 << order.index(rule) for rule in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
STANDARD = Policy("standard-1", ("few_words", "repeated_windows", "symbol_heavy", "duplicate_lines"))


def _repeat_words(hashes: Column, ordered: Column) -> Column:
    """Words inside windows that occur at least twice; ``ordered`` is the sorted (hash, position) list."""

    def again(x: Column, i: Column) -> Column:
        return F.coalesce(x["h"] == F.get(ordered, i - 1)["h"], F.lit(False)) | F.coalesce(
            x["h"] == F.get(ordered, i + 1)["h"], F.lit(False)
        )

    return F.sort_array(F.transform(F.filter(ordered, again), lambda x: x["p"]))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """``id_col`` and the measurements of :data:`MEASURES` for every row of ``docs``.

    ``keep_row`` carries the whole input row along as the struct ``row``.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_row else []
    kept = ["row"] if keep_row else []
    text = F.coalesce(F.col("__text"), F.lit(""))
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    d = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *row)
    d = d.select(
        "__id",
        *kept,
        words.alias("w"),
        F.length(F.regexp_replace(text, NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    d = d.select(
        "__id",
        *kept,
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("wh"),
    )
    starts = F.when(F.size("wh") >= WINDOW, F.sequence(F.lit(0), F.size("wh") - WINDOW)).otherwise(
        F.array().cast("array<int>")
    )
    d = d.withColumn("h", F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("wh"), i + k) for k in range(WINDOW)])))
    d = d.drop("wh").withColumn("again", F.size(F.array_distinct("h")) < F.size("h"))
    pairs = F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    d = d.withColumn("s", F.when(F.col("again"), F.sort_array(pairs)))
    d = d.withColumn("p", _repeat_words(F.col("h"), F.col("s"))).drop("h", "s", "again")
    spans = F.transform("p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("p"), i + 1) - x, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    # generated as rows of their own, so that a filter on the result stays above: pushed
    # below the steps above, each step would copy the one before it
    found = F.struct(*MEASURES[:-1], covered.alias("n_repeat_words"))
    return d.select(F.col("__id").alias(id_col), *kept, F.inline_outer(F.array(found)))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """Measurements plus ``failure_bits``: bit i is set where rule i of :data:`RULES` fails."""
    bits = F.lit(0).cast("long")
    for i, (_, condition) in enumerate(RULES):
        bits = bits + F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0))
    return measure(docs, id_col, text_col, keep_row).withColumn("failure_bits", bits)


def rejected(policy: Policy) -> Column:
    """True where the stored bits break ``policy``."""
    return F.col("failure_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def filtered(docs: DataFrame, policy: Policy, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``policy`` does not reject, in one pass without a join."""
    return ledger(docs, id_col, text_col, keep_row=True).where(~rejected(policy)).select("row.*")


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of ``policy``: documents that fail it, and those that only it rejects.

    One pass of partial aggregates over the stored bits; the result has a row a rule.
    """
    order = [name for name, _ in RULES]
    mask = F.lit(policy.mask).cast("long")
    hit = F.col("failure_bits").bitwiseAND(mask)
    sums = [F.count(F.lit(1)).alias("n_docs"), F.bit_or(hit).alias("any_bits"), F.sum((hit != 0).cast("long")).alias("n_rejected")]
    for rule in policy.rules:
        bit = F.lit(1 << order.index(rule)).cast("long")
        sums += [
            F.sum((hit.bitwiseAND(bit) != 0).cast("long")).alias(f"f_{rule}"),
            F.sum((hit == bit).cast("long")).alias(f"o_{rule}"),
        ]
    rows = [
        F.struct(
            F.lit(policy.version).alias("policy"),
            F.lit(rule).alias("rule"),
            F.coalesce(F.col(f"f_{rule}"), F.lit(0)).alias("n_failed"),
            F.coalesce(F.col(f"o_{rule}"), F.lit(0)).alias("n_only_this"),
            F.coalesce(F.col("n_rejected"), F.lit(0)).alias("n_rejected"),
            F.col("n_docs"),
        )
        for rule in policy.rules
    ]
    return entries.agg(*sums).select(F.inline(F.array(*rows)))
