"""Quality rules as a ledger: every rule is evaluated once, its outcome kept as one bit.

The ledger stores the measurements and a mask of failed rules per row.  A
policy is a version name and the set of rules it enforces; applying or changing
one reads bits, never texts.  Ablations group rows by mask (as many groups as
there are masks, whatever the input) and combine the masks bit by bit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import text as tx

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition over the measurements; ``bit`` never changes once published."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("many_symbols", 2, "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", 3, "100 * n_dup_lines > 60 * n_lines"),
    Rule("short_words", 4, "word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: 1 << r.bit for r in rules}
        return sum(bits[name] for name in set(self.rules))


POLICIES = {
    "base": Policy("base", ("few_words", "repeated_windows")),
    "v1": Policy("v1", ("few_words", "repeated_windows", "many_symbols")),
    "v2": Policy("v2", tuple(r.name for r in RULES)),
}


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags)][edges])


def _own(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Makes equal hashes of different texts differ."""
    return tx.combine([owner.astype(np.uint64), hashes])


_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), np.uint8))
_NEWLINE = tx.byte_class((0x0A, 0x0A))


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of a block of texts (see ``ledger``)."""
    data, offsets = tx.flat(texts)
    n = len(offsets) - 1
    w = tx.words(data, offsets, tx.NOT_SPACE)
    in_word = tx.NOT_SPACE[data]
    letters = in_word & ((data & 0xC0) != 0x80)

    lines = tx.words(data, offsets, ~_NEWLINE)
    solid = np.r_[0, np.cumsum(in_word)]
    has_word = solid[lines.end] > solid[lines.start]
    owner = lines.text_of[has_word]
    key = _own(tx.range_hashes(data, lines.start[has_word], lines.end[has_word]), owner)
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True

    windows, at = tx.window_hashes(tx.word_hashes(w), w.at, WINDOW)
    again = at[_repeated(_own(windows, w.text_of[at]))]
    depth = np.zeros(len(w.start) + 1, np.int64)
    depth[again] += 1
    np.subtract.at(depth, again + WINDOW, 1)
    return {
        "n_words": w.per_text,
        "word_chars": _per_text(letters, offsets),
        "n_symbols": _per_text(_IS_SYMBOL[data], offsets),
        "n_lines": np.bincount(owner, minlength=n),
        "n_dup_lines": np.bincount(owner[~first], minlength=n),
        "n_repeat_words": _per_text(np.cumsum(depth)[:-1] > 0, w.at),
    }


def ledger(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Adds the measurements and ``fail_bits`` to every row.

    Words are runs without white space, lines are split at newlines and count if
    they hold a word, a duplicate line equals an earlier one of its text, a
    repeated word lies in a window of five words that the text holds twice.
    Null and empty texts measure 0 everywhere and fail what 0 fails.  Rows are
    neither dropped nor merged; input columns named like a result are replaced.
    """
    if len({r.bit for r in rules}) != len(rules):
        raise ValueError("two rules share a bit")
    measured = tx.map_texts(df, text_col, measure, MEASURES)
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits + F.when(F.expr(rule.fails), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long"))
    return measured.withColumn("fail_bits", bits)


def fails(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a row of a ledger fails a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) != 0


def apply_policy(book: DataFrame, policy: Policy, kept_col: str = "kept", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the verdict of a policy to a ledger."""
    return book.withColumn(kept_col, ~fails(policy, rules))


def ablation(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, by: list[str] | None = None) -> DataFrame:
    """Per rule of a policy (and group): rows that fail it, fail only it, and are kept without it.

    Rows are first counted by mask, map-side; a hot group costs one row per mask
    and task.  An empty ledger gives no rows.
    """
    by = by or []
    mask = F.lit(policy.mask(rules)).cast("long")
    counted = book.groupBy(*by, F.col("fail_bits").bitwiseAND(mask).alias("mask")).count()
    one_each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if r.name in policy.rules])
    spread = counted.withColumn("r", F.explode(one_each)).select(*by, "mask", "count", "r.rule", "r.bit")
    hit = F.col("mask").bitwiseAND(F.col("bit")) != 0
    return spread.groupBy(*by, "rule").agg(
        F.sum("count").alias("n_rows"),
        F.sum(F.when(hit, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("mask") == F.col("bit"), F.col("count")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("mask").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("count")).otherwise(0)).alias("n_kept_without"),
    )
