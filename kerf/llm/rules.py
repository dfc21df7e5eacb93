"""Quality rules as a ledger of failure bits, in DataFrame functions only.

Every rule is evaluated once for a document. The ledger keeps its measurements and
one number whose bit k says that rule k failed. A policy is a named, versioned mask
of bits: applying it, comparing versions and asking what each rule alone decides
(an ablation) are bit operations on the ledger, and no text is read again.

A word is a run of characters other than blank and \\t to \\r. Null text has no words.
Empty text fails ``few_words``. Repeated rows give repeated results. Windows of three
words are compared by 64-bit hash within a document. There is no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerf.llm.common import id_and_text

#: Fixed values.
SPACES = "\t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rule k sets bit k where it fails. Conditions are over measurements, in whole numbers.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "capitals": "n_upper > n_lower",
}
BASE_RULES = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = list(RULES)
        return sum(1 << names.index(r) for r in self.rules)


POLICIES = (Policy("base", 1, BASE_RULES), Policy("web", 1, (*BASE_RULES, "symbols", "repeated_lines")), Policy("web", 2, tuple(RULES)))


def policy(name: str = "web", version: int | None = None) -> Policy:
    """The policy of that name and version, by default the latest."""
    found = [p for p in POLICIES if p.name == name and version in (None, p.version)]
    if not found:
        raise ValueError(f"no policy {name!r} version {version}")
    return max(found, key=lambda p: p.version)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    flat = F.trim(F.translate(text, SPACES, " " * len(SPACES)))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " +"))


def repeated_words(words: Column, n: int = 3) -> Column:
    """Words that lie in a window of ``n`` words found twice or more."""

    def places(windows: Column) -> Column:
        # Equal windows are neighbours once sorted; keep places of those that have one.
        tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
        near = lambda s: F.filter(s, lambda x, k: F.coalesce(same(s, k, k - 1), F.lit(False)) | F.coalesce(same(s, k, k + 1), F.lit(False)))
        return F.sort_array(F.transform(let(tagged, near), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        widths = F.transform(at, lambda p, k: F.least(F.lit(n), F.coalesce(F.get(at, k + 1) - p, F.lit(n))))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
        none = F.lit(0).cast("long")
        return F.when(F.size(w) < n, none).otherwise(
            let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(let(places(h), covered)))
        )

    return let(words, count)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document with what the rules look at, all long."""
    text = F.col("text")
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    n = lambda c, name: c.cast("long").alias(name)
    return (
        rows.withColumns({"words": words(text), "lines": lines})
        .select(
            "doc_id",
            n(F.size("words"), "n_words"),
            n(F.length(text) - without(" " + SPACES), "word_chars"),
            n(without(SYMBOLS), "n_symbols"),
            n(F.size("lines"), "n_lines"),
            n(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
            n(repeated_words(F.col("words")), "n_repeat_words"),
            n(without(UPPER), "n_upper"),
            n(without(LOWER), "n_lower"),
        )
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``failures``, the bits of the rules that failed."""
    bits = [F.when(F.expr(rule), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, id_col, text_col).withColumn("failures", total)


def passes(p: Policy, failures: Column | None = None) -> Column:
    return (F.col("failures") if failures is None else failures).bitwiseAND(F.lit(p.mask).cast("long")) == 0


def ablations(of: DataFrame, p: Policy) -> DataFrame:
    """For each rule of the policy: documents it fails, and those that it alone rejects.

    Aggregates first by bit pattern, of which there are 2 to the number of rules at
    most, whatever the corpus.
    """
    patterns = of.groupBy(F.col("failures").bitwiseAND(F.lit(p.mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    names = list(RULES)
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in p.rules))
    each = patterns.select("bits", "n", F.inline(rules))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("alone"),
        F.sum("n").alias("documents"),
    )


def rule_report(docs: DataFrame) -> DataFrame:
    got = ledger(docs)
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(policy("base"))).alias("base_failed"),
        passes(policy("web")).alias("kept"),
        "failures",
    )
