"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Null and empty texts have zero in every count and fail the base rule. Repeated rows are judged one by
one. Columns besides doc_id and text are never looked at, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import NOT_GAP, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of the four languages.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "aber als an auch auf das dem den der des die ein eine er es für ich im ist mit nach nicht sich sie sind und von zu "
    "au avec ce dans de du elle en est et il la le les ne par pas pour que qui se sur un une "
    "como con del el entre ha las lo los más no para pero por su una y"
).split()


class Rule(NamedTuple):
    """Keep a text while low <= num / den <= high; a ratio over nothing is 0."""

    name: str
    num: str
    den: str
    low: float
    high: float


#: The default table.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 60.0),
    Rule("symbols", "n_symbols", "n_words", 0.0, 0.2),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, 1.0),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.0, 0.5),
)


def _repeated_words(ws: Column) -> Column:
    """Words inside those windows of 8 words that the text holds twice or more, by 64-bit window hashes."""

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            return F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1))

        starts = let(by_hash, lambda s: F.sort_array(F.transform(twice(s), lambda e: e["i"])))
        widths = let(starts, lambda p: F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))))
        total = F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(total)

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, covered))

    return let(ws, of)


def text_counts(texts: DataFrame, *carry: str) -> DataFrame:
    """The columns named in carry, and the counts of column text that the rules divide."""
    text = F.coalesce(F.col("text"), F.lit(""))
    with_words = texts.select(*carry, text.alias("text"), words(F.col("text")).alias("ws"), F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_GAP)).alias("ls"))
    ws, ls = F.col("ws"), F.col("ls")
    counts = {
        "n_words": F.size(ws),
        "word_chars": F.length(F.array_join(ws, "")),
        "n_symbols": F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")),
        "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
        "n_repeat_words": _repeated_words(ws),
        "n_lines": F.size(ls),
        "n_stop_words": F.size(F.filter(ws, lambda w: w.isin(*STOP_WORDS))),
    }
    return with_words.select(*carry, *[c.cast("long").alias(n) for n, c in counts.items()])


BASE_FAILED = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"


def verdicts(rules: tuple[Rule, ...] = RULES) -> dict[str, str]:
    """The table as SQL conditions, one for each rule; products instead of quotients, so that nothing is divided by zero."""
    return {r.name: f"({r.num} >= {r.low!r} * {r.den} AND {r.num} <= {r.high!r} * {r.den})" for r in rules}


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of docs: doc_id, the counts, base_failed, kept and a flag for each rule."""
    flags = verdicts(rules)
    kept = " AND ".join([f"NOT {BASE_FAILED}", *flags.values()])
    first = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return text_counts(docs.select("doc_id", "text"), "doc_id").select(
        "doc_id", *first, F.expr(BASE_FAILED).alias("base_failed"), F.expr(kept).alias("kept"), "n_lines", "n_stop_words", *[F.expr(c).alias(f"rule_{n}") for n, c in flags.items()]
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    names = docs.columns
    counted = text_counts(docs.select("text", F.struct(*names).alias("row__")), "row__")
    kept = " AND ".join([f"NOT {BASE_FAILED}", *verdicts(rules).values()])
    return counted.where(F.expr(kept)).select(*[F.col("row__")[n].alias(n) for n in names])
