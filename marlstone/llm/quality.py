"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = ("the", "of", "and", "to", "in", "a", "is", "that", "it", "on", "was", "with", "for", "le", "la", "les", "des",
              "et", "un", "une", "est", "que", "en", "der", "die", "das", "und", "ein", "zu", "ist", "den", "von", "mit",
              "el", "los", "las", "de", "y", "por", "con", "se", "del")


@dataclass(frozen=True)
class Rule:
    """Reject a text whose ``measure`` lies outside [low, high]; None: no bound on that side."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Thresholds over and above the base rules. Ratios have n_words or n_lines below them.
RULES = (
    Rule("n_words", low=50, high=100_000),
    Rule("mean_word_chars", low=2, high=20),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.5),
)


def _within(value: Column, body) -> Column:
    """``body`` of ``value`` with the value worked out once (a lambda variable)."""
    return F.transform(F.array(value), body)[0]


#: Bits of a packed window that hold its place; the others are its hash.
PLACE_BITS = 24


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are sorted as whole numbers, hash above place, so that equal ones stand side by side; neighbours
    with one hash are confirmed on their words, and the places that repeated windows cover are counted. Should
    different windows share a hash, or places not fit, the windows themselves are sorted.
    n log n, also for very long texts.
    """
    def count(w):
        n = F.size(w)
        packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.shiftleft(F.xxhash64(w[i], w[i + 1], w[i + 2]), PLACE_BITS).bitwiseOR(i.cast("long")))
        fast = _within(F.sort_array(packed), lambda s: _within(_neighbours(s), lambda k: confirmed(w, s, k)))
        return F.when(n < 4, 0).when(n > 1 << PLACE_BITS, _covered_by_words(w)).otherwise(fast)

    def _neighbours(s):
        return F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda k: F.shiftright(s[k - 1], PLACE_BITS) == F.shiftright(s[k], PLACE_BITS))

    def confirmed(w, s, k):
        place = lambda i: s[i].bitwiseAND((1 << PLACE_BITS) - 1).cast("int")
        differ = lambda x, y: (w[x] != w[y]) | (w[x + 1] != w[y + 1]) | (w[x + 2] != w[y + 2])
        clash = F.exists(k, lambda i: differ(place(i - 1), place(i)))
        at = F.array_union(F.transform(k, lambda i: place(i - 1)), F.transform(k, place))
        return F.when(F.size(k) == 0, 0).when(clash, _covered_by_words(w)).otherwise(_within(at, _covered))

    return _within(words, count)


def _covered(at: Column) -> Column:
    """Number of words in the windows that begin at the places."""
    return F.size(F.array_union(F.array_union(at, F.transform(at, lambda x: x + 1)), F.transform(at, lambda x: x + 2)))


def _covered_by_words(w: Column) -> Column:
    """Words inside repeated windows, by sorting windows of words."""
    n = F.size(w)
    windows = F.arrays_zip(F.slice(w, 1, n - 2).alias("a"), F.slice(w, 2, n - 2).alias("b"), F.slice(w, 3, n - 2).alias("c"), F.sequence(F.lit(1), n - 2).alias("at"))

    def marked(s):
        pairs = F.arrays_zip(F.slice(s, 1, F.size(s) - 1).alias("x"), F.slice(s, 2, F.size(s) - 1).alias("y"))
        equal = F.filter(pairs, lambda p: (p["x"]["a"] == p["y"]["a"]) & (p["x"]["b"] == p["y"]["b"]) & (p["x"]["c"] == p["y"]["c"]))
        return _within(equal, lambda e: _within(F.array_union(F.transform(e, lambda p: p["x"]["at"]), F.transform(e, lambda p: p["y"]["at"])), _covered))

    return _within(F.sort_array(windows), marked)


def measures(documents: DataFrame) -> DataFrame:
    """The documents as a struct ``_row``, the base counts, and the ratios that RULES names, from whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    d = documents.select(F.struct(*(F.col(quoted(c)) for c in documents.columns)).alias("_row"), text.alias("_text"), words.alias("_words"), lines.alias("_lines"))
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n, n_lines = F.size("_words").cast("long"), F.size("_lines")
    chars = F.length(F.translate("_text", BLANKS, "")).cast("long")
    symbols = (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long")
    dup = (n_lines - F.size(F.array_distinct("_lines"))).cast("long")
    stops = n - F.size(F.filter("_words", lambda w: ~F.lower(w).isin(*STOP_WORDS)))
    return d.select(
        "_row", n.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), dup.alias("n_dup_lines"),
        _repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        per(chars, n).alias("mean_word_chars"), per(symbols, n).alias("symbol_ratio"), per(stops, n).alias("stop_word_ratio"),
        per(dup, n_lines).alias("dup_line_ratio"),
        per(F.size(F.filter("_lines", lambda x: F.ltrim(x).rlike("^[-*•]"))), n_lines).alias("bullet_line_ratio"),
        per(F.size(F.filter("_lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))), n_lines).alias("ellipsis_line_ratio"),
    )


def quality_rules(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Judge every whole text: base counts, base_failed, kept, and the rules it fails.

    Null or empty text has no words, so base_failed holds and it is not kept. Rows are judged each
    for itself: a null doc_id stays null and repeated rows give repeated results. Extra columns are
    not read. One projection over the scan: no shuffle and no Python.
    """
    d = _judged(documents.select("doc_id", "text"), rules)
    return d.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def _judged(documents: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``measures`` with base_failed, failed_rules and kept."""
    failed = F.array_compact(F.array(*[
        F.when(((F.col(r.measure) < r.low) if r.low is not None else F.lit(False)) | ((F.col(r.measure) > r.high) if r.high is not None else F.lit(False)), F.lit(r.measure)) for r in rules]))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(documents).withColumns({"base_failed": base, "failed_rules": failed}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def filter_documents(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns, whatever their names; the same projection, then a filter.

    Null and empty texts do not pass; a null doc_id is judged by its text; repeated rows stay or go together;
    an empty table gives no rows.

    The verdict passes through ``explode``, which a filter is not pushed below: pushed into the
    projection, it would work out each measure, and the split into words, at every mention.
    """
    judged = _judged(documents, rules).select("_row", F.explode(F.array("kept")).alias("_passes"))
    return judged.where("_passes").select("_row.*")
