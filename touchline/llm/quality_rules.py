"""Operator 7: document quality rules, compiled from a table into one projection without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
#: Words of a window, and the words below which a text fails.
WINDOW, LEAST_WORDS = 8, 20
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which "
    "le la les de des du et en un une que qui dans pour pas sur au avec est par "
    "der die das und den von zu mit sich ist nicht ein eine auf als auch es an für im dem "
    "el los las del y se no una su con lo para al como más o pero sus"
).split()

#: name, ratio of two base columns, lower and upper bound (None: open).  All must hold for a text to be kept.
THRESHOLDS: list[tuple[str, str, str, float | None, float | None]] = [
    ("mean_word_chars", "word_chars", "n_words", 2.0, 14.0),
    ("symbol_share", "n_symbols", "n_words", None, 0.5),
    ("stop_word_share", "n_stop_words", "n_words", 0.05, None),
    ("dup_line_share", "n_dup_lines", "n_lines", None, 0.3),
    ("shout_share", "n_shouted", "n_words", None, 0.5),
    ("list_line_share", "n_list_lines", "n_lines", None, 0.9),
]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_windows(df: DataFrame, words: Column, k: int, name: str = "windows") -> DataFrame:
    """Add the hash of each run of k words.

    Word hashes become a column of their own first: they are read k times, so the optimizer keeps that projection
    apart and texts are split once.  Lambdas see only their own element, never a whole array, so the cost stays linear
    however expressions are moved."""
    hashed = df.withColumn("_hashes", F.transform(words, lambda w: F.xxhash64(w)))
    length = F.greatest(F.size("_hashes") - (k - 1), F.lit(0))
    sides = F.arrays_zip(*[F.slice("_hashes", j + 1, length).alias(f"w{j}") for j in range(k)])
    return hashed.withColumn(name, F.transform(sides, lambda x: F.xxhash64(*[x[f"w{j}"] for j in range(k)]))).drop("_hashes")


def _repeated_words(windows: Column) -> Column:
    """Words that lie in a window found twice or more in the text.

    Window hashes are sorted with their places; equal neighbours are repeats.  Repeats sorted by place then cover
    the distance to the next repeat, or a whole window if that is less.  Sorting keeps long texts at n log n.
    """
    n = F.size(windows)
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    before, after = F.concat(none, F.slice(ordered, 1, F.greatest(n - 1, F.lit(0)))), F.concat(F.slice(ordered, 2, n), none)
    sides = F.arrays_zip(ordered.alias("own"), before.alias("before"), after.alias("after"))
    twice = F.filter(sides, lambda x: x["own"]["h"].eqNullSafe(x["before"]["h"]) | x["own"]["h"].eqNullSafe(x["after"]["h"]))
    places = F.array_sort(F.transform(twice, lambda x: x["own"]["i"]))
    state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))
    covered = F.aggregate(
        places,
        state,
        lambda s, i: F.struct((i + WINDOW).alias("end"), (s["sum"] + WINDOW - F.greatest(s["end"] - i, F.lit(0))).cast("long").alias("sum")),
        lambda s: s["sum"],
    )
    # few texts repeat anything: a hash set decides that, and the rest is sorted
    return F.when(n > F.size(F.array_distinct(windows)), covered).otherwise(F.lit(0).cast("long"))


def base_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of a text that the rules compare."""
    bare = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = bare.withColumns({"words": words_of(F.col("text")), "lines": F.filter(F.split("text", r"\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    words, lines = F.col("words"), F.col("lines")
    return with_windows(split, words, WINDOW).select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("windows")).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter(words, lambda w: w.rlike("^[A-Z]{2,}"))).cast("long").alias("n_shouted"),
        F.size(F.filter(lines, lambda x: x.contains(" | "))).cast("long").alias("n_list_lines"),
    )


def quality_rules(docs: DataFrame, thresholds: list[tuple] = THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts, base_failed, kept of every row; ratios with nothing to divide by are 0.

    Null texts count as empty and fail for want of words.  Rows with repeated or null ids are judged each; other
    columns are ignored; an empty table gives no rows; very long texts are judged whole, at n log n.
    """
    base = base_columns(docs, id_col, text_col)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept = ~failed
    for _, over, under, low, high in thresholds:
        ratio = F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))
        if low is not None:
            kept = kept & (ratio >= low)
        if high is not None:
            kept = kept & (ratio <= high)
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"))
