"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import compute_once, replace_columns, without_spaces, words

SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to a in is that it for was on with as be by at this are from or an",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur",
    "es": "de la que el en y a los del se las por un para con no una su al lo",
}


@dataclass(frozen=True)
class Rule:
    """Reject a text unless low <= measure <= high; a limit of None is open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Two of the limits are the base rules of the result contract; the others are lenient by design, as a clean text
#: must never go.
RULES = (
    Rule("few_words", "n_words", low=50),
    Rule("repeated_words", "repeat_ratio", high=0.5),
    Rule("word_length", "mean_word_chars", low=2.5, high=12),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
)
BASE = ("few_words", "repeated_words")


def _windows(w: Column) -> Column:
    """One hash per window of three words."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n >= 3, hashes).otherwise(F.array().cast("array<bigint>"))


def _repeats(h: Column) -> Column:
    """Words in windows that occur twice or more, from the hashes of a text's windows.

    Where a hash repeats, hashes are sorted with their places and equal neighbours are repeats, so cost is n log n for
    any text.
    """

    def covered(s: Column) -> Column:
        twice = F.filter(
            F.transform(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda j: F.when(
                    F.coalesce(F.get(s, j)["h"] == F.get(s, j - 1)["h"], F.lit(False))
                    | F.coalesce(F.get(s, j)["h"] == F.get(s, j + 1)["h"], F.lit(False)),
                    F.get(s, j)["i"],
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))

    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    # sorted once: a lambda over an array of one names the sorted array
    repeats = F.get(F.transform(F.array(placed), covered), F.lit(0))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(repeats)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of every whole text; null text counts as empty. Columns of the same names are replaced."""
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words"]
    docs = replace_columns(docs, [*names, "__h", "__w", "__l"])
    t = F.coalesce(F.col(text), F.lit(""))
    plain = t
    for s in SYMBOLS:
        plain = F.replace(plain, F.lit(s), F.lit(""))
    stop = sorted({w for line in STOP_WORDS.values() for w in line.split()})
    with_lines = F.filter(F.split(t, "\n"), lambda x: F.length(without_spaces(x)) > 0)
    bare = F.transform("__w", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))))
    parts = compute_once(compute_once(docs, {"__w": words(t), "__l": with_lines}), {"__h": _windows(F.col("__w"))})
    measured = compute_once(parts, {
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(without_spaces(t)).cast("long"),
        "n_symbols": (F.length(t) - F.length(plain)).cast("long"),
        "n_lines": F.size("__l").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": _repeats(F.col("__h")).cast("long"),
        "n_stop_words": F.size(F.array_intersect(bare, F.array(*[F.lit(w) for w in stop]))).cast("long"),
    })
    return measured.drop("__w", "__l", "__h")


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add measures, ratios, ``failed`` (names of broken rules), ``base_failed`` and ``kept`` to every row.

    The table of rules becomes one projection of built-in functions: no shuffle, no user code, one pass. Null, empty
    and blank texts have zero measures and fail ``few_words``; a ratio over nothing is 0. Repeated rows are judged
    alike; an empty table gives no rows; input columns that clash with a result are replaced by it.
    """
    ratios = ["mean_word_chars", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "failed", "base_failed", "kept"]
    df = measures(replace_columns(docs, ratios), text)

    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))

    df = df.withColumns({
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
    })

    def broken(r: Rule) -> Column:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.measure) < r.low)
        if r.high is not None:
            bad = bad | (F.col(r.measure) > r.high)
        return F.when(bad, F.lit(r.name))

    df = df.withColumn("failed", F.array_compact(F.array(*[broken(r) for r in rules])))
    base = F.arrays_overlap("failed", F.array(*[F.lit(n) for n in BASE]))
    return df.withColumn("base_failed", base).withColumn("kept", F.size("failed") == 0)
