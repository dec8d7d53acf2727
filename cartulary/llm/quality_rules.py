"""Quality rules: counts of a text, and how far its histograms diverge from language references.

Everything is a DataFrame expression. ``measure`` makes one narrow pass over the texts; ``references`` sums the
histograms of all documents by language (one row a language); ``judge`` compares each document with them.

The verdict: a document's character classes and its common words are two histograms. For each language the
Jensen-Shannon distance (square root of the divergence in bits, 0 to 1) of each to that language's reference is taken;
the language that fits best on average counts. The histogram of n words strays from its reference by chance, about as 1 / sqrt(n);
so the largest distance that is kept is a constant plus a share of 1 / sqrt(n), and a text of fewer than ``min_words``
words is not held against any distance (the base rules have failed it).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.shared import SPACE_CLASS, Scratch, table, words

#: Frequent function words of four languages.
COMMON_WORDS = {
    "de": ("der", "die", "das", "und", "in", "zu", "den", "von", "mit", "ist", "ein", "auf"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "with"),
    "es": ("el", "la", "de", "que", "y", "en", "los", "se", "del", "las", "por", "con"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "que", "pour", "dans", "est"),
}
VOCABULARY = tuple(sorted({w for ws in COMMON_WORDS.values() for w in ws}))

#: Counted character classes as Java regular expressions. White space comes from the words, and what is
#: left (small letters above all) is the last class.
CLASSES = (
    ("upper", r"\p{Lu}"),
    ("digit", r"\p{Nd}"),
    ("stop", r"[.,;:!?'\"()\-]"),
    ("symbol", r"[#*$%&|<>]"),
)
N_CLASSES = len(CLASSES) + 2
LONGEST_COMMON = max(map(len, VOCABULARY)) + 1  # with a stop behind it


@dataclass(frozen=True)
class Limits:
    """min_words, repeat_percent: the base rules. The pairs: the constant and the share of 1 / sqrt(n_words) that make
    the largest Jensen-Shannon distance that is kept."""

    min_words: int = 50
    repeat_percent: int = 50
    class_limit: tuple[float, float] = (0.10, 1.30)
    word_limit: tuple[float, float] = (0.10, 1.85)


def _found(text: Column, pattern: str) -> Column:
    """Characters of a class; a text without any is only searched."""
    return F.when(text.rlike(pattern), F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))).otherwise(0)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_counts and word_counts.

    A null text counts as empty; an empty text has zero everywhere. Other columns stay; those named as added ones are
    replaced.

    Words in repeated 3-word windows: windows are 64-bit hashes; where some repeat, they are sorted with their
    positions, equal ones are neighbours, and the positions that are covered are summed in order.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    w, h, s = F.col("_words"), F.col("_windows"), F.col("_sorted")
    d = docs.withColumn("_words", words(F.col(text)))
    d = d.withColumn(
        "_windows",
        F.when(
            F.size(w) >= 3,
            F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))),
        ),
    )
    d = d.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct(h)) < F.size(h),
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
        ),
    )
    same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
    d = d.withColumn("_positions", F.array_sort(F.transform(F.filter(s, same), lambda x: x["p"])))
    covered = F.aggregate(
        F.col("_positions"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + 3 - F.greatest(a["end"] - p, F.lit(0))).alias("n")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    short = F.lower(F.array_join(F.filter(w, lambda x: F.length(x) <= LONGEST_COMMON), "  "))
    d = d.withColumns(
        {
            "_lines": lines,
            "_class_known": F.array(*[_found(t, p).cast("double") for _, p in CLASSES]),
            "_common": F.concat(F.lit(" "), F.regexp_replace(short, "[.,;:!?]+", ""), F.lit(" ")),
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    )
    spaces = (F.length(t) - F.col("word_chars")).cast("double")
    total = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x)
    d = d.withColumns(
        {
            "n_symbols": F.get("_class_known", F.lit(len(CLASSES) - 1)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "class_counts": F.concat("_class_known", F.array(spaces, F.col("word_chars") - total("_class_known"))),
            "_word_known": F.array(
                *[
                    (F.length("_common") - F.length(F.replace("_common", F.lit(f" {x} "), F.lit("")))).cast("double") / (len(x) + 2)
                    for x in VOCABULARY
                ]
            ),
        }
    )
    d = d.withColumn("word_counts", F.concat("_word_known", F.array(F.col("n_words") - total("_word_known"))))
    return d.drop("_words", "_windows", "_sorted", "_positions", "_lines", "_class_known", "_common", "_word_known")


def failed(limits: Limits) -> Column:
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))


def _shares(counts: str) -> Column:
    total = F.aggregate(F.col(counts), F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.col(counts), lambda x: x / F.greatest(total, F.lit(1.0)))


def references(measured: DataFrame, lang: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """One row a language: the mean class and word shares of all its documents that pass the base rules.

    Rows without a language make no reference; an empty table makes none at all.
    """
    shares = measured.where(F.col(lang).isNotNull() & ~failed(limits)).select(
        F.col(lang).alias("ref_lang"), _shares("class_counts").alias("c"), _shares("word_counts").alias("w")
    )
    return shares.groupBy("ref_lang").agg(
        F.array(*[F.avg(F.get("c", F.lit(i))) for i in range(N_CLASSES)]).alias("ref_classes"),
        F.array(*[F.avg(F.get("w", F.lit(i))) for i in range(len(VOCABULARY) + 1)]).alias("ref_words"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits of two histograms given as shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def judge(measured: DataFrame, refs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds base_failed, class_distance, word_distance, best_lang and kept.

    The references are one small row a language, gathered into one array, so each document meets all of them without
    a join by key. Without any reference the distances are null and only the base rules decide.
    """
    gathered = refs.agg(F.sort_array(F.collect_list(F.struct("ref_lang", "ref_classes", "ref_words"))).alias("_refs"))
    d = measured.withColumns({"_c": _shares("class_counts"), "_w": _shares("word_counts")}).join(F.broadcast(gathered), how="cross")
    fits = F.transform(
        "_refs",
        lambda r: F.struct(
            js_distance(F.col("_c"), r["ref_classes"]).alias("class_distance"),
            js_distance(F.col("_w"), r["ref_words"]).alias("word_distance"),
            r["ref_lang"].alias("lang"),
        ),
    )
    best = F.array_min(
        F.transform(F.col("_fits"), lambda f: F.struct((f["class_distance"] + f["word_distance"]).alias("sum"), f.alias("fit")))
    )["fit"]
    d = d.withColumn("_fits", fits).withColumn("_best", best)
    noise = 1 / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    diverges = (F.col("n_words") >= limits.min_words) & (
        (F.col("class_distance") > limits.class_limit[0] + limits.class_limit[1] * noise)
        | (F.col("word_distance") > limits.word_limit[0] + limits.word_limit[1] * noise)
    )
    d = d.withColumns(
        {
            "base_failed": failed(limits),
            "class_distance": F.col("_best.class_distance"),
            "word_distance": F.col("_best.word_distance"),
            "best_lang": F.col("_best.lang"),
        }
    )
    return d.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(diverges, F.lit(False))).drop(
        "_c", "_w", "_refs", "_fits", "_best"
    )


def apply_rules(docs: DataFrame, scratch, limits: Limits = Limits(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measures ``docs`` once, writes the counts, learns the references from them and judges every document.

    ``docs`` needs text and lang. Only ``keep`` and the counts are written, never the texts.
    """
    measured = scratch.write(measure(docs.select(*keep, "text", F.col("lang").alias("_lang"))).drop("text"))
    return judge(measured, references(measured, "_lang", limits), limits).drop("_lang")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), Scratch(spark, "op10"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"), "best_lang",
    )
