"""Quality rules: a threshold table compiled into one projection of built-in functions.

``RULES`` is data: each row names a measure, a bound and the side on which a text fails.  ``compile_rules`` turns the rows into one
boolean column; the measures themselves are Spark expressions over columns that hold the words and the hashes of their windows, each computed once per row.
No user function, no shuffle, no second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACES, WORD_RE, let, text_of

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages served; a text of prose holds several of some of them.
STOP_WORDS = (
    "the of and to in a is that for it was on are with as by or an be this from at "
    "der die das und ist ein eine nicht zu von den mit im auf für des sich auch es "
    "le la les de et des un une est que qui dans pour en il ne pas sur au du "
    "el los las y un una es que en no se del por con para su al"
).split()

#: (measure, side on which it fails, bound): fixed here, replaceable by the caller. Ratios are per word or per line.
RULES: tuple[tuple[str, str, float], ...] = (
    ("n_words", "<", 50),
    ("mean_word_chars", "<", 2.0),
    ("mean_word_chars", ">", 15.0),
    ("symbol_ratio", ">", 0.05),
    ("n_stop_words", "<", 2),
    ("stop_word_ratio", "<", 0.06),
    ("dup_line_ratio", ">", 0.5),
    ("repeat_ratio", ">", 0.5),
)


def _windows(words: Column) -> Column:
    """Hashes of all 3-word windows, in order."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def _mask(n: Column) -> Column:
    """The least number of the form 2^b - 1 from n on, as a long."""
    return (F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n))) - 1).cast("long")


def _repeat_words(words: Column, windows: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more, each word once.

    A text without equal hashes has none.  Elsewhere a window's hash and place share one number (the place in the low bits, as many as the text needs), which is sorted; only windows whose hash
    comes again there are compared in full, with their words, and the places of those found are merged: O(n log n) in the length of the text.
    """

    def covered(h: Column, mask: Column) -> Column:
        # The mask has as many bits as places need.
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))
        near = lambda x, y: x.bitwiseXOR(y).between(F.lit(0).cast("long"), mask)

        def again(s: Column) -> Column:
            m = F.size(s)
            twice = F.filter(s, lambda x, k: ((k > 0) & near(x, F.get(s, F.greatest(k - 1, F.lit(0))))) | ((k < m - 1) & near(x, F.get(s, F.least(k + 1, m - 1)))))
            return F.sort_array(F.transform(twice, lambda x: let(x.bitwiseAND(mask).cast("int"), lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i")))))

        def same(x: Column, y: Column) -> Column:
            return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

        def pick(o: Column) -> Column:
            m = F.size(o)
            twice = F.filter(o, lambda x, k: ((k > 0) & same(x, F.get(o, F.greatest(k - 1, F.lit(0))))) | ((k < m - 1) & same(x, F.get(o, F.least(k + 1, m - 1)))))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def merged(p: Column) -> Column:
            gaps = F.transform(p, lambda x, k: F.when(k == F.size(p) - 1, F.lit(3)).otherwise(F.least(F.lit(3), F.get(p, k + 1) - x)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda t, g: t + g)

        return let(let(let(packed, again), pick), merged)

    return F.when(F.size(windows) == F.size(F.array_distinct(windows)), F.lit(0).cast("long")).otherwise(let(_mask(F.size(windows)), lambda mask: covered(windows, mask)))


def _measured(text: Column, words: Column, windows: Column) -> Column:
    """All counts of one text as a struct."""
    stop = list(dict.fromkeys(STOP_WORDS))
    bare = lambda w: F.lower(F.translate(w, ".,;:!?", ""))
    is_stop = lambda w: (F.length(w) <= 5) & (F.lower(w).isin(stop) | (F.rlike(w, F.lit("[.,;:!?]")) & bare(w).isin(stop)))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD_RE)))
    return F.struct(
        F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("lines"),
        F.size(F.filter(words, is_stop)).cast("long").alias("n_stop_words"), _repeat_words(words, windows).alias("n_repeat_words"),
    )


def _with_ratios(m: Column) -> Column:
    """The counts of ``_measured`` and the ratios of the rules."""
    per = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    lines = m["lines"]
    return F.struct(
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols")], lines["n_dup_lines"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"), m["n_stop_words"].alias("n_stop_words"),
        per(m["word_chars"], m["n_words"]).alias("mean_word_chars"), per(m["n_symbols"], m["word_chars"]).alias("symbol_ratio"), per(m["n_stop_words"], m["n_words"]).alias("stop_word_ratio"),
        per(lines["n_dup_lines"], lines["n_lines"]).alias("dup_line_ratio"), per(m["n_repeat_words"], m["n_words"]).alias("repeat_ratio"),
    )


def with_measures(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` and a struct of all measures of the text (null counts as empty). Each step is a column of its own, which the optimizer doesn't merge as the next one reads it several times."""
    t, w, k = (f"{name}_{x}" for x in ("text", "words", "windows"))
    out = docs.withColumn(t, text_of(docs, text_col)).withColumn(w, F.regexp_extract_all(F.col(t), F.lit(WORD_RE), F.lit(0)))
    out = out.withColumn(k, _windows(F.col(w))).withColumn(name, _measured(F.col(t), F.col(w), F.col(k)))
    return out.withColumn(name, _with_ratios(F.col(name))).drop(t, w, k)


def unused_name(docs: DataFrame, base: str) -> str:
    """A column name that no column of ``docs`` starts with."""
    while any(c.lower().startswith(base) for c in docs.columns):
        base = f"_{base}"
    return base


def compile_rules(m: Column, rules=RULES) -> Column:
    """True where any rule of the table fails."""
    out = F.lit(False)
    for measure, side, bound in rules:
        out = out | ((m[measure] < F.lit(bound)) if side == "<" else (m[measure] > F.lit(bound)))
    return out


def quality_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per row of ``docs``: id, the counts, base_failed, kept, and the ratios after them.

    Null and empty texts have no words and fail. Repeated rows give repeated rows; other columns are not read.
    """
    out = with_measures(docs.select(docs[id_col].alias(id_col), text_of(docs, text_col).alias("__text")), "__text", "m")
    base = (F.col("m.n_words") < 50) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words"))
    head = [F.col(f"m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    tail = [F.col(f"m.{c}").alias(c) for c in ("n_stop_words", "mean_word_chars", "symbol_ratio", "stop_word_ratio", "dup_line_ratio")]
    return out.select(id_col, *head, base.alias("base_failed"), (~base & ~compile_rules(F.col("m"), rules)).alias("kept"), *tail)


def keep_good(docs: DataFrame, *, text_col: str = "text", rules=RULES) -> DataFrame:
    """``docs`` without the rows that a rule rejects, all columns as they were."""
    name = unused_name(docs, "__m")
    m = with_measures(docs, text_col, name)
    good = ~((F.col(name)["n_words"] < 50) | (100 * F.col(name)["n_repeat_words"] > 50 * F.col(name)["n_words"])) & ~compile_rules(F.col(name), rules)
    # The verdict is generated, so that the filter isn't pushed below the measures and computes them again.
    return m.select(*[m[c] for c in docs.columns], F.explode(F.array(good)).alias(name)).where(F.col(name)).drop(name)
