"""Quality rules [native]: adaptive thresholds from mergeable quantile sketches, then a joined filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WS, cut, words_of

#: Base rules that the contract fixes.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"

#: Adaptive measures, in thousandths but for the mean word length, in tenths.
MEASURES = ["symbol_pm", "upper_pm", "dup_line_pm", "repeat_pm", "mean_len_10"]
#: A sketch is split where its two parts explain this share of its variance: more than halves of an even spread do.
SPLIT_NUM, SPLIT_DEN = 3, 4
#: A threshold is an upper quantile: one in TAIL documents of the group lies above it at most. What more do is no exception.
TAIL = 4
#: Documents' worth of its language's threshold that a source's leans on, and a language's of the one of all.
LEAN = 100


def _covered(starts: Column) -> Column:
    """Words in the union of three-word windows that begin at the sorted ``starts``."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last")),
        lambda s, x: F.struct((s["sum"] + F.least(F.lit(3), x - s["last"])).alias("sum"), x.alias("last")),
        lambda s: s["sum"],
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: the contract's counts, ``base_failed`` and the adaptive measures."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(lang_col), F.lit("")).alias("_lang"),
        F.coalesce(F.col(source_col), F.lit("")).alias("_source"),
        words_of(F.col(text_col)).alias("_w"),
        F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(WS)) != "").alias("_l"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long").alias("_upper"),
    )
    n = F.size("_w")
    # Equal windows meet in a sort of plain longs: 40 bits of the window's hash over 24 bits of its place.
    # A text passes for free of repeats only if no two hashes agree; where some do, the words decide.
    tri = F.transform(F.slice("_w", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)))
    keyed = F.sort_array(F.transform("_t", lambda x, i: F.shiftleft(F.shiftright(x, 24), 24).bitwiseOR(i.cast("long"))))
    same = lambda a, b: F.shiftright(a, 24) == F.shiftright(b, 24)
    twins = F.filter(
        "_k",
        lambda x, i: ((i > 0) & F.coalesce(same(F.get("_k", i - 1), x), F.lit(False))) | F.coalesce(same(F.get("_k", i + 1), x), F.lit(False)),
    )
    places = F.sort_array(F.transform("_k", lambda x: x.bitwiseAND(F.lit((1 << 24) - 1)).cast("int")))
    shown = lambda i: F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    # longest first: texts of over 2^24 words, or hashes that agree without equal words, are settled by the words themselves
    said = F.array_sort(F.transform("_p", lambda i: F.struct(shown(i).alias("g"), i.alias("i"))))
    twice = F.filter(
        "_p",
        lambda x, i: ((i > 0) & F.coalesce(F.get("_p", i - 1)["g"] == x["g"], F.lit(False))) | F.coalesce(F.get("_p", i + 1)["g"] == x["g"], F.lit(False)),
    )
    starts = F.sort_array(F.transform("_p", lambda x: x["i"]))
    every = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    counted = (
        base.withColumn("_t", tri)
        .withColumn("_k", F.when(n < (1 << 24), keyed).otherwise(F.array().cast("array<bigint>")))
        .withColumn("_k", twins)
        .withColumn("_p", F.when(n < (1 << 24), places).otherwise(every))
        .withColumn("_p", said)
        .withColumn("_p", twice)
        .withColumn("_p", starts)
        .withColumn("_letters", F.length(F.array_join("_w", "")).cast("long"))
        .select(
            "doc_id",
            "_lang",
            "_source",
            n.cast("long").alias("n_words"),
            F.col("_letters").alias("word_chars"),
            "n_symbols",
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            F.when(F.size("_p") == 0, 0).otherwise(_covered(F.col("_p"))).cast("long").alias("n_repeat_words"),
            F.size("_l").alias("_n_lines"),
            "_upper",
        )
    )
    share = lambda a, b: F.expr(f"coalesce({a} * 1000 div nullif({b}, 0), 0)")
    return counted.select(
        "doc_id",
        "_lang",
        "_source",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_pm"),
        share("_upper", "word_chars").alias("upper_pm"),
        share("n_dup_lines", "_n_lines").alias("dup_line_pm"),
        share("n_repeat_words", "n_words").alias("repeat_pm"),
        F.expr("coalesce(word_chars * 10 div nullif(n_words, 0), 0)").alias("mean_len_10"),
    )


def bucket(v: Column) -> Column:
    """Log-linear bucket of a whole number >= 0: exact below 64, then 32 buckets for each power of two."""
    width = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(32 * width + F.call_function("shiftright", v, width))


def bucket_floor(b: Column) -> Column:
    """Smallest value of a bucket."""
    width = F.expr("0") + F.floor(b / 32).cast("int") - 1
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", (b - 32 * width).cast("long"), width))


def sketches(measured: DataFrame) -> DataFrame:
    """Quantile sketches as bucket counts per (language, source, measure).

    Adding counts merges two sketches whatever their order, so partial sums before the shuffle, retried
    tasks and any partitioning give the same thresholds; a sketch has at most 32 buckets a power of two.
    """
    points = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), bucket(F.col(m)).alias("b")) for m in MEASURES])).alias("x")
    sound = measured.where(~F.col("base_failed"))
    return sound.select("_lang", "_source", points).groupBy("_lang", "_source", F.col("x.m").alias("m"), F.col("x.b").alias("b")).agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m, total, fence): where a group's sketch falls into two parts, or its largest value where it does not.

    The level of the threshold quantile is not fixed: it is the one at which cutting the sketch in two leaves the
    least variance inside the parts (Otsu 1979, on bucket counts) among those with one in TAIL documents above or fewer, and it holds only if the parts explain
    SPLIT_NUM / SPLIT_DEN of the variance or more. The fence lies half-way between the two buckets at the cut. Sums are whole numbers, so
    any order of merging gives the same fence. A sketch has some hundred buckets, whatever its documents.
    """
    up_to = Window.partitionBy(*keys, "m").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_order = Window.partitionBy(*keys, "m").orderBy("b")
    all_of = Window.partitionBy(*keys, "m")
    v, wide = F.col("v"), "decimal(38,0)"
    ranked = sketch.withColumn("v", bucket_floor(F.col("b")).cast("long")).select(
        *keys,
        "m",
        "v",
        (bucket_floor(F.col("b") + 1).cast("long") - 1).alias("end"),
        F.lead("v").over(in_order).alias("next"),
        F.sum("n").over(up_to).cast("double").alias("w0"),
        F.sum(F.col("n") * v).over(up_to).cast("double").alias("s0"),
        F.sum("n").over(all_of).alias("total"),
        F.sum(F.col("n") * v).over(all_of).cast("double").alias("s"),
        F.sum((F.col("n") * v).cast("decimal(19,0)") * v.cast("decimal(19,0)")).over(all_of).cast(wide).cast("double").alias("q"),
    )
    w = F.col("total").cast("double")
    apart = F.col("s") * F.col("w0") - w * F.col("s0")
    upper = F.col("next").isNotNull() & (TAIL * (w - F.col("w0")) <= w)
    between = F.when(upper, apart * apart / (w * F.col("w0") * (w - F.col("w0"))))
    spread = F.col("q") - F.col("s") * F.col("s") / w
    best = ranked.groupBy(*keys, "m").agg(
        F.max(F.struct(between.alias("between"), (-v).alias("low"), "end", "next")).alias("x"), F.max("end").alias("top"), F.max("total").alias("total"), F.max(spread).alias("spread")
    )
    clear = F.coalesce(SPLIT_DEN * F.col("x.between") >= SPLIT_NUM * F.col("spread"), F.lit(False))
    return best.select(*keys, "m", "total", F.when(clear, F.expr("(x.next + x.end) div 2")).otherwise(F.col("top")).alias("fence"))


def _leaning(own: str, total: str, broader: str) -> Column:
    return F.expr(f"({total} * {own} + {LEAN} * {broader}) div ({total} + {LEAN})")


def thresholds(measured: DataFrame) -> DataFrame:
    """One row per (language, source) with a fence for each measure.

    A source's fence is a mean of its own and its language's, weighted by its documents and LEAN; a language's
    leans on that of all documents in the same way.
    """
    own = cut(sketches(measured))
    by_lang = own.groupBy("_lang", "m", "b").agg(F.sum("n").alias("n"))
    of_all = own.groupBy("m", "b").agg(F.sum("n").alias("n"))
    named = lambda df, k: df.withColumnRenamed("fence", f"{k}_fence").withColumnRenamed("total", f"{k}_total")
    lang = named(_fences(by_lang, ["_lang"]), "lang").join(named(_fences(of_all, []), "all"), "m")
    lang = lang.select("_lang", "m", _leaning("lang_fence", "lang_total", "all_fence").alias("lang_fence"))
    fences = _fences(own, ["_lang", "_source"]).join(lang, ["_lang", "m"]).select("_lang", "_source", "m", _leaning("fence", "total", "lang_fence").alias("fence"))
    return fences.groupBy("_lang", "_source").agg(*[F.max(F.when(F.col("m") == m, F.col("fence"))).alias(f"{m}_max") for m in MEASURES])


def quality_rules(docs: DataFrame, **columns: str) -> DataFrame:
    """Judge every document by fixed base rules, then by thresholds of its own language and source.

    ``kept`` is false where the base rules fail or where a measure lies above the fence of its language and source.
    The fences come from the data alone: a group in which nothing stands apart has its largest value as fence. Null text: no
    words, base fails. Null language or source: one group of their own, with empty ones. Repeated rows
    are judged each. Empty table: empty result. Extra columns are ignored. ``columns`` names other
    columns (``id_col``, ``text_col``, ``lang_col``, ``source_col``).
    """
    measured = cut(measure(docs, **columns))
    joined = measured.join(thresholds(measured), ["_lang", "_source"], "left")
    above = F.lit(False)
    for m in MEASURES:
        above = above | F.coalesce(F.col(m) > F.col(f"{m}_max"), F.lit(False))
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~above).alias("kept"),
        *MEASURES,
    )
