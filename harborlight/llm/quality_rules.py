"""Quality rules with thresholds that the corpus sets itself (DataFrame functions only).

Fixed cutoffs on symbol share or word length fit one language and one source
badly. Here every feature is summarised per (language, source) by a mergeable
quantile sketch, and each document is held against fences from the quartiles of
its own group.

The sketch is a histogram over value ranges whose width follows the value: exact
below 64, then 32 ranges per power of two, so a quantile is off by 1/32 of its
value at most. Sketches merge by adding counts: partial aggregation combines
them on the map side, a hot source costs no more than any other, and a group
with few documents falls back to the merged sketch of its language, then to
that of the whole corpus. All arithmetic is on integers, so results don't
depend on the order of rows or on the engine.

The fences are joined to all rows: broadcast where ``FEW`` groups or fewer were
counted, otherwise by a shuffle of two stored tables, where a hot group's
partition can be split.

Defined results: null text counts as no words (base_failed); null language or
source form their own groups; repeated rows are judged separately; a value at a
fence is kept; an empty table gives an empty table; texts of any length are taken
whole, as one value of a row. Other columns, whatever their names, are not looked
at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Documents that a group needs for fences of its own.
MIN_GROUP = 200
#: Groups whose fences (eight integers each) are broadcast.
FEW = 50_000
#: Fences lie this many quartile ranges beyond the quartiles.
REACH = 4
#: Feature -> smallest quartile range assumed (in the feature's own unit).
FEATURES = {"f_len": 60, "f_sym": 100, "f_dup": 100, "f_rep": 60}


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts per document: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    raw = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    split = raw.select(
        "doc_id", "lang", "source",
        F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')").alias("words"),
        F.expr(r"regexp_count(text, '[#*$%&|<>]')").cast("long").alias("n_symbols"),
        F.expr(r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
    )
    counted = split.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "if(size(words) < 3, cast(array() as array<bigint>),"
            " transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])))"
        ).alias("windows"),
    )
    # Only a text with some repeated window pays for the sort.
    repeated = counted.withColumn(
        "starts",
        F.expr(
            "case when size(windows) = size(array_distinct(windows)) then cast(array() as array<int>) else"
            " transform(array(sort_array(transform(windows, (h, i) -> struct(h, i)))), s ->"
            "  sort_array(array_distinct(flatten(zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1),"
            "   (a, b) -> if(a.h = b.h, array(a.i, b.i), cast(array() as array<int>)))))))[0] end"
        ),
    )
    return repeated.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.expr(
            "aggregate(starts, struct(0L as n, -3 as last),"
            " (acc, p) -> struct(acc.n + least(3, p - acc.last) as n, p as last), acc -> acc.n)"
        ).cast("long").alias("n_repeat_words"),
    )


def _bucket(x: str) -> str:
    """Index of the sketch range that holds the integer x >= 0."""
    shift = f"(length(bin({x})) - 6)"
    return f"if({x} < 64, cast({x} as int), cast(32 * {shift} + shiftright({x}, {shift}) as int))"


def _low(b: str) -> str:
    """Least value of range b."""
    return f"if({b} < 64, cast({b} as bigint), shiftleft(cast(pmod({b}, 32) + 32 as bigint), cast(({b} - 32) div 32 as int)))"


def fences(feats: DataFrame, min_group: int = MIN_GROUP, reach: int = REACH) -> DataFrame:
    """(g_lang, g_source, lo_*, hi_*) for every group that occurs, from merged sketches."""
    pairs = feats.where("not base_failed").select(
        "g_lang", "g_source",
        F.expr("stack({}, {}) as (feature, x)".format(len(FEATURES), ", ".join(f"'{f}', {f}" for f in FEATURES))),
    )
    sketch = pairs.groupBy("g_lang", "g_source", "feature", F.expr(_bucket("x")).alias("b")).agg(F.count("*").alias("n"))
    levels = (
        sketch.select("g_lang", "g_source", "feature", "b", "n", F.lit(0).alias("level"))
        .union(sketch.select("g_lang", F.lit(""), "feature", "b", "n", F.lit(1)))
        .union(sketch.select(F.lit(""), F.lit(""), "feature", "b", "n", F.lit(2)))
        .groupBy("level", "g_lang", "g_source", "feature", "b").agg(F.sum("n").alias("n"))
    )
    # The rows of one group are the ranges of one sketch: a few hundred, whatever the corpus holds.
    quart = (
        levels.groupBy("level", "g_lang", "g_source", "feature")
        .agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("b", "n"))).alias("h"))
        .select(
            "level", "g_lang", "g_source", "feature", "total",
            *[
                F.expr(
                    "aggregate(h, struct(0L as seen, -1 as b), (acc, e) -> struct(acc.seen + e.n as seen,"
                    f" if(acc.b < 0 and 4 * (acc.seen + e.n) >= {q} * total, e.b, acc.b) as b), acc -> acc.b)"
                ).alias(f"b{q}")
                for q in (1, 3)
            ],
        )
        .select("level", "g_lang", "g_source", "feature", "total", F.expr(_low("b1")).alias("q1"), F.expr(_low("b3")).alias("q3"))
    )
    width = F.expr("greatest(q3 - q1, case feature " + " ".join(f"when '{f}' then {w}L" for f, w in FEATURES.items()) + " end)")
    bounds = quart.select("level", "g_lang", "g_source", "feature", "total", (F.col("q1") - reach * width).alias("lo"), (F.col("q3") + reach * width).alias("hi"))
    wide = bounds.groupBy("level", "g_lang", "g_source").agg(
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("feature") == f, F.col(side))).alias(f"{side}_{f}") for f in FEATURES for side in ("lo", "hi")],
    )
    cols = [f"{side}_{f}" for f in FEATURES for side in ("lo", "hi")]
    pick = lambda lv, p: wide.where(f"level = {lv}").select(
        *{0: ["g_lang", "g_source"], 1: ["g_lang"], 2: []}[lv], F.col("total").alias(f"{p}_n"), *[F.col(c).alias(f"{p}_{c}") for c in cols]
    )
    groups = feats.select("g_lang", "g_source").distinct()
    joined = groups.join(pick(0, "s"), ["g_lang", "g_source"], "left").join(pick(1, "l"), "g_lang", "left")
    joined = joined.withColumn("one", F.lit(1)).join(pick(2, "a").withColumn("one", F.lit(1)), "one", "left")
    return joined.select(
        "g_lang", "g_source",
        *[
            F.when(F.col("s_n") >= min_group, F.col(f"s_{c}")).when(F.col("l_n") >= min_group, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}")).alias(c)
            for c in cols
        ],
    )


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP, reach: int = REACH) -> DataFrame:
    """Per row of docs: the counts, base_failed, and kept (base rules and all adaptive fences hold)."""
    f = features(docs, id_col, text_col, lang_col, source_col)
    f = f.select(
        "*",
        F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words").alias("base_failed"),
        # A prefix keeps null apart from every real name.
        F.expr("if(lang is null, '-', '+' || lang)").alias("g_lang"),
        F.expr("if(source is null, '-', '+' || source)").alias("g_source"),
        F.expr("100 * word_chars div greatest(n_words, 1L)").alias("f_len"),
        F.expr("10000 * n_symbols div greatest(word_chars, 1L)").alias("f_sym"),
        F.expr("1000 * n_dup_lines div greatest(n_lines, 1L)").alias("f_dup"),
        F.expr("1000 * n_repeat_words div greatest(n_words, 1L)").alias("f_rep"),
    ).drop("lang", "source", "n_lines")
    f = stored(f, "rules")  # the texts are read once; both uses below read the counts
    within = F.expr(" and ".join(f"{x} between lo_{x} and hi_{x}" for x in FEATURES))
    bounds = stored(fences(f, min_group, reach), "rule-fences")
    bounds = F.broadcast(bounds) if bounds.limit(FEW + 1).count() <= FEW else bounds.hint("merge")
    return f.join(bounds, ["g_lang", "g_source"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(within, F.lit(True))).alias("kept"),
    )
