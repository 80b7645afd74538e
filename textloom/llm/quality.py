"""Quality rules with thresholds from quantile sketches, native columns only.

Each (language, source) has a sketch of its documents' figures: how many fall into each of
the buckets that grow by a constant ratio (a DDSketch). Counts add up, so sketches merge:
a group of few documents takes its language's sketch and a language of few documents that
of everything, without another pass over texts. A sketch never depends on the order of
rows, so that runs agree. Documents that fail the base rule are in no sketch.

A figure is out of bounds if it lies further from the middle eight tenths of its group
than ``reach`` times their width, and by more than ``STRAY`` of the things counted: a group
without any symbols says nothing on how far a document may go, four of them may be chance.

Defined cases: a null text is an empty one and fails the base rule; null languages and
sources are groups of their own; equal rows are judged alike; figures without words
are 0; an empty table gives an empty result, and of a group whose rows all fail
none is kept. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.columns import as_text, words_of
from textloom.plans.workdir import materialize

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
STEPS = 128            # buckets while a figure grows e-fold: a bound is off by 0.8 % at most
FEWEST = 30            # documents that a group needs to have its own thresholds
REACH = 2.0
STRAY = 4.0
ZERO = -(1 << 30)      # below all buckets
LOW, HIGH = 1, 9       # tenths of a group below its middle part, and up to its end
# figure: of how many things it is a share or a mean
FIGURES = {"symbol_share": "n_words", "word_length": "n_words", "dup_line_share": "n_lines"}


def _covered(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, first occurrence included."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"),
                           i.alias("i")))
    return F.when(F.size(words) >= 4, F.sort_array(windows)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def base_figures(docs: DataFrame, text_col: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and the counts of each whole text: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, and n_lines (lines with a word)."""
    text = as_text(text_col)
    step = docs.select(*keep, text.alias("_text"), words_of(text).alias("_words"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    step = step.select(
        *keep, F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"), _covered(F.col("_words")).alias("_sorted"))
    same = lambda a, b: F.get(F.col("_sorted"), a)["h"] == F.get(F.col("_sorted"), b)["h"]
    twice = F.filter("_sorted", lambda x, k: F.coalesce(same(k, k - 1), F.lit(False))
                     | F.coalesce(same(k, k + 1), F.lit(False)))
    step = step.select(
        *keep, "n_words", "word_chars", "n_symbols", F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.array_sort(F.transform(twice, lambda x: x["i"])).alias("_at"))
    # A window covers three words, or as many as lie before the next one.
    empty = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    run = F.aggregate("_at", empty, lambda s, p: F.struct(
        p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).cast("long").alias("n")))
    return step.withColumn("n_repeat_words", run["n"]).drop("_at")


def with_verdict_inputs(figures: DataFrame) -> DataFrame:
    """Add base_failed and the figures that thresholds are set on."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return figures.select("*", failed.alias("base_failed"),
                          share("n_symbols", "n_words").alias("symbol_share"),
                          share("word_chars", "n_words").alias("word_length"),
                          share("n_dup_lines", "n_lines").alias("dup_line_share"))


def sketches(figures: DataFrame, by: list[str]) -> DataFrame:
    """``by``, figure, bucket, n: the rows past the base rule whose figure is in the bucket.

    A bucket is null for 0. There are some thousand buckets at most, however many rows.
    """
    bucket = lambda f: F.when(F.col(f) > 0, F.floor(F.ln(f) * STEPS).cast("int"))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("figure"), bucket(f).alias("bucket")) for f in FIGURES]))
    # Counted and not filtered: a filter would be pushed to where the figures are made, and make them anew.
    return (figures.select(*by, "base_failed", each.alias("at")).groupBy(*by, "at.figure", "at.bucket")
            .agg(F.count_if(~F.col("base_failed")).alias("n")).where("n > 0"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "figure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """One row per group: its rows and both ends of the middle part of each figure.

    The ends are edges of buckets, so that the middle part is never cut short.
    """
    group = Window.partitionBy(*by, "figure")
    ranked = sketch.select(
        *by, "figure", "bucket", F.sum("n").over(group).alias("rows"),
        F.sum("n").over(group.orderBy(F.asc_nulls_first("bucket"))).alias("up_to"))
    first = lambda f, tenths: F.min(F.when(
        (F.col("figure") == f) & (10 * F.col("up_to") >= tenths * F.col("rows")), F.coalesce("bucket", F.lit(ZERO))))
    edge = lambda b, up: F.when(b > ZERO, F.exp((b + up) / STEPS)).otherwise(0.0)
    ends = ranked.groupBy(*by).agg(F.max("rows").alias("rows"), *[
        first(f, tenths).alias(f"{f}_{end}") for f in FIGURES for end, tenths in (("low", LOW), ("high", HIGH))])
    return ends.select(
        *[F.col(c).alias(f"{prefix}{c}") for c in by], F.col("rows").alias(f"{prefix}rows"),
        *[edge(F.col(f"{f}_{end}"), up).alias(f"{prefix}{f}_{end}")
          for f in FIGURES for end, up in (("low", 0), ("high", 1))])


def thresholds(figures: DataFrame, reach: float = REACH, fewest: int = FEWEST) -> DataFrame:
    """One row per (lang, source) that has rows past the base rule: <figure>_low and <figure>_high."""
    fine = materialize(sketches(figures, ["lang", "source"]), "quality-sketches")
    by_lang = merged(fine, ["lang"])
    own = quantiles(fine, ["lang", "source"], "")
    joined = (own.join(quantiles(by_lang, ["lang"], "l_"), F.col("lang").eqNullSafe(F.col("l_lang")))
              .crossJoin(F.broadcast(quantiles(merged(by_lang, []), [], "t_"))))  # one row
    bounds = []
    for f in FIGURES:
        low, high = (F.when(F.col("rows") >= fewest, F.col(f"{f}_{end}"))
                     .when(F.col("l_rows") >= fewest, F.col(f"l_{f}_{end}")).otherwise(F.col(f"t_{f}_{end}"))
                     for end in ("low", "high"))
        bounds += [(low - reach * (high - low)).alias(f"{f}_low"), (high + reach * (high - low)).alias(f"{f}_high")]
    return materialize(joined.select("lang", "source", *bounds), "quality-bounds")


def judged(figures: DataFrame, bounds: DataFrame) -> DataFrame:
    """``figures`` with kept: neither failed by the base rule nor out of its group's bounds."""
    b = bounds.withColumnsRenamed({"lang": "b_lang", "source": "b_source"})
    inside = ~F.col("base_failed")
    for f, things in FIGURES.items():
        stray = F.when(F.col(things) > 0, STRAY / F.col(things)).otherwise(0.0)
        inside = inside & F.col(f).between(F.col(f"{f}_low") - stray, F.col(f"{f}_high") + stray)
    return (figures.join(b, F.col("lang").eqNullSafe(F.col("b_lang"))
                         & F.col("source").eqNullSafe(F.col("b_source")), "left")
            .withColumn("kept", F.coalesce(inside, F.lit(False))).drop("b_lang", "b_source"))
