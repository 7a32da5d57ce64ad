"""Quality rules whose cutoffs follow each language and source.

Every document gets a handful of shares in thousandths. A share is a lower confidence bound (Wilson, three deviations),
so one mark in a short text says little and the same share of a long text says more. What is usual in a (lang, source)
is kept as a quantile histogram of its documents' shares on a logarithmic grid: one count per bin, so two histograms
merge by adding counts, the rank error is zero and the value error a sixteenth of a doubling. For the histogram half a
mark is added to every document, so that those without a mark tell how small their share can be, and a group in which
most have none still has levels. The cutoff of a share is a fence read off the histogram: the HIGH quantile and FENCE times
its distance from the LOW one, a doubling at least. Quantiles of a group are drawn towards those of its language, and a
language's towards the corpus's, as if PRIOR documents of the larger group stood in the smaller one. Documents beyond a
fence are rejected by a join with the cutoffs. Repeated lines are left to the base rule, which counts words in repeated
windows.

Nulls: a null text has no words (and fails the base rule); null lang or source form groups of their own. Empty texts
fail the base rule, texts of any length are measured whole, ties at a fence are kept, repeated rows count as often as
they stand there and get equal verdicts. Empty tables give no rows. Columns of the input are never overwritten by the
filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import covered, gram_hashes, let, paired, small, stashed, words

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SYMBOLS = "#*$%&|<>"
#: Quantiles in tenths, distances of the two above the higher one, and documents that a larger group counts for.
LOW, HIGH, FENCE, PRIOR = 5, 8, 3, 20
#: Bins of a doubling.
DOUBLING = 16
SHARES = ("symbol_share", "upper_share", "shout_share", "echo_share")


def _repeat_words(tokens: Column) -> Column:
    """Words inside windows of WINDOW words that are found twice or more in the same text."""

    def repeated(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(
            ranked,
            lambda r: F.array_sort(
                F.array_distinct(
                    F.flatten(
                        F.zip_with(
                            F.slice(r, F.lit(1), F.size(r) - 1),
                            F.slice(r, F.lit(2), F.size(r) - 1),
                            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
                        )
                    )
                )
            ),
        )
        spans = F.transform(starts, lambda i: F.struct(i.alias("first"), (i + WINDOW).alias("last")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(covered(spans))

    return F.when(F.size(tokens) <= WINDOW, F.lit(0).cast("bigint")).otherwise(let(gram_hashes(tokens, WINDOW), repeated))


def _echoes(tokens: Column) -> Column:
    """Words equal to the word before them."""
    return F.size(F.filter(paired(tokens, 1, lambda a, b: a == b), lambda x: x))


def _count(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts of the base rules and the shares of the adaptive ones."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = df.withColumn("_words", words(F.col(text_col)))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = whole.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": (F.length(text) - _count(text, r"\x20\x09-\x0D")).cast("bigint"),
            "n_symbols": _count(text, SYMBOLS).cast("bigint"),
            "_lines": let(lines, lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))),
            "n_repeat_words": _repeat_words(F.col("_words")),
            "_upper": _count(text, "A-Z"),
            "_shout": _count(text, "!?"),
            "_echo": _echoes(F.col("_words")),
        }
    )
    return counted.withColumns(
        {
            "n_dup_lines": F.col("_lines.dup").cast("bigint"),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "symbol_share": lower_bound(F.col("n_symbols"), F.col("word_chars")),
            "upper_share": lower_bound(F.col("_upper"), F.col("word_chars")),
            "shout_share": lower_bound(F.col("_shout"), F.col("word_chars")),
            "echo_share": lower_bound(F.col("_echo"), F.col("n_words")),
            "_bins": F.struct(*[level_bin(F.col(part), F.col(of)).alias(s) for s, (part, of) in zip(SHARES, (("n_symbols", "word_chars"), ("_upper", "word_chars"), ("_shout", "word_chars"), ("_echo", "n_words")), strict=True)]),
        }
    ).drop("_words", "_lines", "_upper", "_shout", "_echo")


def lower_bound(part: Column, of: Column) -> Column:
    """Wilson's lower bound of a share at three deviations, in thousandths."""
    n = F.greatest(of, F.lit(1)).cast("double")
    p = F.least(F.lit(1.0), part / n)
    bound = (p + 4.5 / n - 3 * F.sqrt(p * (1 - p) / n + 2.25 / (n * n))) / (1 + 9 / n)
    return F.floor(1000 * F.greatest(F.lit(0.0), bound) + 1e-9).cast("int")


def level_bin(part: Column, of: Column) -> Column:
    """The bin of a share to which half a mark is added, on the logarithmic grid."""
    return F.floor(DOUBLING * F.log2((part + 0.5) / (of + 1)) + 1e-9).cast("int")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, share, bin, n): the quantile histograms. Summing n over any of the columns merges them."""
    pairs = F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"_bins.{s}").alias("bin")) for s in SHARES])
    return measured.where(~F.col("base_failed")).select("lang", "source", F.explode(pairs).alias("p")).groupBy("lang", "source", "p.share", "p.bin").agg(F.count("*").alias("n"))


def _quantiles(histogram: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """(keys, share, docs, low, high) of each histogram, from its cumulated counts; ``tag`` ends the last three names."""
    merged = histogram.groupBy(*keys, "share", "bin").agg(F.sum("n").alias("n"))
    up = Window.partitionBy(*keys, "share").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merged.withColumn("below", F.sum("n").over(up))
    total = ranked.groupBy(*keys, "share").agg(F.max("below").alias("docs"), F.collect_list(F.struct("bin", "below")).alias("h"))
    at = lambda q: F.array_min(F.transform(F.filter("h", lambda x: 10 * x["below"] >= q * F.col("docs")), lambda x: x["bin"]))
    return total.select(*keys, "share", F.col("docs").alias(f"docs{tag}"), at(LOW).alias(f"low{tag}"), at(HIGH).alias(f"high{tag}"))


def cutoffs(histogram: DataFrame) -> DataFrame:
    """One row per (lang, source) with the fence of every share."""
    own = _quantiles(histogram, ["lang", "source"], "")
    lang = _quantiles(histogram, ["lang"], "_l").select(F.col("lang").alias("lang_"), F.col("share").alias("share_"), "docs_l", "low_l", "high_l")
    whole = _quantiles(histogram, [], "_a").withColumnRenamed("share", "share_a")
    joined = own.join(lang, own["lang"].eqNullSafe(lang["lang_"]) & (own["share"] == lang["share_"])).join(F.broadcast(whole), F.col("share") == F.col("share_a"))  # one row a share
    drawn = lambda own_, docs, other: (F.col(docs) * own_ + PRIOR * other) / (F.col(docs) + PRIOR)
    level = lambda q: drawn(F.col(q), "docs", drawn(F.col(f"{q}_l"), "docs_l", F.col(f"{q}_a")))
    fence = level("high") + FENCE * F.greatest(level("high") - level("low"), F.lit(float(DOUBLING)))
    thousandths = F.least(F.lit(1000), F.ceil(1000 * F.pow(F.lit(2.0), fence / DOUBLING) - 1e-9))  # as shares are
    fenced = joined.select("lang", "source", "share", thousandths.alias("fence"))
    return fenced.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(*[F.max(F.when(F.col("share") == s, F.col("fence"))).alias(f"_{s}") for s in SHARES])


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Add ``kept``: the base rule passed and every share is within the fence of the document's group."""
    same = measured["lang"].eqNullSafe(limits["_lang"]) & measured["source"].eqNullSafe(limits["_source"])
    within = F.lit(True)
    for s in SHARES:
        within = within & (F.col(s) <= F.coalesce(F.col(f"_{s}"), F.lit(1000)))
    return measured.join(small(limits), same, "left").withColumn("kept", ~F.col("base_failed") & within).drop("_bins", *limits.columns)


def quality_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, shares and verdict of every document; the text is read once."""
    measured = stashed(measure(df.select(id_col, "lang", "source", text_col), text_col).drop(text_col))
    return judge(measured, stashed(cutoffs(sketches(measured))))


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, with the columns of ``df``.

    Rows are written once beside their measures, so that texts are neither measured twice nor shuffled."""
    whole = df.select(F.struct(*df.columns).alias("__row"), "lang", "source", text_col)
    measured = stashed(measure(whole, text_col).drop(text_col))
    return judge(measured, stashed(cutoffs(sketches(measured)))).where("kept").select("__row.*")
