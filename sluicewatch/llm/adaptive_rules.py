"""Quality rules with thresholds that each language and source sets for itself.

Only DataFrame functions. Every text is measured once. The measures of each
(language, source) go to a quantile sketch: counts per bucket of a logarithmic scale
with relative error ``ERROR``. Sketches merge by adding counts, so partial aggregates
build them, and those of a language or of everything are sums of finer ones. A text
fails where a measure lies beyond its group's fence: the quantile ``TAIL`` (for low
values ``1 - TAIL``) plus ``REACH`` times its distance from the median, and at least a
small floor, so that a group without any spread does not fail its ordinary texts. A
group may hold bad texts up to ``1 - TAIL`` of it without moving its fence to them.

Every group uses its own sketch, as far as its rows bear it out: its quantiles count by
their number, those of its language as ``PRIOR_ROWS`` rows more, and the language's
likewise beside those of all. No number of rows switches from one to the other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicewatch.llm.arrow_rows import apart
from sluicewatch.llm.scratch import counted, stored

#: White space, symbols and the base rule as the rules define them.
BLANKS = "\\x20\\x09-\\x0D"
SYMBOLS = "[^#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50

#: Relative error of a sketched quantile.
ERROR = 0.02
TAIL = 0.85
REACH = 2.0
#: Rows that the quantiles of a language count for in those of a group, and all in a language's.
PRIOR_ROWS = 20
#: Bytes of a group's fences, for the choice to broadcast them.
FENCE_BYTES = 256
#: (measure, least margin of its fence, whether low values fail too)
MEASURES = [
    ("symbols_per_word", 0.05, False),
    ("repeated_share", 0.05, False),
    ("dup_line_share", 0.1, False),
    ("chars_per_word", 0.25, True),
]
_POSITION_BITS = 24


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{BLANKS}]+"), lambda w: w != "")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the counts of the base rules.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` of
    the whole text, and ``n_lines``, its lines that are not blank; null counts as empty. Words in repeated windows are found by
    sorting, per text, one number per window made of a hash and a position; equal
    neighbours are compared word by word, and a text where hashes of different windows
    meet, or one too long for the position, is sorted by the windows themselves.
    """
    others = apart(docs.columns, [text, "n_lines", *COUNTS])
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    step = docs.select(
        *(F.col(f"`{c}`") for c in others),
        _words(body).alias("__w"),
        F.char_length(F.regexp_replace(body, f"[{BLANKS}]+", "")).cast("bigint").alias("word_chars"),
        F.char_length(F.regexp_replace(body, SYMBOLS, "")).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.size(lines).cast("bigint").alias("n_lines"),
    )
    n = F.size("__w")
    low = (1 << _POSITION_BITS) - 1

    def packed(i: Column) -> Column:
        h = F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))
        return F.shiftleft(h, _POSITION_BITS).bitwiseOR(i.cast("bigint"))

    some = (n >= 3) & (n <= low)
    windows = F.when(some, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), packed)))
    step = step.withColumn("__s", F.coalesce(windows, F.array().cast("array<bigint>")))

    def part(x: Column) -> Column:
        return F.shiftright(x, _POSITION_BITS)

    def position(x: Column) -> Column:
        return x.bitwiseAND(F.lit(low)).cast("int")

    twin = F.filter(
        "__s",
        lambda x, k: F.coalesce(part(F.get("__s", k - 1)) == part(x), F.lit(False))
        | F.coalesce(part(F.get("__s", k + 1)) == part(x), F.lit(False)),
    )
    step = step.withColumn("__t", twin)

    def differs(x: Column, k: Column) -> Column:
        before = F.get("__t", k - 1)
        p, q = position(before), position(x)
        same = F.lit(True)
        for o in range(3):
            same = same & (F.get("__w", p + o) == F.get("__w", q + o))
        return (k > 0) & (part(before) == part(x)) & ~same

    step = step.withColumn(
        "__p",
        F.when((n > low) | F.exists(F.transform("__t", differs), lambda d: d), _repeats_exact())
        .otherwise(F.sort_array(F.transform("__t", position))),
    )
    covered = F.aggregate(
        "__p",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("sum")),
        lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(3), p - acc["last"])).alias("sum")),
        lambda acc: acc["sum"],
    )
    return step.select(
        *(F.col(f"`{c}`") for c in others),
        n.cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_lines",
        covered.alias("n_repeat_words"),
    )


def _repeats_exact() -> Column:
    """Starts of windows found twice or more, by sorting the windows themselves."""
    windows = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.size("__w") - 3),
            lambda i: F.struct(F.slice("__w", i + 1, 3).alias("g"), i.alias("p")),
        )
    )
    return F.aggregate(
        windows,
        F.struct(
            F.lit(None).cast("array<string>").alias("g"),
            F.lit(-1).alias("first"),
            F.array().cast("array<int>").alias("found"),
        ),
        lambda acc, x: F.struct(
            x["g"].alias("g"),
            F.when(acc["g"] == x["g"], F.lit(-1)).otherwise(x["p"]).alias("first"),
            F.when(
                acc["g"] == x["g"],
                F.when(acc["first"] >= 0, F.concat(acc["found"], F.array(acc["first"], x["p"])))
                .otherwise(F.concat(acc["found"], F.array(x["p"]))),
            ).otherwise(acc["found"]).alias("found"),
        ),
        lambda acc: F.sort_array(acc["found"]),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED
    )


def _measures() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "repeated_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "chars_per_word": F.col("word_chars") / words,
    }


def _bucket(x: Column) -> Column:
    """Number of x's bucket on a scale of ratio (1 + e) / (1 - e); 0 for values near 0."""
    ratio = (1 + ERROR) / (1 - ERROR)
    return F.when(x < 1e-4, 0).otherwise(F.ceil(F.log(x / 1e-4) / math.log(ratio)) + 1).cast("int")


def _edge(bucket: Column, upper: bool) -> Column:
    """The greatest or the least value of a bucket."""
    ratio = (1 + ERROR) / (1 - ERROR)
    return F.when(bucket == 0, 1e-4 if upper else 0.0).otherwise(1e-4 * F.pow(F.lit(ratio), bucket - (1 if upper else 2)))


def sketches(measures: DataFrame) -> DataFrame:
    """(``lang``, ``source``, ``measure``, ``bucket``, ``n``): mergeable by adding ``n``.

    Of texts that pass the base rules. Null languages and sources are groups as well.
    """
    entries = F.array(
        *(F.struct(F.lit(i).alias("measure"), _bucket(_measures()[m]).alias("bucket"))
          for i, (m, _, _) in enumerate(MEASURES))
    )
    passed = measures.where(~base_failed())
    # Summed per combination of buckets first: each row is read once, then told apart.
    combined = passed.groupBy("lang", "source", entries.alias("e")).agg(F.count("*").alias("n"))
    told = combined.select("lang", "source", "n", F.inline("e"))
    return told.groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))


def _tails(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Count, low tail, median and high tail of each measure of each group of ``keys``."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    lists = merged.groupBy(*keys, "measure").agg(
        F.sum("n").alias("rows"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("counts")
    )

    def at(q: float) -> Column:
        return F.aggregate(
            "counts",
            F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("int").alias("bucket")),
            lambda acc, c: F.struct(
                (acc["sum"] + c["n"]).alias("sum"),
                F.when(acc["bucket"].isNotNull(), acc["bucket"])
                .when(acc["sum"] + c["n"] >= F.col("rows") * q, c["bucket"]).alias("bucket"),
            ),
            lambda acc: acc["bucket"],
        )

    return lists.select(
        *keys, "measure", "rows",
        _edge(at(1 - TAIL), False).alias("low"), _edge(at(0.5), True).alias("median"),
        _edge(at(TAIL), True).alias("high"),
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """(``lang``, ``source``, ``fences``): per measure the least and the greatest value kept.

    From the group's own sketch, drawn towards its language's, and that towards all.
    """
    own = _tails(sketch, ["lang", "source"]).alias("own")
    by_lang = _tails(sketch, ["lang"]).alias("by_lang")
    overall = _tails(sketch, []).alias("overall")
    same_lang = F.col("own.lang").eqNullSafe(F.col("by_lang.lang"))
    joined = own.join(by_lang, same_lang & (F.col("own.measure") == F.col("by_lang.measure"))).join(
        F.broadcast(overall), F.col("own.measure") == F.col("overall.measure")
    )

    def chosen(name: str) -> Column:
        def drawn(part: str, towards: Column) -> Column:
            rows = F.col(f"{part}.rows")
            return (rows * F.col(f"{part}.{name}") + PRIOR_ROWS * towards) / (rows + PRIOR_ROWS)

        return drawn("own", drawn("by_lang", F.col(f"overall.{name}")))

    low_tail, median, high_tail, measure = chosen("low"), chosen("median"), chosen("high"), F.col("own.measure")
    floor, low = F.lit(None), F.lit(None)
    for i, (_, least, two_sided) in enumerate(MEASURES):
        floor = F.when(measure == i, F.lit(least)).otherwise(floor)
        below = low_tail - F.greatest(F.lit(least), (median - low_tail) * REACH)
        low = F.when((measure == i) & F.lit(two_sided), below).otherwise(low)
    high = high_tail + F.greatest(floor, (high_tail - median) * REACH)
    fence = F.struct(measure.alias("measure"), low.cast("double").alias("low"), high.alias("high"))
    fences = joined.select(F.col("own.lang").alias("lang"), F.col("own.source").alias("source"), fence.alias("fence"))
    return fences.groupBy("lang", "source").agg(F.sort_array(F.collect_list("fence")).alias("fences"))


def apply_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` without its text, with counts, ``base_failed``, ``failed`` and ``kept``.

    ``failed`` names the measures beyond their fences. A text that fails a base rule is
    not kept, and is not counted in the sketches. A group that has no text left there
    has no thresholds and keeps what passes the base rules. Null text is an empty text.
    Repeated rows are judged each on its own and all count, texts whole, however long; a
    value equal to a fence is kept. An empty table gives an empty result. Columns named
    like results give way to them.
    """
    names = apart(docs.columns, [*COUNTS, "base_failed", "failed", "kept"])
    inner = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in names if c != text)).alias("row"),
        F.col(f"`{lang}`").alias("lang"),
        F.col(f"`{source}`").alias("source"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    measures = stored(measured(inner), "measures")
    fences = stored(thresholds(sketches(measures)), "fences")
    values = F.array(*(_measures()[m] for m, _, _ in MEASURES))
    labels = F.array(*(F.lit(m) for m, _, _ in MEASURES))
    low, high = F.col("fences.low"), F.col("fences.high")
    marked = F.transform(
        F.sequence(F.lit(0), F.lit(len(MEASURES) - 1)),
        lambda i: F.when(
            (F.get(values, i) > F.get(high, i)) | F.coalesce(F.get(values, i) < F.get(low, i), F.lit(False)),
            F.get(labels, i),
        ),
    )
    failed = F.when(F.col("fences").isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(marked))
    m, t = measures.alias("m"), counted(fences, FENCE_BYTES).alias("t")
    same = F.col("m.lang").eqNullSafe(F.col("t.lang")) & F.col("m.source").eqNullSafe(F.col("t.source"))
    judged = m.join(t, same, "left").select("m.*", failed.alias("failed"))
    judged = judged.withColumn("base_failed", base_failed())
    return judged.select(
        "row.*", *COUNTS, "base_failed", "failed",
        (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"),
    )
