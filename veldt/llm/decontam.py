"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question that was
re-parameterised has the same template.  Windows of ``WIDTH`` template words
are hash-joined with the benchmark's.  Each window has two templates: in the
typed one a capital makes a name; in the folded one words are compared without
case and only numbers and units are placeholders, so copies in capitals or in
lower case meet there.  Which words are names is decided by the item's words.

Where windows meet, the placeholders' values are compared without case, first in
each copy (the windows with one distance between their places in document and
item), then over the document, for copies with words put in or left out; the
better of the two counts.  There an item's name or unit must always turn into
the same word ("Ann" into "Bob" everywhere), and a number, which others may
equal by chance, into one number at each of its places.  Windows that break the
mapping most windows agree on do not count; those that stand word for word do.
A document is
contaminated if at least ``ENOUGH`` windows of an item, or half of a shorter
item's windows, are left.

No window is dropped.  One with fewer than ``MIN_LITERAL`` plain words (in
proportion for short items) counts where it stands word for word, without
regard to case.  A window of c > ``COMMON`` items counts ``COMMON / c``, in the
windows found and in the item's total alike, so a whole copy always has all of
them.  The rule is applied to the rare template windows, to all template windows
by weight, and to all windows by weight; one of the three is enough.

DataFrame expressions only.  The benchmark's windows are broadcast behind a
count; beyond it both sides are shuffled by the window's hash.

Defined cases: null or wordless text matches nothing; items shorter than a
window are matched as one window, those of fewer than ``MIN_WORDS`` words only
word for word; in scripts without spaces every letter is a word; equal items
count as one (the smallest id); rows that repeat
get the same verdict each, null ids included; other columns do not matter;
empty inputs give no matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm import common as C

WIDTH = 8
MIN_WORDS = 5
MIN_LITERAL = 5
ENOUGH = 6
COMMON = 20
#: benchmark windows that are broadcast at most (about 100 bytes each)
BROADCAST_WINDOWS = 100_000

# Thai, Lao, Burmese, Khmer, kana and Han: no spaces, so a letter is a word.
_UNSPACED = (r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF"
             r"\uF900-\uFAFF\x{20000}-\x{3FFFF}")
WORD = rf"[\p{{L}}&&[{_UNSPACED}]]|[\p{{N}}[\p{{L}}&&[^{_UNSPACED}]]]+(?:[.,]\p{{N}}+)*"

# Words that count as units.
UNITS = (
    "cm", "mm", "km", "kg", "mg", "ml", "lb", "lbs", "oz", "mph", "kmh",
    "meter", "meters", "metre", "metres", "mile", "miles", "inch", "inches", "foot", "feet", "yard", "yards",
    "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces", "ton", "tons",
    "liter", "liters", "litre", "litres", "gallon", "gallons",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
    "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degree", "degrees",
)
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"


def template_word(w: Column) -> Column:
    """Placeholder of a word: digits make a number, a capital anywhere a name; plain words stay."""
    low = F.lower(w)
    return (F.when(w.rlike("[0-9]"), F.lit(NUMBER)).when(low != w, F.lit(NAME))
            .when(w.isin(*UNITS), F.lit(UNIT)).otherwise(w))


def folded_word(w: Column) -> Column:
    """The same without regard to case, which names need: digits make a number; other words stay, in lower case."""
    low = F.lower(w)
    return F.when(w.rlike("[0-9]"), F.lit(NUMBER)).when(low.isin(*UNITS), F.lit(UNIT)).otherwise(low)


def _shifted(a: str, b: str, by: int) -> Column:
    """Hash of a[i] with b[i + by], for every i that has both."""
    n = F.least(F.size(a), F.size(b) - by)
    return F.when(n > 0, F.zip_with(F.slice(F.col(a), 1, n), F.slice(F.col(b), by + 1, n), lambda x, y: F.xxhash64(x, y))) \
            .otherwise(F.array().cast("array<bigint>"))


def with_windows(df: DataFrame, words: str, widths: list[int], word: Callable[[Column], Column] = template_word, name: str = "w") -> DataFrame:
    """Adds ``<name><width>``: the hashes of all windows of that width of the template that ``word`` makes, in order."""
    df = df.withColumn("p1", F.transform(words, lambda w: F.xxhash64(word(w))))
    width, powers = 1, [1]
    while width * 2 <= max(widths):
        df = df.withColumn(f"p{width * 2}", _shifted(f"p{width}", f"p{width}", width))
        width *= 2
        powers.append(width)
    for w in widths:
        parts = [p for p in reversed(powers) if w & p]
        df, have, upto = df.withColumn(f"{name}{w}", F.col(f"p{parts[0]}")), f"{name}{w}", parts[0]
        for p in parts[1:]:
            df = df.withColumn(f"{name}{w}", _shifted(have, f"p{p}", upto))
            upto += p
    return df.drop(*[f"p{p}" for p in powers])


def with_both(df: DataFrame, words: str, widths: list[int]) -> DataFrame:
    """Adds ``w<width>`` (typed) and ``f<width>`` (folded)."""
    return with_windows(with_windows(df, words, widths), words, widths, folded_word, "f")


# Windows are always taken apart with posexplode_outer: for the plain form the optimizer
# infers a filter on the array's size, pushes it below the projections above and so
# evaluates the chained hashes many times over.

def split_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _literals(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: ~template_word(w).isin(NUMBER, NAME, UNIT)))


def _folded(words: Column) -> Column:
    """Words as one string without case.  No lambda: it would end the generated loop of the join below."""
    return F.lower(F.array_join(words, " "))


def benchmark_windows(bench: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """width, h (one row for each template), item_id, ipos, iwords (words of the window), exact (counts word for
    word only), rare (a template of few items), weight, and the item's sums: rare_total, total (templates), all_total."""
    items = bench.select(F.col(key).cast("bigint").alias("item_id"), split_words(F.col(text)).alias("words")) \
        .where(F.size("words") > 0).groupBy("words").agg(F.min("item_id").alias("item_id"))
    items = items.withColumn("width", F.least(F.size("words"), F.lit(WIDTH)))
    out = None
    for w in range(1, WIDTH + 1):
        one = with_both(items.where(F.col("width") == w), "words", [w])
        one = one.select("width", "item_id", "words", F.posexplode_outer(F.arrays_zip(F.col(f"w{w}").alias("w"), F.col(f"f{w}").alias("f"))).alias("ipos", "z")) \
                 .select("width", "item_id", "ipos", F.col("z.w").alias("h"), F.col("z.f").alias("f"), F.slice("words", F.col("ipos") + 1, w).alias("iwords")) \
                 .withColumn("exact", F.lit(w < MIN_WORDS) | (_literals(F.col("iwords")) * WIDTH < MIN_LITERAL * w))
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("same", F.when(F.col("exact"), F.xxhash64(_folded(F.col("iwords")))).otherwise(F.col("h")))
    out = C.materialize(out, "benchmark")
    held = out.groupBy("width", "exact", "same").agg(F.countDistinct("item_id").alias("c"))
    own, rare = Window.partitionBy("item_id"), ~F.col("exact") & (F.col("c") <= COMMON)
    out = out.join(held, ["width", "exact", "same"]).withColumn("rare", rare) \
        .withColumn("weight", F.least(F.lit(1.0), F.lit(float(COMMON)) / F.col("c"))).drop("c", "same") \
        .withColumn("rare_total", F.sum(F.col("rare").cast("int")).over(own)).withColumn("all_total", F.sum("weight").over(own)) \
        .withColumn("total", F.sum(F.when(F.col("exact"), 0.0).otherwise(F.col("weight"))).over(own))
    # typed templates are no evidence of an exact window
    keys = F.array_distinct(F.when(F.col("exact"), F.array("f")).otherwise(F.array("h", "f")))
    return C.materialize(out.withColumn("h", F.explode(keys)).drop("f"), "benchmark")


def matches(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th (the text's hash), item_id, the item's totals, weights of the consistent windows (rare, windows:
    templates, every: all), changed (some value differs)."""
    b = benchmark_windows(bench)
    widths = [r[0] for r in b.select("width").distinct().orderBy("width").collect()] or [WIDTH]
    few = b.count() <= BROADCAST_WINDOWS
    d = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), split_words(F.col(text)).alias("words"))
    d = with_both(d, "words", widths)
    item = ["item_id", "total", "rare_total", "all_total"]
    about = [*item, "ipos", "weight", "exact", "rare", "iwords"]
    side = b.select("width", F.col("h").alias("bh"), F.when(F.col("exact"), _folded(F.col("iwords"))).alias("literal"), *about)
    hits = None
    for w in widths:
        at = F.col("at") % F.greatest(F.size("words") - (w - 1), F.lit(1))  # the folded windows follow the typed ones
        rows = d.select("doc_id", "th", "words", F.posexplode_outer(F.concat(f"w{w}", f"f{w}")).alias("at", "h"))
        mine = side.where(F.col("width") == w)
        if few:
            # explode, join and slice run in one generated loop, so the words are copied for matches only
            one = rows.join(F.broadcast(mine), F.col("h") == F.col("bh"))
        else:
            thin = rows.drop("words").join(mine, F.col("h") == F.col("bh"))
            one = thin.drop("h").join(d.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "words").distinct(),
                                      F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")))
        there = F.slice("words", at + 1, w)
        one = one.where(~F.col("exact") | (F.col("literal") == _folded(there))) \
                 .select("doc_id", "th", *about, at.alias("dpos"), there.alias("dwords"))
        hits = one if hits is None else hits.unionByName(one)
    hits = C.materialize(hits.distinct(), "hits")
    same = F.forall(F.arrays_zip("iwords", "dwords"), lambda z: F.lower(z["iwords"]) == F.lower(z["dwords"]))
    hits = hits.withColumn("same", same)
    # copy: the distance of the places, or null for the whole document
    near = hits.withColumn("copy", F.explode(F.array(F.col("dpos") - F.col("ipos"), F.lit(None).cast("int"))))
    kind = F.transform("iwords", lambda w, i: F.struct(w.alias("w"), template_word(w).alias("t"), (F.col("ipos") + i).alias("p"), F.get("dwords", i).alias("d")))
    pair = F.explode(F.filter(kind, lambda z: z["t"].isin(NUMBER, NAME, UNIT)))
    slots = near.select("doc_id", "th", "item_id", "copy", "ipos", "dpos", pair.alias("z")) \
        .select("doc_id", "th", "item_id", "copy", "ipos", "dpos", F.lower("z.d").alias("dv"),
                F.when(F.col("z.t") == NUMBER, F.concat(F.lit("#"), F.col("z.p"))).otherwise(F.lower("z.w")).alias("iv"))
    votes = slots.groupBy("doc_id", "th", "item_id", "copy", "iv", "dv").agg(F.count(F.lit(1)).alias("c"))
    rule = votes.groupBy("doc_id", "th", "item_id", "copy", "iv").agg(F.min(F.struct((-F.col("c")).alias("c"), F.col("dv"))).alias("m")) \
        .select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), F.col("item_id").alias("i2"), F.col("copy").alias("c2"),
                F.col("iv").alias("v2"), F.col("m.dv").alias("must"))
    s = slots.join(rule, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")) & (F.col("item_id") == F.col("i2"))
                   & F.col("copy").eqNullSafe(F.col("c2")) & (F.col("iv") == F.col("v2")), "left")
    breaks = s.where(F.col("dv") != F.col("must")).select(F.col("doc_id").alias("d3"), F.col("th").alias("t3"), F.col("item_id").alias("i3"),
                                                          F.col("copy").alias("c3"), F.col("ipos").alias("p3"), F.col("dpos").alias("q3")).distinct()
    good = near.join(breaks, F.col("doc_id").eqNullSafe(F.col("d3")) & (F.col("th") == F.col("t3")) & (F.col("item_id") == F.col("i3"))
                     & F.col("copy").eqNullSafe(F.col("c3")) & (F.col("ipos") == F.col("p3")) & (F.col("dpos") == F.col("q3")) & ~F.col("same"), "anti")
    found = good.groupBy("doc_id", "th", *item, "copy", "ipos").agg(*[F.max(c).alias(c) for c in ("weight", "exact", "rare")],
                                                                    (~F.max("same")).alias("changed"))
    found = found.groupBy("doc_id", "th", *item, "copy").agg(
        F.sum(F.col("rare").cast("int")).alias("rare"), F.sum(F.when(F.col("exact"), 0.0).otherwise(F.col("weight"))).alias("windows"),
        F.sum("weight").alias("every"), F.max("changed").alias("changed"))
    sums = ["rare", "windows", "every"]
    # the copy (or the whole document) with the most; equal ones: unchanged first
    best = F.max_by(F.struct(*sums, "changed"), F.struct(*[F.round(c, 6) for c in sums], ~F.col("changed")))
    return found.groupBy("doc_id", "th", *item).agg(*[F.max(c).alias(c) for c in sums], best.alias("b")) \
        .select("doc_id", "th", *item, *sums, F.col("b.changed").alias("changed"))


def _enough(windows: str, total: str) -> Column:
    """Sums of weights are rounded: their order is not fixed."""
    return (F.col(total) > 0) & (F.round(windows, 6) >= F.round(F.least(F.lit(float(ENOUGH)), F.col(total) / 2), 6))


def contaminated(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th of contaminated texts with n_items, item_id (best covered, then smallest), share, changed."""
    m = matches(docs, bench, key, text).where(_enough("rare", "rare_total") | _enough("windows", "total") | _enough("every", "all_total"))
    share = F.greatest(*[F.when(F.col(t) > 0, F.col(n) / F.col(t)) for n, t in (("windows", "total"), ("every", "all_total"))])
    best = F.min(F.struct((-share).alias("s"), "item_id", "changed"))
    return m.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n_items"), best.alias("b")).select(
        "doc_id", "th", "n_items", F.col("b.item_id").alias("item_id"), (-F.col("b.s")).alias("share"), F.col("b.changed").alias("changed"))


def decontaminate(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, contaminated, n_items, item_id, share, changed."""
    bad = C.materialize(contaminated(docs, bench, key, text), "contaminated")
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"))
    b = bad.withColumnRenamed("doc_id", "d2").withColumnRenamed("th", "t2")
    return rows.join(b, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left").select(
        "doc_id", F.col("t2").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        "item_id", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("changed", F.lit(False)).alias("changed"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The clean rows of ``docs``, all columns."""
    bad = C.materialize(contaminated(docs, bench, key, text).select(F.col("doc_id").alias("__d"), F.col("th").alias("__t")), "contaminated")
    return docs.join(bad, F.col(key).cast("bigint").eqNullSafe(F.col("__d")) & (F.xxhash64(F.col(text)) == F.col("__t")), "anti")
