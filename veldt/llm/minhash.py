"""Near-dedup by min-max hashing.

Signatures: each of ``PERMUTATIONS`` hash evaluations over a text's distinct
word shingles gives two values, the smallest and the largest, and both are
unbiased votes for the Jaccard similarity; so half the evaluations fill a
signature.  Bands of ``BAND`` values, each from different permutations, are the
bucket keys: a pair at similarity 0.8 misses all of them with a chance of 3e-6.

Links: texts with equal shingle sets are one class, and only its smallest
doc_id goes on.  In a bucket one row is the pivot (first the smallest id, then
a row picked by hash), and rows not yet known to be in the pivot's component
are compared with it on both whole texts.  After each round buckets whose rows
are all in one component are finished; in a large group of near copies that
soon holds for all.  What is left after ``ROUNDS`` rounds (texts that share a
large part, but not enough) is settled by an exact join on differences: rows
alike to common pivots are a cluster, each row is its difference from the
shingles that most of the cluster holds, and a linked pair's differences are
small together or share a known number of elements.  So edits that do not agree
form no pair, however large the group; rows of different clusters meet by the
rarest shingles of their whole sets.  No bucket is collected and none is capped.

Defined cases: null or blank text has the empty set, is linked with nothing
and stays; different texts under one doc_id are separate texts, and of one text
under it one row stays (the smallest doc_id, then the text's hash, of a
component); a row with a null doc_id takes the component of its class (null if all ids there are null);
other columns do not matter; an empty input gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm import common as C

PERMUTATIONS = 80
BAND = 5
#: rounds with one pivot in each bucket before the rest is settled by differences
ROUNDS = 2
#: percent of similarity with a pivot from which on two rows are of one cluster (any value loses no link)
LOOSE = 50
#: rows meet by subsets of two or three elements where they may miss at most so many (66 and 56 subsets)
SPARE = {2: 10, 3: 5}

_rng = np.random.default_rng(20240)
_FLIP = _rng.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)
_TIMES = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.uint64(0x9E3779B97F4A7C15)
#: hash evaluations held at once
_BLOCK = 1 << 18


# ------------------------------------------------------------- sets

def shingle_hashes(h: np.ndarray, row: np.ndarray, k: int, n_rows: int) -> list[np.ndarray]:
    """Distinct shingle hashes of every row, from its words' hashes in order."""
    first = np.searchsorted(row, np.arange(n_rows + 1))
    roll = C.mix(h + _FOLD)
    for j in range(1, k):
        roll = C.mix(roll[:len(roll) - 1] * _FOLD + h[j:]) if len(roll) > 1 else roll[:0]
    out = []
    for i in range(n_rows):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            out.append(np.unique(roll[a:b - k + 1]))
        elif b > a:
            one = C.mix(h[a:a + 1] + _FOLD)
            for j in range(a + 1, b):
                one = C.mix(one * _FOLD + h[j:j + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_max(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of each permutation over a set."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    step = max(1, _BLOCK // PERMUTATIONS)
    for a in range(0, len(u), step):
        v = (u[None, a:a + step] ^ _FLIP[:, None]) * _TIMES[:, None]
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return low, high


def band_keys(u: np.ndarray) -> np.ndarray:
    low, high = min_max(u)
    values = np.concatenate([low, high]).reshape(-1, BAND)
    key = np.arange(len(values), dtype=np.uint64)
    for j in range(BAND):
        key = C.mix(key * _FOLD ^ values[:, j])
    return key.view(np.int64)


_SIG = "doc_id long, th long, n_shingles long, f1 long, f2 long, bands array<long>"


def _signatures(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
                        ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = C.utf8(b.column(1))
            for i, j in C.slices(off):
                part, o = C.lower_ascii(data[off[i]:off[j]]), off[i:j + 1] - off[i]
                start, end, row = C.words(part, o)
                sets = shingle_hashes(C.hash_spans(part, start, end), row, k, j - i)
                one = [int(C.mix(u).sum(dtype=np.uint64).view(np.int64)) for u in sets]
                two = [int(C.mix(u ^ _FOLD).sum(dtype=np.uint64).view(np.int64)) for u in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array([len(u) for u in sets], pa.int64()), pa.array(one, pa.int64()),
                     pa.array(two, pa.int64()), pa.array([band_keys(u) if len(u) else [] for u in sets], pa.list_(pa.int64()))],
                    schema=schema)

    return run


# ------------------------------------------------------------- comparing

def shingle_set(text: bytes | None, k: int) -> set:
    w = (text or b"").lower().split()
    if not w:
        return set()
    return set(zip(*(w[j:] for j in range(k)), strict=False)) if len(w) >= k else {tuple(w)}


def _compare(k: int):
    schema = pa.schema([("lead", pa.int64()), ("rep", pa.int64()), ("both", pa.int64()), ("either", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for b in batches:
            inter, union = [], []
            for lead, lt, rt in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                lt = lt.as_py()
                if last != (lead, lt):
                    last, held = (lead, lt), shingle_set(lt, k)
                other = shingle_set(rt.as_py(), k)
                common = len(held & other)
                inter.append(common)
                union.append(len(held) + len(other) - common)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(inter, pa.int64()), pa.array(union, pa.int64())],
                                             schema=schema)

    return run


def _compared(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs (lead, rep, ln, n, lc, c) with ``linked`` and ``alike``; where the set sizes rule a link out,
    the texts are not read."""
    small, large = F.least("n", "ln"), F.greatest("n", "ln")
    pairs = pairs.withColumn("maybe", 100 * small >= percent * large)
    far = pairs.where("not maybe").drop("maybe").withColumn("linked", F.lit(False)).withColumn("alike", F.lit(False))
    t, near = texts.select("doc_id", "text"), pairs.where("maybe").drop("maybe")
    read = (near.select("lead", "rep")
            .join(t.select(F.col("doc_id").alias("rep"), F.col("text").alias("rt")), "rep")
            .join(t.select(F.col("doc_id").alias("lead"), F.col("text").alias("lt")), "lead")
            .select("lead", "rep", "lt", "rt").mapInArrow(_compare(k), "lead long, rep long, both long, either long"))
    got = read.groupBy("lead", "rep").agg(F.max(100 * F.col("both") >= percent * F.col("either")).alias("linked"),
                                            F.max(100 * F.col("both") >= LOOSE * F.col("either")).alias("alike"))
    return near.join(got, ["lead", "rep"]).unionByName(far)


def _pairs(rows: DataFrame, tested: DataFrame | None) -> DataFrame:
    """rows (pr, pn, pc: one side; rep, n, c: the other) as distinct pairs lead < rep, not tested yet."""
    swap = F.col("pr") > F.col("rep")

    def pick(x: str, y: str, name: str):
        return F.when(swap, F.col(x)).otherwise(F.col(y)).alias(name)

    out = rows.select(pick("rep", "pr", "lead"), pick("pr", "rep", "rep"), pick("n", "pn", "ln"), pick("pn", "n", "n"),
                      pick("c", "pc", "lc"), pick("pc", "c", "c")).distinct()
    return out if tested is None else out.join(tested, ["lead", "rep"], "anti")


def _links(members: DataFrame, texts: DataFrame, k: int, percent: int) -> list[DataFrame]:
    """Tables of links (lead, rep).  members: key, rep, n of buckets with two rows or more."""
    reach = 1 - percent / 100 + 1e-9
    rows, tested, found, loose = members.withColumn("c", F.col("rep")), None, [], []
    for turn in range(ROUNDS):
        order = F.col("rep") if turn == 0 else F.xxhash64("key", "rep", F.lit(turn))
        pivots = rows.groupBy("key").agg(*[F.min_by(x, order).alias(y) for x, y in (("rep", "pr"), ("n", "pn"), ("c", "pc"))])
        met = rows.join(pivots, "key").where("rep <> pr")
        dist = C.materialize(_compared(_pairs(met.where("c <> pc"), tested), texts, k, percent), "compared")
        found.append(dist.where("linked").select("lead", "rep"))
        loose.append(dist.where("linked or alike").select("lead", "rep"))
        seen = dist.select("lead", "rep")
        tested = seen if tested is None else tested.union(seen)
        # the larger label of a link takes the smaller one, and that one's own new label
        hook = dist.where("linked and lc <> c").groupBy(F.greatest("lc", "c").alias("was")).agg(F.min(F.least("lc", "c")).alias("now"))
        hook = C.materialize(hook, "hooks")
        jump = hook.join(hook.select(F.col("was").alias("now"), F.col("now").alias("then")), "now", "left") \
                   .select(F.col("was").alias("c"), F.coalesce("then", "now").alias("to"))
        rest = met.select("key", "rep", "n", "c").join(jump, "c", "left").withColumn("c", F.coalesce("to", "c")).drop("to")
        mixed = rest.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
        rows = C.materialize(rest.join(mixed, "key", "semi"), "rows")
        if rows.isEmpty():
            return found
    def label(edges: list[DataFrame], name: str) -> DataFrame:
        pairs = functools.reduce(DataFrame.union, edges).select(F.col("lead").alias("a"), F.col("rep").alias("b"))
        return C.connected_components(pairs).select(F.col("node").alias("rep"), F.col("component").alias(name))

    rows = rows.select("key", "rep").join(label(found, "c"), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    mixed = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    left = rows.join(mixed, "key", "semi").select("rep", "c").distinct() \
               .join(label(loose, "cl"), "rep", "left").withColumn("cl", F.coalesce("cl", "rep"))
    left = C.materialize(left, "left")
    return found if left.isEmpty() else [*found, *_settled(left, texts, tested, k, percent)]


def _shingled(k: int):
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("hs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = C.utf8(b.column(1).cast(pa.large_binary()).cast(pa.large_string()))
            for i, j in C.slices(off):
                part, o = C.lower_ascii(data[off[i]:off[j]]), off[i:j + 1] - off[i]
                start, end, row = C.words(part, o)
                sets = shingle_hashes(C.hash_spans(part, start, end), row, k, j - i)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([len(u) for u in sets], pa.int64()),
                                                  pa.array([u.view(np.int64) for u in sets], pa.list_(pa.int64()))], schema=schema)

    return run


def _sets_of(prefix, size: int):
    """Keys of all ``size``-element subsets of an array whose order all rows share."""
    if size == 1:
        return F.transform(prefix, lambda h: F.xxhash64(F.lit(1), h))
    two = F.flatten(F.transform(prefix, lambda x, i: F.transform(
        F.slice(prefix, i + 2, F.size(prefix)), lambda y, j: F.struct(x.alias("x"), y.alias("y"), (i + j + 3).alias("then")))))
    if size == 2:
        return F.transform(two, lambda t: F.xxhash64(F.lit(2), t["x"], t["y"]))
    return F.flatten(F.transform(two, lambda t: F.transform(
        F.slice(prefix, t["then"], F.size(prefix)), lambda z: F.xxhash64(F.lit(3), t["x"], t["y"], z))))


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of rows of one group ``g`` and of two sides ``x`` that may be linked.

    rows: g, x, rep, c, n, el (a set of elements), e and need; a pair is linked only if its ``el`` share
    (e + e') / (2 (100 + percent)) elements, and a row only with partners that share ``need`` of them, so of the
    rarest s - need + l of its s elements that occur on another side at least l are shared, for each l up to need.
    Rows meet by subsets of l such elements, with the largest l up to 3 that gives both few subsets.
    """
    el = rows.select("g", "x", "rep", F.explode("el").alias("h"))
    often = el.groupBy("g", "h").agg(F.count(F.lit(1)).alias("df"), F.min("x").alias("lo"), F.max("x").alias("hi")) \
              .where("lo <> hi").select("g", "h", "df")
    held = el.join(often, ["g", "h"]).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("el"))  # of one text
    held = held.select("rep", F.size("el").alias("s"), F.col("el.h").alias("el")).join(rows.drop("el"), "rep").where("s >= need")
    spare = F.col("s") - F.col("need")
    level = F.when((F.col("need") >= 3) & (spare <= SPARE[3]), 3).when((F.col("need") >= 2) & (spare <= SPARE[2]), 2).otherwise(1)
    held = held.withColumn("level", level)

    def keys_of(at: int):
        keys = F.transform(_sets_of(F.slice("el", F.lit(1), (spare + at).cast("int")), at),
                           lambda key: F.struct(F.lit(at).alias("at"), key.alias("key")))
        return F.when(F.col("level") >= at, keys).otherwise(F.array().cast("array<struct<at:int,key:bigint>>"))

    keys = F.concat(*[keys_of(at) for at in (1, 2, 3)])
    held = C.materialize(held.withColumn("key", F.explode(keys)).select("g", "key.at", "key.key", "x", "rep", "c", "n", "e", "s", "level"), "rare")
    mixed = held.groupBy("g", "at", "key").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("level").alias("least")) \
                .where("lo <> hi and least = at").select("g", "at", "key")
    held = held.join(mixed, ["g", "at", "key"], "semi")
    other = held.select("g", "at", "key", *[F.col(v).alias("p" + v) for v in ("x", "rep", "c", "n", "e", "s", "level")])
    return held.where("level = at").join(other, ["g", "at", "key"]).where(
        ((F.col("plevel") > F.col("level")) | (F.col("rep") > F.col("prep"))) & (F.col("x") != F.col("px"))
        & (100 * F.least("n", "pn") >= percent * F.greatest("n", "pn"))
        & (2 * (100 + percent) * F.least("s", "ps") >= F.col("e") + F.col("pe"))).withColumnRenamed("prep", "pr")


def _settled(left: DataFrame, texts: DataFrame, tested: DataFrame, k: int, percent: int) -> list[DataFrame]:
    """Tables of links (lead, rep) between components among the rows ``left`` (rep, c, cl: a cluster of components).

    The core of a cluster is the shingles that more than half of its rows hold, a row's difference the shingles
    that only one of row and core has (d of them).  With e = (100 + percent) d - (100 - percent) n, two rows of a
    cluster are linked exactly if their differences share (e + e') / (2 (100 + percent)) elements: none where
    e + e' <= 0, which links a row with the one of least e, and otherwise rare ones, as edits of one text seldom
    agree.  Rows of two clusters meet by their whole sets, the same bound without a core.
    """
    far, near = 100 + percent, 100 - percent
    t = texts.join(left, texts["doc_id"] == left["rep"], "semi").select(F.col("doc_id").alias("rep"), "text")
    sets = t.mapInArrow(_shingled(k), "rep long, n long, hs array<long>") \
            .groupBy("rep").agg(F.first("n").alias("n"), F.first("hs").alias("hs"))  # repeated rows hold one text
    sets = C.materialize(sets.join(left, "rep"), "sets")

    size = sets.groupBy("cl").agg(F.count(F.lit(1)).alias("rows"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    held = sets.select("cl", F.explode("hs").alias("h")).groupBy("cl", "h").agg(F.count(F.lit(1)).alias("df"))
    core = held.join(size, "cl").where("2 * df > rows").groupBy("cl").agg(F.collect_list("h").alias("core"))  # at most two mean sets
    none = F.array().cast("array<long>")
    part = sets.join(size.select("cl"), "cl", "semi").join(core, "cl", "left").withColumn("core", F.coalesce("core", none))
    more, less = F.array_except("hs", "core"), F.transform(F.array_except("core", "hs"), lambda h: F.xxhash64(h, F.lit(1)))
    part = part.select("cl", "c", "rep", "n", F.size(more).alias("more"), F.concat(more, less).alias("el")) \
               .withColumn("e", far * F.size("el") - near * F.col("n"))
    part = C.materialize(part, "differences")

    star = part.groupBy("cl").agg(*[F.min_by(v, F.struct("e", "rep")).alias("p" + v) for v in ("rep", "n", "c", "e")])
    met = part.drop("el").join(star.withColumnRenamed("prep", "pr"), "cl").where("c <> pc and e + pe <= 0")
    first = C.materialize(_compared(_pairs(met, tested), texts, k, percent), "compared")
    # a component lies in one cluster, so it takes one label at most
    sides = first.where("linked").select(F.explode(F.array("lc", "c")).alias("c")).distinct()
    joined = left.select("cl", "c").distinct().join(sides, "c", "semi").join(star.select("cl", "pc"), "cl").select("c", "pc")
    part = part.join(joined, "c", "left").withColumn("c", F.coalesce("pc", "c")).drop("pc")
    part = C.materialize(part, "differences")

    # the least e of the other components of a cluster
    least = part.groupBy("cl", "c").agg(F.min("e").alias("e"))
    best = least.groupBy("cl").agg(F.min(F.struct("e", "c")).alias("one"))
    second = least.join(best, "cl").where("c <> one.c").groupBy("cl").agg(F.first("one").alias("one"), F.min("e").alias("two"))
    other = F.when(F.col("c") == F.col("one.c"), F.col("two")).otherwise(F.col("one.e"))
    need = F.greatest(F.lit(1), F.ceil((F.col("e") + other) / F.lit(2 * far)),
                      F.ceil(F.col("n") * F.lit(percent) / F.lit(100)) - F.col("n") + F.col("more"))
    inside = part.join(second, "cl").select(F.col("cl").alias("g"), F.col("c").alias("x"), "rep", "c", "n", "e", need.alias("need"), "el")
    across = sets.select(F.lit(0).cast("long").alias("g"), F.col("cl").alias("x"), "rep", "c", "n", (2 * percent * F.col("n")).alias("e"),
                         F.ceil(F.col("n") * F.lit(percent) / F.lit(100)).alias("need"), F.col("hs").alias("el"))
    seen = tested.union(first.select("lead", "rep"))
    rest = [C.materialize(_compared(_pairs(_met(rows, percent), seen), texts, k, percent), "compared") for rows in (inside, across)]
    return [x.where("linked").select("lead", "rep") for x in (first, *rest)]


# ------------------------------------------------------------- operator

def _judged(docs: DataFrame, k: int, percent: int, key: str, text: str) -> DataFrame:
    """One row per input row: doc_id, th (the text's hash), n_shingles, component_id, kept."""
    spark = docs.sparkSession
    C.small_batches(spark)
    own = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    sig = C.materialize(own.mapInArrow(_signatures(k), _SIG), "signatures")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th")))
    classes = sig.where("n_shingles > 0").groupBy("n_shingles", "f1", "f2").agg(first.alias("r"), F.first("bands").alias("bands"))
    classes = C.materialize(classes.select("n_shingles", "f1", "f2", F.col("r.doc_id").alias("id"), F.col("r.th").alias("rth"),
                                           F.col("r.doc_id").alias("rep"), "bands"), "classes")
    # a class is the node of its smallest id; where classes share that id, their hash is the node
    twice = C.materialize(classes.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias("twice")), "twice")
    unique = twice.isEmpty()
    if not unique:
        node = F.when(F.col("twice").isNull(), F.col("id")).otherwise(F.xxhash64("n_shingles", "f1", "f2"))
        classes = C.materialize(classes.join(twice, F.col("id") == F.col("twice"), "left").withColumn("rep", node).drop("twice"), "classes")
    entries = classes.where("rep is not null").select(F.explode("bands").alias("key"), "rep", F.col("n_shingles").alias("n"))
    shared = entries.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("key")
    members = C.materialize(entries.join(shared, "key", "semi"), "members")
    ids = members.select("rep").distinct().join(classes.select("rep", "id", "rth"), "rep")
    texts = C.materialize(own.join(ids, (F.col("doc_id") == F.col("id")) & (F.col("th") == F.col("rth")))
                          .select(F.col("rep").alias("doc_id"), F.col("text").cast("binary").alias("text")), "texts")
    edges = None
    for t in _links(members, texts, k, percent):
        edges = t if edges is None else edges.union(t)
    comp = C.connected_components(edges.select(F.col("lead").alias("a"), F.col("rep").alias("b")))
    whole = classes.select("n_shingles", "f1", "f2", "id", "rth", "rep").join(comp, F.col("rep") == F.col("node"), "left") \
                   .withColumn("c", F.coalesce("component", "rep"))
    if unique:
        whole = whole.withColumn("component_id", F.col("c")).withColumn("first", F.col("c") == F.col("rep"))
    else:
        least = whole.where("c is not null").groupBy("c").agg(F.min(F.struct("id", "rth")).alias("m"))
        whole = whole.join(least, "c", "left").withColumn("component_id", F.col("m.id")) \
                     .withColumn("first", F.col("m") == F.struct("id", "rth"))
    s = sig.select("doc_id", "th", "n_shingles", "f1", "f2")
    out = s.join(whole.select("n_shingles", "f1", "f2", "id", "rth", "component_id", "first"), ["n_shingles", "f1", "f2"], "left")
    kept = F.when((F.col("n_shingles") == 0) | F.col("id").isNull(), F.lit(True)) \
            .otherwise(F.col("first") & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("rth")))
    return out.select("doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      kept.alias("kept"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept (the one row of its component that stays)."""
    return _judged(docs, k, percent, key, text).drop("th")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns."""
    verdict = C.materialize(_judged(docs, k, percent, key, text).where("doc_id is not null").select("doc_id", "th", "kept"), "verdict")
    at = F.col(key).cast("bigint"), F.xxhash64(F.col(text))
    gone = verdict.where("not kept").select(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).distinct()
    match = (at[0] == F.col("__d")) & (at[1] == F.col("__t"))
    stay = docs.join(gone, match, "anti")
    again = C.materialize(verdict.where("kept").groupBy("doc_id", "th").count().where("count > 1")
                          .select(F.col("doc_id").alias("__d"), F.col("th").alias("__t")), "again")
    if again.isEmpty():
        return stay
    return stay.join(again, match, "anti").unionByName(stay.join(again, match, "semi").dropDuplicates([key, text]))
