"""Exact top-k search by inner product over a pivot-distance index.

Index: components become integers (floor(scale * x)).  A few pivots are taken
from a bounded sample, far apart; every vector is keyed by its nearest pivot
and by the distance r to it.  Quantiles of r cut each pivot's vectors into
annuli, annuli are dealt by hash into pieces of about ``PIECE`` vectors, and a
piece is one row of packed integers.  The directory of annuli (their range of
r, longest vector, size) has at most ``MAX_PIVOTS * MAX_RINGS`` rows.

Search: a vector x of an annulus [r1, r2] of pivot p lies at least
g = max(0, r1 - |q - p|, |q - p| - r2) away from a query q, so
2 <q, x> = |q|^2 + |x|^2 - |q - x|^2 is at most |q|^2 + max|x|^2 - g^2; and
<q, x> is at most <q, p> + |q| r2.  Each query expands its annuli in the order
of that bound, a few in the first round and ``GROW`` times as many in each next
one, and stops at the first whose bound is under its k-th best score so far.
Blocks of queries meet ``SEGMENT`` pieces in one tile: a stream that brings the
pieces, then the query blocks, so a task holds one segment, and tiles of a much
asked annulus are dealt over many tasks.  Nothing is approximate and no
candidate is capped; with vectors that have no structure the bounds stop
nothing, and every query meets every piece once.

Defined cases: vectors that are null or hold null or non-finite components
(or ones that ``scale`` makes infinite) take no part; shorter vectors count as
filled up with zeros; rows that agree in id and vector are as many candidates
as there are rows, and as queries are answered once, each without one row of
its own; a null id is no query, and as a candidate it comes last among equal
scores; scores beyond a long raise an error; other columns do not matter; an
empty table or one without queries gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm import common as C

SCALE = 1024
#: rows from which pivots are taken
PIVOT_SAMPLE = 2048
MAX_PIVOTS = 64
#: annuli of one pivot at most (a power of two), and vectors of one at least
MAX_RINGS = 64
RING_ROWS = 1024
#: vectors of a packed row, packed rows of a tile
PIECE = 1024
SEGMENT = 16
#: queries of a block, blocks that one tile takes on average
QUERY_BLOCK = 256
QUERY_SLICE = 64
#: annuli of the first round, and how many times more each next round takes
FIRST = 2
GROW = 8

_LEAST = np.iinfo(np.int64).min
_SHIFT = 1 << 32


# ------------------------------------------------------------- vectors

def _quantised(rows: DataFrame, key: str, vector: str, is_query: Column, scale: float) -> DataFrame:
    """(id, v, asked): v holds floor(scale * x) as doubles; vectors without part are left out."""
    v = F.col("v")
    out = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"),
                      F.coalesce(is_query, F.lit(False)).alias("asked"))
    out = out.where(v.isNotNull() & F.forall(v, lambda x: F.abs(x * F.lit(float(scale))) < F.lit(float("inf"))))

    def whole(x: Column) -> Column:  # doubles from 2^53 on are whole already
        y = x * F.lit(float(scale))
        return F.when(F.abs(y) < F.lit(2.0**53), F.floor(y).cast("double")).otherwise(y)

    return out.select("id", F.transform(v, whole).alias("v"), "asked")


def far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows, each the farthest from those before; the first is nearest to the mean."""
    sample = np.unique(sample, axis=0)
    if not len(sample):
        return sample
    at = int(np.argmin(((sample - sample.mean(axis=0)) ** 2).sum(axis=1)))
    picked, near = [at], ((sample - sample[at]) ** 2).sum(axis=1)
    while len(picked) < count and near.max() > 0:
        at = int(np.argmax(near))
        picked.append(at)
        near = np.minimum(near, ((sample - sample[at]) ** 2).sum(axis=1))
    return sample[picked]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every row to every pivot, from differences (nothing cancels)."""
    out = np.empty((len(x), len(pivots)))
    for k, p in enumerate(pivots):
        out[:, k] = np.sqrt(((x - p) ** 2).sum(axis=1))
    return out


_KEYED = "id long, copies long, asked boolean, v array<double>, pivot int, r double, length double"


def _key(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), pivots.shape[1])
            d = distances(x, pivots)
            near = d.argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), b.column(1), pa.array(near), pa.array(d[np.arange(len(x)), near]),
                 pa.array(np.sqrt((x ** 2).sum(axis=1)))], names=["id", "copies", "asked", "v", "pivot", "r", "length"])

    return run


# ------------------------------------------------------------- packed rows

_PACKED = "grp long, part int, n int, nulls int, kind string, ids binary, copies binary, vecs binary"


def _pack(width: int):
    """One packed row of a group: ids in rising order, null ids last."""
    def run(t: pa.Table) -> pa.Table:
        null = t.column("id").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        ids = t.column("id").combine_chunks().fill_null(0).to_numpy()
        order = np.lexsort((ids, null))
        x = _matrix(t.column("v"), width)[order]
        top = float(np.abs(x).max()) if x.size else 0.0
        kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
        one = [t.column("grp")[0].as_py(), t.column("part")[0].as_py(), len(ids), int(null.sum()), kind, ids[order].astype("<i8").tobytes(),
               t.column("copies").to_numpy()[order].astype("<i8").tobytes(), x.astype(kind).tobytes()]
        return pa.table([pa.array([v], f.type) for v, f in zip(one, _PACKED_SCHEMA, strict=True)], schema=_PACKED_SCHEMA)

    return run


_PACKED_SCHEMA = pa.schema([("grp", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("nulls", pa.int32()), ("kind", pa.string()),
                            ("ids", pa.binary()), ("copies", pa.binary()), ("vecs", pa.binary())])


class _Block:
    """A packed row in memory."""

    def __init__(self, n: int, nulls: int, kind: str, ids: bytes, copies: bytes, vecs: bytes, width: int):
        self.ids, self.copies = np.frombuffer(ids, "<i8"), np.frombuffer(copies, "<i8")
        self.known = n - nulls
        self.x = np.frombuffer(vecs, kind).reshape(n, width).astype(np.float64)
        self.squares = (self.x ** 2).sum(axis=1)
        self.longest = float(np.sqrt(self.squares.max())) if n else 0.0


class Directory:
    """Pivots and annuli: everything that the bounds need, of bounded size."""

    def __init__(self, pivots: np.ndarray, annuli: list):
        self.pivots = pivots
        self.annulus = np.array([a["annulus"] for a in annuli], np.int64)
        self.low, self.high, self.longest = (np.array([a[c] for a in annuli], np.float64) for c in ("low", "high", "longest"))
        self.segments = np.array([-(-a["pieces"] // SEGMENT) for a in annuli], np.int64)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No vector of annulus j has a higher inner product with query i than bounds[i, j]."""
        at = self.annulus // MAX_RINGS
        d = distances(q, self.pivots)[:, at]
        gap = np.maximum(0.0, np.maximum(self.low - d, d - self.high))
        square = (q ** 2).sum(axis=1)[:, None]
        by_gap = (square + self.longest ** 2 - gap ** 2) / 2
        by_pivot = (q @ self.pivots.T)[:, at] + np.sqrt(square) * self.high
        return np.minimum(by_gap, by_pivot) + 1e-9 * (square + self.longest ** 2 + self.high ** 2) + 1e-6  # rounding


# ------------------------------------------------------------- rounds

def _thresholds(n: int, tau) -> np.ndarray:
    out = np.full(n, _LEAST, np.int64)
    for one in tau or ():
        out[one["pos"]] = one["score"]
    return out


def _open(directory: Directory, width: int, lo: int, hi: int):
    """(qb, annulus, segments, mask): annuli at places lo to hi - 1 of a query's order that can still hold a better vector."""
    names = ["qb", "annulus", "segments", "mask"]
    schema = pa.schema([("qb", pa.int64()), ("annulus", pa.int64()), ("segments", pa.int64()), ("mask", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                q = np.frombuffer(r["vecs"], r["kind"]).reshape(r["n"], width).astype(np.float64)
                bound = directory.bounds(q)
                place = np.empty_like(bound, np.int64)
                order = np.argsort(-bound, axis=1, kind="stable")
                np.put_along_axis(place, order, np.arange(bound.shape[1])[None, :], axis=1)
                still = (place >= lo) & (place < hi) & (bound >= _thresholds(r["n"], r["tau"])[:, None])
                rows += [(r["grp"], int(directory.annulus[j]), int(directory.segments[j]), np.packbits(still[:, j]).tobytes())
                         for j in np.flatnonzero(still.any(axis=0))]
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows], schema=schema)

    return run


def _scores(q: np.ndarray, block: _Block) -> np.ndarray:
    """Exact inner products: doubles below 2^53, else 64-bit integers."""
    top = float(np.sqrt((q ** 2).sum(axis=1).max())) * block.longest
    if top < 2**53:
        return q @ block.x.T
    if top >= 2**63:
        raise OverflowError("an inner product does not fit into a long")
    return q.astype(np.int64) @ block.x.astype(np.int64).T


def _best_of(q: np.ndarray, ids: np.ndarray, known: np.ndarray, tau: np.ndarray, blocks: list[_Block], k: int):
    """(query, score, null id, id, copies) of all rows that can be among a query's k best, k of each at most."""
    found = [np.zeros((0, 5), np.int64)]
    for block in blocks:
        s = _scores(q, block)
        copies = np.broadcast_to(block.copies, s.shape)
        first = np.searchsorted(block.ids[:block.known], ids)
        last = np.searchsorted(block.ids[:block.known], ids, side="right")
        own = np.zeros(s.shape, bool)
        for i in np.flatnonzero((last > first) & known):
            same = np.flatnonzero((block.x[first[i]:last[i]] == q[i]).all(axis=1)) + first[i]
            own[i, same] = True
        s = s.astype(np.int64)
        s[own & (copies == 1)] = _LEAST
        if s.shape[1] > k:
            tau = np.maximum(tau, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
        i, j = np.nonzero((s >= tau[:, None]) & (s != _LEAST))
        found.append(np.stack([i, s[i, j], (j >= block.known).astype(np.int64), block.ids[j], block.copies[j] - own[i, j]], axis=1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
    start = np.searchsorted(rows[:, 0], np.arange(len(q)))
    return rows[np.arange(len(rows)) - start[rows[:, 0]] < k]


_HITS = "qb long, pos int, query_id long, score long, vec_id long, copies long"
_HIT_SCHEMA = pa.schema([("qb", pa.int64()), ("pos", pa.int32()), ("query_id", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64()),
                         ("copies", pa.int64())])


def _tiles(width: int, k: int):
    """Stream of rows sorted by tile: the tile's pieces, then its query blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, blocks = None, []
        for b in batches:
            for r in b.to_pylist():
                if tile != (r["seg"], r["qs"]):
                    tile, blocks = (r["seg"], r["qs"]), []
                block = _Block(r["n"], r["nulls"], r["kind"], r["ids"], r["copies"], r["vecs"], width)
                if r["mask"] is None:
                    blocks.append(block)
                    continue
                at = np.flatnonzero(np.unpackbits(np.frombuffer(r["mask"], np.uint8))[:r["n"]])
                rows = _best_of(block.x[at], block.ids[at], at < block.known, _thresholds(r["n"], r["tau"])[at], blocks, k)
                if len(rows):
                    pos = at[rows[:, 0]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), r["qb"])), pa.array(pos.astype(np.int32)), pa.array(block.ids[pos]), pa.array(rows[:, 1]),
                         pa.array(rows[:, 3], mask=rows[:, 2] == 1), pa.array(rows[:, 4])], schema=_HIT_SCHEMA)

    return run


def _meet(pieces: DataFrame, blocks: DataFrame, pairs: DataFrame, width: int, k: int) -> DataFrame:
    """Hits of all (segment, query block) pairs."""
    spark = pieces.sparkSession
    payload = ["n", "nulls", "kind", "ids", "copies", "vecs"]
    tau = blocks.schema["tau"].dataType
    asked = pairs.join(blocks, "qb").select("seg", "qs", F.lit(1).alias("ord"), F.lit(0).alias("part"), "qb", *payload, "mask", "tau")
    held = pairs.select("seg", "qs").distinct().join(pieces.withColumnRenamed("grp", "seg"), "seg") \
        .select("seg", "qs", F.lit(0).alias("ord"), "part", F.lit(0).cast("long").alias("qb"), *payload,
                F.lit(None).cast("binary").alias("mask"), F.lit(None).cast(tau).alias("tau"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return held.unionByName(asked).repartition(tasks, "seg", "qs").sortWithinPartitions("seg", "qs", "ord", "part", "qb") \
        .mapInArrow(_tiles(width, k), _HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qb", "pos").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


# ------------------------------------------------------------- operator

def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = SCALE, key: str = "vec_id",
                vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of every query's vector with
    the other rows' vectors, ties to the smaller id."""
    spark = vectors.sparkSession
    C.small_batches(spark)
    rows = _quantised(vectors, key, vector, is_query, scale)
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("most"), F.min(F.size("v")).alias("least"),
                     F.count_if("asked").alias("asked")).first()
    if not shape["asked"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = shape["most"]
    if shape["least"] < width:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))

    sample = rows.select("v").orderBy(F.xxhash64("id", "v")).limit(PIVOT_SAMPLE).toArrow()
    pivots = far_apart(_matrix(sample.column(0), width), min(MAX_PIVOTS, max(1, int(shape["n"] ** 0.5 / 8))))
    once = rows.groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"), F.max("asked").alias("asked"))
    keyed = C.materialize(once.select("id", "v", "copies", "asked").mapInArrow(_key(pivots), _KEYED), "keyed")

    steps = [j / MAX_RINGS for j in range(1, MAX_RINGS)]
    cuts = []
    for p in keyed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("r", steps).alias("q")).collect():
        rings = 1 << min(MAX_RINGS, max(1, p["n"] // RING_ROWS)).bit_length() - 1
        by = MAX_RINGS // rings
        cuts.append((p["pivot"], [float(x) for x in p["q"][by - 1::by]]))
    cuts = spark.createDataFrame(cuts, "pivot int, cuts array<double>")  # one row a pivot
    ringed = keyed.join(F.broadcast(cuts), "pivot") \
        .withColumn("annulus", F.col("pivot").cast("long") * MAX_RINGS + F.size(F.filter("cuts", lambda c: c < F.col("r"))))
    annuli = ringed.groupBy("annulus").agg(
        F.ceil(F.count(F.lit(1)) / PIECE).alias("pieces"), F.ceil(F.count_if("asked") / QUERY_BLOCK).alias("blocks"), F.min("r").alias("low"),
        F.max("r").alias("high"), F.max("length").alias("longest")).orderBy("annulus").collect()  # at most MAX_PIVOTS * MAX_RINGS rows
    directory = Directory(pivots, annuli)
    sizes = spark.createDataFrame([(a["annulus"], a["pieces"], a["blocks"]) for a in annuli], "annulus long, pieces long, blocks long")

    dealt = ringed.join(F.broadcast(sizes), "annulus").select("id", "copies", "asked", "v", "annulus", "blocks", F.xxhash64("id", "v").alias("h"), "pieces")
    to = F.pmod("h", "pieces")
    pieces = dealt.select("id", "copies", "v", (F.col("annulus") * _SHIFT + F.floor(to / SEGMENT)).alias("grp"), (to % SEGMENT).cast("int").alias("part"))
    pieces = C.materialize(pieces.groupBy("grp", "part").applyInArrow(_pack(width), _PACKED), "pieces")
    asked = dealt.where("asked").select("id", "copies", "v", (F.col("annulus") * _SHIFT + F.pmod("h", "blocks")).alias("grp"), F.lit(0).alias("part"))
    asked = C.materialize(asked.groupBy("grp", "part").applyInArrow(_pack(width), _PACKED), "asked")
    slices = -(-sum(a["blocks"] for a in annuli) // QUERY_SLICE)

    best, lo, hi = None, 0, FIRST
    while lo < len(annuli):
        if best is None:
            blocks = asked.withColumn("tau", F.lit(None).cast("array<struct<pos:int,score:bigint>>"))
        else:
            last = best.where(F.col("place") == k).groupBy("qb").agg(F.collect_list(F.struct("pos", "score")).alias("tau"))  # QUERY_BLOCK at most
            blocks = asked.join(last.withColumnRenamed("qb", "grp"), "grp", "left")
        pairs = blocks.select("grp", "n", "kind", "vecs", "tau").mapInArrow(_open(directory, width, lo, hi),
                                                                           "qb long, annulus long, segments long, mask binary")
        pairs = C.materialize(pairs.select("qb", "mask", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)).alias("s"), "annulus")
                              .select("qb", "mask", (F.col("annulus") * _SHIFT + F.col("s")).alias("seg"),
                                      F.pmod(F.xxhash64("qb"), F.lit(slices)).cast("int").alias("qs")), "pairs")
        if pairs.isEmpty():
            break
        hits = _meet(pieces, blocks.withColumnRenamed("grp", "qb"), pairs, width, k)
        new = C.materialize(_ranked(hits if best is None else hits.unionByName(best.drop("place")), k), "best")
        if best is not None:
            C.discard(best)
        best, lo, hi = new, hi, hi * GROW

    # copies of one row stand side by side
    before = Window.partitionBy("qb", "pos").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("before", F.coalesce(F.sum("copies").over(before), F.lit(0))) \
        .select("query_id", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.least(F.col("copies"), F.lit(k)))).alias("rank"), "vec_id", "score") \
        .where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
