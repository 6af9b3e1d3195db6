import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldt.llm import exact_dedup as X
from veldt.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------- mixing

def fair_mix(rows, passes=3):
    """Counter of (doc_id, size, source, copies) from one global sort."""
    size = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    total = Counter()
    for r, n in zip(rows, size, strict=True):
        total[r[3]] += n
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: 1.0 + k % 3 for k, s in enumerate(order)}
    cum, queue = Counter(), []
    key = [(hashlib.md5(f"mix-1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, n)
           for r, n in zip(rows, size, strict=True)]
    for k in sorted(range(len(rows)), key=lambda k: key[k]):
        s = rows[k][3]
        cum[s] += size[k]
        queue += [((p * total[s] + cum[s]) / weight[s], order.index(s), p, key[k], k) for p in range(passes)]
    left, copies = sum(size), Counter()
    for *_, k in sorted(queue):
        left -= size[k]
        if left < 0:
            break
        copies[k] += 1
    return Counter((r[0], n, r[3], copies[k]) for k, (r, n) in enumerate(zip(rows, size, strict=True)))


def test_mix_is_the_cut_of_one_global_order(messy, messy_rows):
    for bin_rows in (20_000, 3):
        got = Counter((r["doc_id"], r["size"], r["source"], r["copies"]) for r in mixing.schedule(messy, rows_per_bin=bin_rows).collect())
        assert got == fair_mix(messy_rows)


def test_mix_returns_whole_rows_as_often_as_taken(messy):
    got = mixing.mix(messy)
    assert got.columns == messy.columns
    want = Counter()
    for r in mixing.schedule(messy).collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in got.collect()) == +want


def test_targets_share_out_what_small_sources_cannot_take(spark):
    src = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 500), (None, 490)], "source string, source_size long")
    t = {r["source"]: r["target"] for r in mixing.source_targets(src).collect()}
    assert t["b"] == 30 and abs(sum(t.values()) - 2000) < 1e-6
    assert abs(t["a"] - t[None]) < 1e-6 and abs(t["c"] - 3 * t["a"]) < 1e-6 or t["c"] == 1500


def test_mix_empty(empty):
    assert mixing.schedule(empty).count() == 0 and mixing.mix(empty).count() == 0


# ------------------------------------------------------------- sharding

def jump(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_function(spark):
    keys = [*range(500), -1, -(2**63), 2**63 - 1, 10**15]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 25, 200):
        assert {r["k"]: r["s"] for r in df.select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect()} == {k: jump(k, n) for k in keys}


@pytest.mark.parametrize("bin_rows", [200_000, 4])
def test_shards(messy, messy_rows, bin_rows):
    got = sharding.assign(messy, 5, rows_per_bin=bin_rows).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), jump(i or 0, 5), jump(i or 0, 6)) for i, t, *_ in messy_rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_empty_and_written(empty, messy, spark, tmp_path):
    assert sharding.assign(empty).count() == 0
    sharding.write_shards(messy, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == messy.count() and set(messy.columns) < set(back.columns)


# ------------------------------------------------------------- exact dedup

@given(st.sets(st.integers(0, 2**62), min_size=1, max_size=200))
def test_golomb_round_trip(values):
    v = np.array(sorted(values), np.uint64)
    assert (X.golomb_decode(X.golomb_encode(v)) == v).all()


def test_exact_dedup(messy, messy_rows):
    groups = defaultdict(list)
    for i, t, *_ in messy_rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = Counter()
    for norm, rows in groups.items():
        keep = min(rows)[3]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        for k, r in enumerate(sorted(rows)):
            want[r[3], keep, len(rows), k == 0, sha] += 1
    got = X.exact_dedup(messy.repartition(3)).collect()
    assert Counter(tuple(r) for r in got) == want


def test_exact_dedup_empty(empty):
    assert X.exact_dedup(empty).count() == 0
