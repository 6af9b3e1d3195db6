import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.conftest import make, prose
from tests.llm.test_decontam import ITEM, SAME
from tests.llm.test_minhash import brute
from tests.llm.test_mixing_sharding_dedup import fair_mix, jump
from veldt.llm import queries


def test_pipeline_against_brute_force(spark, tmp_path):
    rng, rows = random.Random(6), []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        text = prose(rng, 50, 4000).replace("w", "the" if lang == "en" else "und")
        rows.append((i * 3, text, lang, f"s{i % 4}"))
        if i % 10 == 0:
            rows.append((i * 3 + 1, text + " end", lang, f"s{i % 4}"))
        if i % 15 == 0:
            rows.append((i * 3 + 2, text[:80] + " " + (ITEM if i % 2 else SAME), lang, None))
    rows += [(900, None, "en", "s1"), (901, "12 34 !!", None, "s1"), (902, "", "de", "s2")]
    make(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [r for r in rows if r[0] < 900]
    stay = {i for i, n, c in brute(left, 5, 80) if i == c}
    left = [r for r in left if r[0] in stay and "the red market" not in (r[1] or "")]
    want = Counter()
    for (i, _, _, copies), n in fair_mix(left).items():
        want[i, jump(i, 24)] += copies * n
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["shard"]) for r in got) == +want
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_stages_return_the_columns_of_documents(spark):
    docs = queries.table(spark, SF_SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF_SMALL).columns == docs.columns, name


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles_agree(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df, sql = queries.QUERIES[name](spark, SF_SMALL), con.execute(queries.ORACLES[name])
    names = [c[0] for c in sql.description]
    assert sorted(names) == sorted(df.columns)

    def canon(rows, cols):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        return Counter(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows)

    assert canon(df.collect(), df.columns) == canon(sql.fetchall(), names)


def test_every_query_has_an_oracle_or_a_reason():
    names = {*queries.QUERIES, "pipeline"}
    assert names == set(queries.ORACLES) | set(queries.NO_ORACLE) and not set(queries.ORACLES) & set(queries.NO_ORACLE)
