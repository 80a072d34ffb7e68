"""The pipeline's stages against brute force on a small folder, and the registered queries on the smallest tables."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from compare import compare, duck
from lacuna.llm import bytecnn, queries
from test_llm_operators import brute_contamination, brute_groups, brute_targets, prose

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("tables"))
    junk = lambda i: " ".join(w.upper() + "!!##" for w in prose(i, 60).split())
    rows = [(i, prose(i, 80) if i % 3 else junk(i), "en", f"s{i % 4}", None) for i in range(1, 200)]
    rows += [(300 + i, prose(i, 80) + " tail", "de", None, 5) for i in (1, 2, 4, 5)]  # near copies
    rows += [(400, prose(7, 30) + " " + prose(900, 12), "en", "s1", None), (401, None, None, None, None), (402, "", "en", "s0", 0),
             (7, prose(7, 80), "en", "s1", 1), (7, prose(7, 80), "en", "s1", 1), (None, prose(77, 40), "en", "s2", 1), (None, None, None, None, None)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(1, 200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(1, prose(900, 12)), (2, None), (3, prose(11, 20))], "item_id bigint, text string").write.parquet(f"{place}/benchmark.parquet")
    return place


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=repr)


def test_stages_are_the_five():
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "near duplicates", "benchmark decontamination", "mixture", "sharding"]
    assert pipeline.ORACLE_SQL is None


def test_stages(spark, folder, tmp_path):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(i)))
        kept.append((docs, spark.read.parquet(str(tmp_path / str(i)))))
        docs = kept[-1][1]
        if i < 4:
            assert docs.dtypes == kept[0][0].dtypes

    before, after = kept[0]
    net = bytecnn.fit_on(before, spark.read.parquet(f"{folder}/labels.parquet"))
    score = net.score([r["text"] or "" for r in before.collect()])
    assert rows_of(after) == sorted((tuple(r) for r, s in zip(before.collect(), score) if s >= pipeline.QUALITY), key=repr)
    assert {r[0] for r in rows_of(after)} >= {i for i in range(1, 200) if i % 3}  # clean documents stay
    assert not {r[0] for r in rows_of(after)} & {i for i in range(1, 200) if i % 3 == 0}

    before, after = kept[1]
    given = [(r[0], r[1]) for r in rows_of(before)]
    groups, count = brute_groups(given, pipeline.SIMILARITY)
    assert after.count() == count
    assert Counter(r[0] for r in rows_of(after) if r[0]) == Counter({c: 1 for _, _, c in groups if c})

    before, after = kept[2]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    dirty = {r[0] for r in brute_contamination([(i, r[1]) for i, r in enumerate(rows_of(before))], items) if r[2]}
    assert dirty and rows_of(after) == [r for i, r in enumerate(rows_of(before)) if i not in dirty]

    before, after = kept[3]
    size, taken = Counter(), Counter()
    for _, text, _, source, _ in rows_of(before):
        size[source] += len((text or "").split())
    copies = Counter(rows_of(after))
    for r, n in copies.items():
        taken[r[3]] += n * len((r[1] or "").split())
        assert n <= pipeline.EPOCHS * rows_of(before).count(r)
    want = brute_targets(dict(size), pipeline.WEIGHTS, pipeline.EPOCHS)
    assert all(abs(taken[s] - want[s]) <= 80 for s in want)

    before, after = kept[4]
    assert rows_of(after) == rows_of(before)
    sizes = Counter(r["shard"] for r in after.collect())
    assert set(sizes) == set(range(pipeline.SHARDS)) and max(sizes.values()) - min(sizes.values()) <= 1


def test_stages_on_nothing(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    place = "/root/testdata/sf0.001"
    same, n, detail = compare(spark, duck(place), place, name, queries.QUERIES[name], queries.ORACLES.get(name))
    assert same is not False, detail
    counts = {"op1": 500, "op11": 20, "op12": 250}
    assert n == counts.get(name.split("_")[0], 200)


def test_decisions_on_real_tables(spark):
    """Every contaminated, repeated or rejected document of the smallest tables is decided alike by query and operator."""
    place = "/root/testdata/sf0.001"
    kept = {r[0] for r in queries.QUERIES["op7_min_max_hashing"](spark, place).where("kept").select("doc_id").collect()}
    docs = spark.read.parquet(f"{place}/documents.parquet")
    from lacuna.llm.minmax import deduplicate
    assert {r[0] for r in deduplicate(docs).select("doc_id").collect()} == kept
    assert docs.where(~F.col("doc_id").isin(list(kept))).count() == 200 - len(kept)
