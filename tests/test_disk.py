"""What travels between tasks and what stays on the disk: no text, no profile that neither asks nor gives, one wave at a time."""

from __future__ import annotations

import os
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna import Roles, scratch
from lacuna.operators import embed, neighbors as N
from lacuna.operators.impute import nearest_donors
from lacuna.operators.tiles import distances, prepare

ROLES = Roles("id", ("n",), ("label",))


def _shuffle_files(spark):
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def _written(spark, label):
    home = urlparse(scratch.own_folder(spark)).path
    return {n for n in os.listdir(home) if n.startswith(label + "-")} if os.path.isdir(home) else set()


def test_a_lean_cut_leaves_no_shuffle_files(spark):
    settings, before = {k: spark.conf.get(k, None) for k in scratch.LEAN}, _shuffle_files(spark)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("a")).count()
    made = [scratch.cut(df, "lean", lean=True), scratch.cut_counted(df, "lean", lean=True)[0], scratch.cut_parts([df, df], "lean", lean=True)]
    assert not _shuffle_files(spark) - before and {k: spark.conf.get(k, None) for k in scratch.LEAN} == settings
    assert [t.count() for t in made] == [7, 7, 14]


def test_a_dropped_table_is_gone(spark):
    table, other = scratch.cut(spark.range(5), "dropped"), scratch.cut(spark.range(5), "dropped")
    parts = scratch.cut_parts([spark.range(2), spark.range(3)], "dropped")
    assert parts.count() == 5
    files = table.inputFiles() + parts.inputFiles()
    scratch.drop_table(table)
    scratch.drop_table(parts)
    assert not any(os.path.exists(urlparse(f).path) for f in files) and other.count() == 5


def test_rows_are_picked_where_they_lie(spark):
    """A bit per row decides, whatever the numbers; no row is moved."""
    rows = scratch.cut(spark.range(0, 40_000, 1, 3).select(F.col("id"), F.monotonically_increasing_id().alias("row")), "numbered")
    taken = rows.where("pmod(xxhash64(id), 3) = 0").select("row")
    got = embed._numbered(rows, "row", taken)
    want = {r[0] for r in rows.join(taken, "row").select("id").collect()}
    assert got.columns == ["id", "row"] and sorted(r.id for r in got.collect()) == sorted(want) and len(want) > 10_000
    plan = embed._numbered(rows, "row", rows.select("row"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(row" not in plan and "SortMergeJoin" not in plan and "BroadcastExchange" in plan
    assert embed._numbered(rows, "row", taken.where("row < 0")).count() == 0


def test_texts_are_deleted_and_encoded_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def make():
        def encode(texts):
            seen.add(len(texts))
            return np.array([[len(t), 2.0] for t in texts], np.float32)
        return encode

    texts = [None if i % 50 == 7 else f"t{i % 40} " * (i % 40) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string").repartition(5)
    before = _written(spark, "texts")
    made = embed.embed_text(df, "t", make, 4, limit=None)
    got = {r.id: r.vec for r in made.collect()}
    assert got == {i: None if t is None else [len(t), 2.0] for i, t in enumerate(texts)}
    assert _written(spark, "texts") == before
    assert seen.value == len({t for t in texts if t is not None})


def _labelled(spark, n=600):
    """Rows of which two in five have a label; nothing else is missing."""
    pick = np.random.default_rng(11)
    x = np.round(pick.standard_normal((n, 4)) * 3, 1)
    label = [int(i % 3) if i % 5 < 2 else None for i in range(n)]
    rows = [(i, float(i), label[i], [float(v) for v in x[i]]) for i in range(n)]
    return x, label, spark.createDataFrame(rows, "id bigint, n double, label int, vec array<double>")


def _expected(x, label, k):
    d = distances(prepare(x, "euclidean"), prepare(x, "euclidean"), "euclidean")
    donors = np.array([i for i, v in enumerate(label) if v is not None])
    return {(i, int(j)) for i, v in enumerate(label) if v is None for j in donors[np.lexsort((donors, d[i, donors]))][:k]}


def test_only_profiles_that_ask_or_give_travel(spark, monkeypatch):
    """Rows without a hole are no queries, rows without a wanted cell are no donors: neither is dealt to a task."""
    x, label, df = _labelled(spark)
    sent, inner = [], N.deal

    def watched(*args):
        dealt = inner(*args)
        sent.append((args[0], dealt.groupBy("is_donor").agg(F.sum("n")).collect(), dealt.agg(F.max("team"), F.max("slot")).first()))
        return dealt

    monkeypatch.setattr(N, "deal", watched)
    got = nearest_donors(df, ROLES, k=3, metric="euclidean", block_rows=16)
    assert {(r.id, r.donor_id) for r in got.collect()} == _expected(x, label, 3) and {r.feature for r in got.collect()} == {"label"}
    ((_, rows, (team, slot)),) = sent
    rows = dict(rows)
    assert rows[True] <= 240 * (team + 1) and rows[False] <= 360 * (slot + 1)


def test_teams_take_turns_in_waves(spark, monkeypatch):
    """With hardly any room every team is a wave of its own; donors are those of all pairs and no shuffle file is left."""
    x, label, df = _labelled(spark)
    monkeypatch.setattr(N, "WAVE_BYTES", 1)
    monkeypatch.setattr(N, "TEAM_BYTES", 1 << 14)
    dealt, inner, blocks = [], N.deal, _written(spark, "blocks")
    monkeypatch.setattr(N, "deal", lambda *args: dealt.append(1) or inner(*args))
    got = nearest_donors(df, ROLES, k=3, metric="euclidean", block_rows=16)
    assert {(r.id, r.donor_id) for r in got.collect()} == _expected(x, label, 3)
    assert len(dealt) > 5 and _written(spark, "blocks") == blocks


@pytest.mark.parametrize("sizes,most,want", [
    ({}, 10, []), ({0: 50}, 10, [(0, 0)]), ({0: 4, 1: 6, 2: 1}, 10, [(0, 1), (2, 2)]), ({3: 4, 7: 20, 9: 3, 4: 5}, 10, [(3, 4), (7, 7), (9, 9)])])
def test_waves_are_bounded(sizes, most, want):
    assert N.waves(sizes, most) == want


def test_no_hole_and_no_donor(spark):
    _, _, df = _labelled(spark, 40)
    for none in (df.where("label IS NOT NULL"), df.withColumn("label", F.lit(None).cast("int")), df.limit(0)):
        assert nearest_donors(none, ROLES, k=3, metric="euclidean").count() == 0


@pytest.mark.parametrize("metric", ["cosine", "manhattan"])
def test_crowded_tiles_are_searched_in_strips(metric, monkeypatch):
    """Most pairs are as near as the bound: no more of them than a strip holds are looked at together."""
    x = np.random.default_rng(2).integers(0, 2, (96, 3)).astype(float)
    vals = np.stack([np.where(np.arange(96) % 2, np.nan, 1.0)], axis=1)
    far, ids = np.zeros((96, 1)), np.arange(96)
    row = {"n": 96, "ids": np.stack([ids, ids], axis=1).tobytes(), "mat": x.tobytes(), "counts": np.ones(96, np.int32).tobytes(), "keys": ids.tobytes(), "vals": vals.tobytes(),
           "far": far.tobytes(), "lo": far[0].tobytes(), "hi": far[0].tobytes(), "bound": np.full((1, 96), 3.0).tobytes()}
    monkeypatch.setattr(N, "STRIP_PAIRS", 200)
    asked, inner = [], N.Tile.exact
    monkeypatch.setattr(N.Tile, "exact", lambda self, i, j: asked.append(len(i)) or inner(self, i, j))
    best = N._Best(N.Block(row, False, metric, 1, "<f8"), 3, 1)
    best.add([N.Block(row, True, metric, 1, "<f8")], metric)
    found = pd.concat(best.rows())
    assert len(asked) > 10 and max(asked) <= 200
    d = distances(prepare(x, metric), prepare(x, metric), metric)
    for q, got in found.groupby("h1"):
        assert [*zip(got["dist"], got["key"])] == sorted(zip(d[q][::2], range(0, 96, 2)))[:3]
    assert found["h1"].nunique() == 48
