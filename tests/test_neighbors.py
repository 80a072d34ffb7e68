"""The block join against brute force, on vectors with copies, ties, zeros and clusters."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lacuna import Roles
from lacuna.functions import vectors as V
from lacuna.operators import neighbors as N
from lacuna.operators.embed import covariance, in_metric_space, whitening
from lacuna.operators.impute import fill_table, nearest_donors
from lacuna.operators.tiles import closest, distances, prepare
from pyspark.sql import functions as F

METRICS = ("cosine", "manhattan", "chebyshev", "correlation", "euclidean")


def brute(x, y, metric):
    """Distances one pair at a time, straight from the definitions."""
    out = np.empty((len(x), len(y)))
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            p, r = a, b
            if metric == "correlation":
                if a.max() == a.min() or b.max() == b.min():
                    out[i, j] = np.inf
                    continue
                p, r = a - a.mean(), b - b.mean()
            if metric in ("cosine", "correlation"):
                n = np.sqrt(p @ p * (r @ r))
                out[i, j] = 1.0 if n == 0 else 1 - p @ r / n
            elif metric == "manhattan":
                out[i, j] = np.abs(p - r).sum()
            elif metric == "chebyshev":
                out[i, j] = np.abs(p - r).max()
            else:
                out[i, j] = np.sqrt(((p - r) ** 2).sum())
    return np.round(out, 12)


def sample(n=240, dim=6, seed=0):
    """Clusters, a third of the rows equal, some zero vectors."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(8, dim))[rng.integers(0, 8, n)] * 4 + rng.normal(size=(n, dim)) * 0.3, 2)
    x[: n // 3] = x[0]
    x[n // 3: n // 3 + 4] = 0
    return x[rng.permutation(n)]


def table(spark, x, **columns):
    rows = [(i, [float(v) for v in r], *[c[i] for c in columns.values()]) for i, r in enumerate(x)]
    extra = "".join(f", {c} double" for c in columns)
    return spark.createDataFrame(rows, f"id bigint, vec array<double>{extra}")


def expected_rows(x, metric, k):
    d = brute(x, x, metric)
    np.fill_diagonal(d, np.nan)
    found = set()
    for i in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), d[i])) if j != i][:k]
        found |= {(i, int(j)) for j in order}
    return found


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("tuning", [{}, {"block_rows": 16}, {"block_rows": 8, "n_pivots": 6}])
def test_rows_equal_brute_force(spark, metric, tuning):
    x = sample()
    got = N.nearest_rows(table(spark, x), "id", "vec", 4, metric, **tuning)
    assert {(r.row_id, r.donor_id) for r in got.collect()} == expected_rows(x, metric, 4)


def expected_cells(x, vals, metric, k):
    d = brute(x, x, metric)
    found = set()
    for i in range(len(x)):
        for f in range(vals.shape[1]):
            if np.isnan(vals[i, f]):
                donors = np.flatnonzero(~np.isnan(vals[:, f]))
                order = donors[np.lexsort((donors, d[i, donors]))][:k]
                found |= {(i, f, int(j)) for j in order}
    return found


@pytest.mark.parametrize("tuning", [{}, {"block_rows": 8, "n_pivots": 6}])
def test_cells_equal_brute_force(spark, tuning):
    x = sample(seed=1)
    rng = np.random.default_rng(2)
    vals = rng.integers(0, 5, size=(len(x), 3)).astype(float)
    vals[rng.random(vals.shape) < [0.3, 0.6, 0.985]] = np.nan  # the last feature has fewer donors than k
    cols = {f"f{j}": [None if np.isnan(v) else float(v) for v in vals[:, j]] for j in range(3)}
    roles = Roles("id", ("f0", "f1", "f2"))
    got = nearest_donors(table(spark, x, **cols), roles, k=5, **tuning)
    assert {(r.id, int(r.feature[1]), r.donor_id) for r in got.collect()} == expected_cells(x, vals, "cosine", 5)


def test_result_does_not_depend_on_partitioning(spark):
    df = table(spark, sample(seed=3))
    seen = [sorted(map(tuple, N.nearest_rows(df.repartition(n), "id", "vec", 3).collect())) for n in (1, 7)]
    assert seen[0] == seen[1]


def test_pruning_leaves_blocks_out(spark, monkeypatch):
    """Far clusters: most pairs of blocks are never computed, and the result stays exact."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 5)) * 100
    x = np.round(centres[np.repeat(np.arange(12), 40)] + rng.normal(size=(480, 5)), 3)
    got = N.nearest_rows(table(spark, x), "id", "vec", 3, "euclidean", block_rows=20, n_pivots=12)
    assert {(r.row_id, r.donor_id) for r in got.collect()} == expected_rows(x, "euclidean", 3)


def computed_share(spark, monkeypatch, x, metric, partitions, block_rows):
    """(share of all pairs that are computed, share of donor payloads shipped to teams), with the blocks cut from that many partitions."""
    groups = N.profiles(N.tag_rows(table(spark, x).repartition(partitions), "id", "vec", []), 4)
    references = np.array([r["vec"] for r in groups.table.orderBy(F.xxhash64("vec")).limit(N.REFERENCES).collect()])
    blocks = N.build_blocks(groups.table, groups.table, references, metric, block_rows, 4, 0, partitions, 4)
    dealt = N.deal(blocks, N.choose(blocks, N.SLOT_BLOCKS, 1), 8, 4)
    sent = dealt.where("is_donor").count() / (blocks.n * blocks.teams)
    made, tile = [], N.Tile
    with monkeypatch.context() as m:
        m.setattr(N, "Tile", lambda a, b, metric: made.append(len(a[0]) * len(b[0])) or tile(a, b, metric))
        rows = dealt.toPandas().sort_values(["team", "slot", "is_donor", "rank"])
        list(N._tile_task(4, metric, 0, "<f8")([rows]))
    return sum(made) / groups.n ** 2, sent


def test_pruning_does_not_depend_on_partitions(spark, monkeypatch):
    """As few pairs are computed with blocks cut in 64 tasks as in one, and donors go to few teams."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8)) * 20
    x = np.round(centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 8)), 4)
    one, sent_one = computed_share(spark, monkeypatch, x, "euclidean", 1, 50)
    many, sent_many = computed_share(spark, monkeypatch, x, "euclidean", 64, 50)
    print(one, many, sent_one, sent_many)
    assert many <= 1.5 * one < 0.3
    assert sent_many < 0.5 and sent_one < 0.5


def test_donors_travel_once_per_team_that_may_need_them(spark):
    x = sample(seed=8)
    groups = N.profiles(N.tag_rows(table(spark, x), "id", "vec", []), 4)
    blocks = N.build_blocks(groups.table, groups.table, x[:5], "cosine", 16, 4, 0, 2, 3)
    dealt = N.deal(blocks, N.choose(blocks, 2, 1), 5, 16)
    donors = dealt.where("is_donor").groupBy("team", "block").count().collect()
    assert blocks.teams >= 3 and all(r["count"] == 1 for r in donors)
    slots = {r["team"]: r["n"] for r in dealt.groupBy("team").agg((F.max("slot") + 1).alias("n")).collect()}
    queries = dealt.where("NOT is_donor").groupBy("team", "block").count().collect()
    assert all(r["count"] == slots[r["team"]] for r in queries)


@pytest.mark.parametrize("tuning", [{}, {"block_rows": 8, "n_pivots": 1}, {"block_rows": 8, "n_pivots": 12}])
def test_constant_vectors_have_the_lowest_keys(spark, tuning):
    """Correlation is infinite from a vector without spread to all others, whatever the references."""
    x = sample(seed=11)
    x[::6] = x[::6, :1]
    got = N.nearest_rows(table(spark, x), "id", "vec", 3, "correlation", **tuning)
    assert {(r.row_id, r.donor_id) for r in got.collect()} == expected_rows(x, "correlation", 3)


@pytest.mark.parametrize("kind,put", [("int", int), ("smallint", int), ("string", "k{:03d}".format), ("decimal(10,0)", None)])
def test_keys_of_any_type(spark, kind, put):
    x = sample(n=60, seed=9)
    df = table(spark, x)
    key = F.format_string("k%03d", "id") if kind == "string" else F.col("id").cast(kind)
    want = expected_rows(x, "cosine", 3)
    got = N.nearest_rows(df.withColumn("id", key), "id", "vec", 3)
    assert dict(got.dtypes)["donor_id"] == kind
    assert {(put(int(r.row_id)) if put and kind != "string" else r.row_id, r.donor_id) for r in got.collect()} == \
        {(put(i), put(j)) if put else (i, j) for i, j in want}
    holes = df.withColumn("id", key).withColumn("v", F.when(F.col("vec")[0] > 0, F.col("vec")[1]))
    filled = fill_table(holes, Roles("id", ("v",)), k=3)
    plain = fill_table(df.withColumn("v", F.when(F.col("vec")[0] > 0, F.col("vec")[1])), Roles("id", ("v",)), k=3)
    assert sorted(r.v for r in filled.collect()) == sorted(r.v for r in plain.collect())
    assert dict(filled.dtypes)["id"] == kind


def test_other_keys_need_a_number(spark):
    with pytest.raises(TypeError, match="bigint"):
        N.tag_rows(spark.createDataFrame([("a", [1.0])], "id string, vec array<double>"), "id", "vec", [])


def test_mahalanobis(spark):
    x = sample(seed=5)
    cov = np.cov(x, rowvar=False)
    assert np.allclose(covariance(table(spark, x), "vec"), cov)
    y = x @ whitening(cov)
    df, metric = in_metric_space(table(spark, x), "vec", "mahalanobis")
    got = {(r.row_id, r.donor_id): r.dist for r in N.nearest_rows(df, "id", "vec", 1, metric).collect()}
    d = brute(y, y, "euclidean")
    np.fill_diagonal(d, np.inf)
    for (i, j), dist in got.items():
        assert dist == pytest.approx(d[i].min(), abs=1e-6)


@pytest.mark.parametrize("metric", METRICS)
def test_column_form_equals_tile(spark, metric):
    x = sample(40, seed=6)
    a, b = table(spark, x), table(spark, x[::-1].copy()).withColumnRenamed("vec", "other")
    got = [r[0] for r in a.join(b, "id").orderBy("id").select(F.round(V.distance(metric, F.col("vec"), F.col("other")), 9)).collect()]
    want = np.round(np.diag(distances(prepare(x, metric), prepare(x[::-1].copy(), metric), metric)), 9)
    assert np.allclose(got, want, atol=1e-8)


def test_unknown_metric(spark):
    with pytest.raises(ValueError):
        N.nearest_rows(table(spark, sample(20)), "id", "vec", 2, "hamming")
    with pytest.raises(ValueError):
        V.distance("hamming", F.lit(1), F.lit(2))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 12), st.integers(1, 40), st.integers(0, 9999))
def test_closest_holds_the_k_smallest(k, rows, columns, seed):
    rng = np.random.default_rng(seed)
    d = rng.integers(0, 4, size=(rows, columns)).astype(float)
    keys = np.sort(rng.choice(1000, columns, replace=False))
    bound = rng.integers(0, 4, rows).astype(float) if seed % 2 else None
    i, j = closest(d, keys, k, bound)
    got = set(zip(i.tolist(), j.tolist()))
    for r in range(rows):
        want = [c for c in np.lexsort((keys, d[r])) if bound is None or d[r, c] <= bound[r]][:k]
        assert {(r, int(c)) for c in want} <= got


def cell_table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


ROLES = Roles("id", ("n",), ("c",), ("n",))
SCHEMA = "id bigint, vec array<double>, n double, c int"


def filled(spark, rows, k=5, roles=ROLES, **kw):
    return {r.id: r for r in fill_table(cell_table(spark, rows, SCHEMA), roles, k=k, **kw).collect()}


def test_mode_tie_takes_the_lowest_code(spark):
    rows = [(0, [1.0, 0.0], 1.0, None)] + [(i, [1.0, 0.01 * i], 1.0, c) for i, c in enumerate((2, 2, 1, 1), 1)]
    assert filled(spark, rows, k=4)[0].c == 1


def test_donors_are_sought_per_cell(spark):
    """The nearest rows share the hole: the next ones that have the cell are taken."""
    rows = [(0, [1.0, 0.0], None, 0), (1, [1.0, 0.01], None, 0), (2, [1.0, 0.02], None, 0), (3, [0.0, 1.0], 7.0, 0)]
    assert filled(spark, rows, k=1)[0].n == 7.0


def test_fewer_donors_than_k(spark):
    rows = [(0, [1.0, 0.0], None, 0), (1, [1.0, 1.0], 4.0, 0), (2, [0.0, 1.0], 8.0, 0)]
    assert filled(spark, rows)[0].n == 6.0


def test_feature_without_donor_stays_null(spark):
    rows = [(i, [1.0, float(i)], None, i) for i in range(4)]
    assert [r.n for r in filled(spark, rows).values()] == [None] * 4


def test_twins_serve_each_other(spark):
    rows = [(0, [1.0, 2.0], None, 0), (1, [1.0, 2.0], 5.0, 0), (2, [9.0, 1.0], 50.0, 0)]
    assert filled(spark, rows, k=1)[0].n == 5.0


def test_zero_vector_is_filled_by_key_order(spark):
    rows = [(0, [0.0, 0.0], None, 0), (1, [1.0, 0.0], 3.0, 0), (2, [0.0, 1.0], 9.0, 0)]
    assert filled(spark, rows, k=1)[0].n == 3.0


def test_integer_fill_is_truncated_towards_zero(spark):
    rows = [(0, [1.0, 0.0], None, 0), (1, [1.0, 0.1], -2.0, 0), (2, [1.0, 0.2], -3.0, 0)]
    assert filled(spark, rows)[0].n == -2.0


def test_observed_cells_stay_and_no_hole_is_left(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in rng.normal(size=3)], None if rng.random() < 0.4 else float(i),
             None if rng.random() < 0.4 else int(i % 3)) for i in range(60)]
    got = filled(spark, rows)
    for i, _, n, c in rows:
        assert got[i].n is not None and got[i].c is not None
        assert n is None or got[i].n == n
        assert c is None or got[i].c == c


def test_nan_is_a_hole_for_donors_and_queries(spark):
    """A twin with NaN serves nobody; the cell that is NaN gets a fill, whichever row of a profile comes first."""
    nan = float("nan")
    rows = [(1, [1.0, 0.0], nan, 0), (2, [1.0, 0.0], 5.0, 0), (3, [0.0, 1.0], 7.0, 0), (4, [1.0, 0.0], None, 0)]
    assert [filled(spark, rows, k=1)[i].n for i in (1, 2, 3, 4)] == [5.0, 5.0, 7.0, 5.0]
    rows = [(1, [1.0, 0.0], 5.0, 0), (2, [1.0, 0.0], nan, 0), (3, [0.0, 1.0], 9.0, 0), (4, [1.0, 0.0], None, 0)]
    assert [filled(spark, rows, k=2)[i].n for i in (1, 2, 3, 4)] == [5.0, 7.0, 9.0, 7.0]


@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
def test_rows_of_repeated_and_null_keys_stay(spark, kind):
    keys = [None, 3, 3, 5, None, 6]
    rows = [(k, [1.0, float(i)], None if i in (0, 2) else float(i), i) for i, k in enumerate(keys)]
    df = cell_table(spark, rows, SCHEMA).withColumn("id", F.col("id").cast(kind)).withColumn("vec", F.array(F.lit(1.0), F.col("c").cast("double")))
    got = sorted(((str(r.id), r.c, r.n) for r in fill_table(df, ROLES, k=1).collect()), key=lambda r: r[1])
    assert [(g[0], g[1]) for g in got] == [(str(k), i) for i, k in enumerate(keys)]
    assert all(g[2] is not None for g in got) and {g[1]: g[2] for g in got}[3] == 3.0


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_rows_of_one_key_do_not_serve_each_other(spark, kind):
    x = np.array([[1.0, 0.0], [1.0, 0.1], [1.0, 0.2], [0.0, 1.0], [0.1, 1.0]])
    df = table(spark, x).withColumn("id", F.when(F.col("id") < 4, F.col("id")).cast(kind))  # the last key is NULL
    got = {(None if r.row_id is None else int(r.row_id), None if r.donor_id is None else int(r.donor_id)) for r in N.nearest_rows(df, "id", "vec", 1).collect()}
    assert got == {(0, 1), (1, 2), (2, 1), (3, None), (None, 3)}
    same = table(spark, x).withColumn("id", F.lit(1).cast(kind))
    with pytest.raises(Exception, match="several rows"):
        N.nearest_rows(same, "id", "vec", 2, block_rows=2).collect()


def test_names_of_helper_columns(spark):
    x = sample(n=40, seed=12)
    df = table(spark, x).select(F.format_string("k%03d", "id").alias("__id"), F.col("vec").alias("__pos"))
    assert N.nearest_rows(df, "__id", "__pos", 2).count() == 80
    df = table(spark, x).select(F.format_string("k%03d", "id").alias("__value"), F.col("vec").alias("__number"))
    assert N.nearest_rows(df, "__value", "__number", 2).count() == 80


def test_vectors_must_exist(spark):
    for bad in (None, [1.0, None], [1.0, float("nan")], [1.0]):
        df = spark.createDataFrame([(1, [1.0, 2.0]), (2, bad)], "id bigint, vec array<double>")
        with pytest.raises(ValueError, match="vectors must exist"):
            N.nearest_rows(df, "id", "vec", 1)
