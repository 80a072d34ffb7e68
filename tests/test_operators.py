"""Edge cases of the other operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna import Roles
from lacuna.functions import randomness as R
from lacuna.functions import text as T
from lacuna.functions import vectors as V
from lacuna.operators import ampute as A
from lacuna.operators import cells as C
from lacuna.operators import coding, fidelity, learn, pairs, position, split, utility
from lacuna.operators.embed import HashEncoder, embed_text, embed_tokens, hash_vectors
from lacuna.plans.experiment import Settings, evaluate, experiment, prepare, row_vectors
from lacuna import scratch
from lacuna.scratch import new_path
from lacuna.sources import catalog, tables
from lacuna.sources.arff import parse_attribute, read_arff
from lacuna.sources.delimited import read_delimited

ROLES = Roles("id", ("x", "y"), ("c",), ("y",), "c")


def numbers(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, float(rng.normal() * 50 + 1000), float(i % 17), int(rng.integers(0, 4))) for i in range(n)],
                                 "id bigint, x double, y double, c int")


# ---------------------------------------------------------------- roles, cells

def test_roles_are_checked():
    for bad in ({"continuous": ("a", "a")}, {"continuous": ("a",), "integer": ("b",)}, {"continuous": ("k",)}, {"continuous": ("a",), "target": "b"}):
        with pytest.raises(ValueError):
            Roles("k", **bad)


def test_assert_no_holes_names_the_column(spark):
    df = spark.createDataFrame([(1, None)], "id bigint, x double")
    with pytest.raises(ValueError, match="x"):
        C.assert_no_holes(df, ["x"])


def test_cells_and_back(spark):
    df = numbers(spark, 20)
    back = C.from_cells(C.to_cells(df, ROLES), ROLES)
    assert sorted(map(tuple, back.collect())) == sorted((r.id, r.x, r.y, float(r.c)) for r in df.collect())


# ---------------------------------------------------------------- positions, order statistics, splits

def test_positions_without_global_window(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = position.with_position(df, "v").collect()
    assert all(r.v == r.pos for r in got)
    plan = position.with_position(df, "v")._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_average_rank_and_spearman(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": range(300), "x": rng.integers(0, 20, 300), "y": rng.normal(size=300)})
    df = spark.createDataFrame(pdf)
    ranks = position.average_rank(df, "x").toPandas().set_index("id")["rank"].sort_index()
    assert ranks.tolist() == pdf["x"].rank().tolist()
    got = position.spearman(df, "x", "y").first()[0]
    assert got == pytest.approx(pdf["x"].rank().corr(pdf["y"].rank()))


def test_ranks_without_values(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, None, 5.0), (3, 1.0, None), (4, 7.0, 0.5), (5, 7.0, 9.0)], "id int, x double, y double")
    got = {r["id"]: r["rank"] for r in position.average_rank(df, "x").collect()}
    assert got == {1: 2.0, 2: None, 3: 1.0, 4: 3.5, 5: 3.5}
    pairs = df.toPandas().dropna()
    assert position.spearman(df, "x", "y").first()[0] == pytest.approx(pairs["x"].rank().corr(pairs["y"].rank()))
    assert position.spearman(df.where("id < 2"), "x", "y").first()[0] is None
    assert position.spearman(df.where("false"), "x", "y").first()[0] is None


@pytest.mark.parametrize("values", [
    [math.inf, -math.inf, 0.0, 1.0, math.inf, math.nan], [1.7e308, -1.7e308, 1e308, 5.0, math.nan, math.nan], [-0.0, 0.0, 5e-324, -5e-324],
    [math.inf] * 3 + [-math.inf] * 3, [10.0**e for e in range(-300, 301, 7)], [math.nan] * 4])
def test_order_statistics_of_any_doubles(spark, values):
    df = spark.createDataFrame([(v,) for v in values * 5] + [(None,)], "v double")
    want = sorted([v for v in values * 5 if v == v]) + [math.nan] * sum(v != v for v in values * 5)
    ks = [1, 2, len(want) // 3, len(want) // 2, len(want)]
    for few in (1, 4096):
        got = position.order_statistics(df, {"v": (F.col("v"), ks)}, few=few)["v"]
        assert [str(v) for v in got] == [str(want[k - 1]) for k in ks] or got == [want[k - 1] for k in ks]


def test_order_statistics_in_several_passes(spark):
    v = np.random.default_rng(5).lognormal(sigma=9, size=60000)
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    ks = [1, 17, 29999, 30000, 59000, 60000]
    assert position.order_statistics(df, {"v": (F.col("v"), ks)}, few=8)["v"] == [np.sort(v)[k - 1] for k in ks]


def test_running_total_over_chunks(spark):
    df = spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") % 5).alias("n"))
    got = {r.pos: r.before for r in position.running_total(df, "pos", "n", "before", width=64).collect()}
    want = np.concatenate([[0], np.cumsum(np.arange(1000) % 5)[:-1]])
    assert [got[i] for i in range(1000)] == want.tolist()


def test_order_statistics_with_a_heavy_value(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([np.full(400, 3.25), rng.lognormal(sigma=6, size=799)])
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    ks = [1, 10, 399, 400, 401, 600, 1199]
    got = position.order_statistics(df, {"v": (F.col("v"), ks)}, few=16)["v"]
    assert got == [np.sort(v)[k - 1] for k in ks]
    with pytest.raises(ValueError):
        position.order_statistics(df, {"v": (F.col("v"), [0])})


def test_split_has_the_exact_size_and_ignores_partitioning(spark):
    df = numbers(spark, 403)
    sizes = set()
    members = set()
    for n in (1, 9):
        train, test = split.train_test_split(df.repartition(n), ROLES, 0.2, 5)
        sizes.add((train.count(), test.count()))
        members.add(tuple(sorted(r.id for r in test.collect())))
    assert sizes == {(403 - math.ceil(0.2 * 403), math.ceil(0.2 * 403))}
    assert len(members) == 1


# ---------------------------------------------------------------- coding

def test_numbers_sort_as_numbers_and_unknown_values_become_null(spark):
    df = spark.createDataFrame([(1, 10, "b"), (2, 9, "a"), (3, None, None)], "id bigint, n int, s string")
    dimension = coding.build_dimension(df, ["n", "s"])
    assert {(r.feature, r.value): r.code for r in dimension.collect()} == {("n", "9"): 0, ("n", "10"): 1, ("s", "a"): 0, ("s", "b"): 1}
    codes = coding.encode(df, dimension, ["n", "s"]).orderBy("id").collect()
    assert [(r.n, r.s) for r in codes] == [(1, 1), (0, 0), (None, None)]
    other = spark.createDataFrame([(1, 11)], "id bigint, n int")
    assert coding.encode(other, dimension, ["n"]).first().n is None


def test_large_dimension_is_ranked_by_range_sort(spark):
    df = spark.createDataFrame([(v, str(v)) for v in range(30)], "n int, s string")
    got = {(r.feature, r.value): r.code for r in coding.build_dimension(df, ["n", "s"]).collect()}
    assert all(got["n", str(v)] == v for v in range(30))
    assert [v for (f, v), _ in sorted(got.items(), key=lambda e: e[1]) if f == "s"] == sorted(map(str, range(30)))


# ---------------------------------------------------------------- mechanisms

@pytest.mark.parametrize("mechanism", A.MECHANISMS)
def test_rate_is_met(spark, mechanism):
    df = numbers(spark, 3000)
    hidden = A.hidden_cells(df, ROLES, mechanism, 0.3, 1)
    got = C.mask_table(df, ROLES, hidden).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in ROLES.features]).first().asDict()
    if mechanism == "MNARQ":  # only the tails can be hidden
        assert all(v <= 0.3 for v in got.values()) and any(v > 0.05 for v in got.values())
        return
    for f in hidden:
        assert abs(got[f] - 0.3) < 4 * math.sqrt(0.21 / 3000)


def test_unscaled_input_still_calibrates(spark):
    df = numbers(spark, 500).withColumn("x", F.col("x") * 1e9)
    w = A.unit_scores(df, {"x": A.weighted_sum(["x"], [3.0])})
    b = A.fit_intercepts(df, w, 0.1)["x"]
    mean = df.agg(F.avg(1 / (1 + F.exp(-(w["x"] + F.lit(b)))))).first()[0]
    assert mean == pytest.approx(0.1, abs=1e-9)


def test_mechanism_errors(spark):
    df = numbers(spark, 10)
    with pytest.raises(ValueError):
        A.hidden_cells(df, ROLES, "MISSING", 0.3, 0)
    with pytest.raises(ValueError):
        A.mnar_quantile(df, ROLES, 0.3, 0, quantile=0.05)  # order 0
    with pytest.raises(ValueError):
        A.mnar_quantile(df, ROLES, 0.3, 0, cut_at="middle")


def test_uniform_below_equals_comparison(spark):
    key = F.col("id").cast("string")
    df = spark.range(2000)
    for share in (0.0, 0.3, 0.5, 1.0):
        both = df.select((R.uniform(key, "f") < share).alias("a"), R.uniform_below(share, key, "f").alias("b"))
        assert both.where("a <> b").count() == 0


# ---------------------------------------------------------------- text

def test_commas_are_removed_and_values_trimmed(spark):
    df = spark.createDataFrame([(1, " a, b ")], "id bigint, `n,m` string")
    roles = Roles("id", (), ("n,m",))
    assert T.encode_rows(df, roles).first().text == "nm is a b"


def test_number_text(spark):
    values = [1.0, 0.1, 1e7, 1e-5, -2.5, 1e40, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(T.number_text(F.col("v"))).collect()] == ["1", "0.1", "10000000", "0.00001", "-2.5", "1.0E40", None]


def test_second_separator_stays_in_the_value(spark):
    df = spark.createDataFrame([("a is b is c, n is 2.50",)], "t string")
    assert df.select(T.parse_sentence(F.col("t"))).first()[0] == {"a": "b is c", "n": "2.5"}


def test_unknown_encoding(spark):
    with pytest.raises(ValueError):
        T.encode_rows(numbers(spark, 2), ROLES, "tab2xml")


def test_tokens_are_cut(spark):
    df = spark.createDataFrame([(" ".join(["w"] * 600),)], "t string")
    assert len(df.select(T.truncate_tokens(F.col("t"))).first()[0].split()) == 512


# ---------------------------------------------------------------- triples

def test_fully_hidden_row_is_left_alone(spark):
    df = spark.createDataFrame([(1, None, None, None)], "id bigint, x double, y double, c int")
    row = pairs.positives(df, ROLES).first()
    assert row.anchor == row.positive


def test_positives_hide_more_and_only_observed(spark):
    df = A.ampute(numbers(spark, 100), ROLES, "MCAR", 0.2, 0)
    for r in pairs.positives(df, ROLES).collect():
        a, p = r.anchor.split(", "), r.positive.split(", ")
        assert all(y == x or y.endswith("[MASK]") for x, y in zip(a, p))
        if not all(x.endswith("[MASK]") for x in a):
            assert a != p


def test_batches_of_equal_or_single_positives_drop_out(spark):
    df = spark.createDataFrame([(0, 0, "a", "s"), (0, 1, "b", "s"), (1, 2, "a", "s"), (2, 3, "a", "s"), (2, 4, "a", "t")],
                               "batch_id bigint, id bigint, anchor string, positive string")
    assert {r.batch_id for r in pairs.with_negatives(df, "id", 0).collect()} == {2}
    assert {r.batch_id for r in pairs.usable_batches(df).collect()} == {2}


def test_negatives_are_another_order_of_the_positives(spark):
    df = spark.createDataFrame([(b, 2 * b + i, "a", f"s{i}") for b in range(50) for i in range(2)],
                               "batch_id bigint, id bigint, anchor string, positive string")
    got = pairs.with_negatives(df, "id", 0).toPandas()
    for _, g in got.groupby("batch_id"):
        assert sorted(g["negative"]) == sorted(g["positive"])
        assert list(g["negative"]) != list(g["positive"])


def test_truncated_poisson(spark):
    table = R.truncated_poisson_table(6)
    for observed in range(1, 7):
        rate = observed / 2
        p = [rate ** k * math.exp(-rate) / math.factorial(k) / (1 - math.exp(-rate)) for k in range(1, 7)]
        assert np.allclose(table[observed], np.cumsum(p))
    df = spark.range(3000).select(R.uniform(F.col("id")).alias("u"))
    both = df.select(R.truncated_poisson(F.col("u"), F.lit(4), 6).alias("a"),
                     F.least(R.poisson_draw(F.col("u"), F.lit(2.0), 6), F.lit(4)).alias("b"))
    assert both.where("a <> b").count() == 0
    assert df.select(R.truncated_poisson(F.col("u"), F.lit(0), 6)).distinct().collect()[0][0] == 0


# ---------------------------------------------------------------- vectors

def test_encoder_ignores_holes_and_keeps_integers(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3), (2, None, None, None), (3, 9.0, None, 3)], "id bigint, x double, y double, c int")
    for encoder in (HashEncoder(16), HashEncoder(16, binning="quantile")):
        got = {r.id: r.vec for r in hash_vectors(df, ROLES, encoder).collect()}
        assert got[2] == [0.0] * 16
        assert sum(map(abs, got[1])) in (1.0, 3.0) and sum(map(abs, got[3])) in (0.0, 2.0)


def test_texts_are_encoded_once(spark):
    def make():
        def encode(texts):
            return np.array([[len(t), 1.0] for t in texts], dtype=np.float32)
        return encode

    texts = ["same" if i < 30 else f"t{i} " * i for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    for distinct in (True, False):
        for limit, shown in ((None, texts), (5, [" ".join(t.split()[:5]) for t in texts])):
            made = embed_text(df, "t", make, 4, distinct=distinct, limit=limit)
            assert made.columns == ["id", "vec"]
            assert {r.id: r.vec for r in made.collect()} == {i: [len(t), 1.0] for i, t in enumerate(shown)}


def test_pooling(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [50.0, 60.0]], [1, 1, 0])], "v array<array<double>>, m array<int>")
    row = df.select(V.first_token(F.col("v")), V.mean_tokens(F.col("v")), V.mean_tokens(F.col("v"), F.col("m"))).first()
    assert row[0] == [1.0, 2.0] and row[1] == [18.0, 22.0] and row[2] == [2.0, 3.0]


def test_cross_entropy_is_stable(spark):
    df = spark.createDataFrame([(1000.0, 0.0), (-1000.0, 1.0), (0.0, 1.0)], "z double, y double")
    got = [r[0] for r in df.select(V.binary_cross_entropy(F.col("z"), F.col("y"))).collect()]
    assert got == pytest.approx([1000.0, 1000.0, math.log(2)])


def test_learned_metric_weighs_the_telling_entry(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(600):
        s = rng.choice([-1.0, 1.0])
        noise = rng.normal(size=(3,))
        rows.append(([s, noise[0]], [s, noise[1]], [-s, noise[2]]))
    df = spark.createDataFrame([tuple([float(v) for v in p] for p in r) for r in rows],
                               "h_x array<double>, h_pos array<double>, h_neg array<double>")
    model = learn.learn_metric(df)
    assert model.weights[0] > 10 * abs(model.weights[1])
    scaled = model.scale(df, "h_x").first().h_x
    assert abs(scaled[0]) == pytest.approx(math.sqrt(model.weights[0]))


# ---------------------------------------------------------------- fidelity

def test_histogram_edges(spark):
    truth = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    imputed = spark.createDataFrame([(float(v),) for v in (-1, 0, 10, 11)], "v double")
    got = {int(r.bin): (r.p, r.q) for r in fidelity.frequencies(truth, imputed, ["v"]).collect()}
    hist, edges = np.histogram(range(11), bins=10)
    other, _ = np.histogram([-1, 0, 10, 11], bins=edges)
    assert sorted(got) == list(range(10))
    for b in range(10):
        assert got[b][0] == pytest.approx(hist[b] / (11 + 1e-8))
        assert got[b][1] == pytest.approx(max(other[b] / (2 + 1e-8), 1e-11))


def test_absent_level(spark):
    truth = spark.createDataFrame([(0,), (0,), (1,), (2,)], "c int")
    imputed = spark.createDataFrame([(0,), (0,), (1,), (1,)], "c int")
    kl = fidelity.kl_categorical(truth, imputed, ["c"]).first().kl
    assert kl == pytest.approx(0.5 * math.log(0.5 / 0.5) + 0.5 * math.log(0.5 / 0.25))
    few = {r.bin: r.q for r in fidelity.frequencies(truth, imputed, ["c"]).collect()}
    assert few[2.0] == 1e-11


def test_equal_tables_have_no_distance(spark):
    df = numbers(spark)
    assert fidelity.kl_mean(df, df, ROLES).first().kl == pytest.approx(0, abs=1e-9)
    mask = C.mask_table(df, ROLES, A.mcar(ROLES, 0.3, 0))
    assert tuple(fidelity.cell_errors(df, df, mask, ROLES).first()) == (0.0, 0.0, 0.0)


def test_flat_column_is_not_divided_by_zero(spark):
    df = numbers(spark, 10).withColumn("x", F.lit(5.0))
    got = utility.standardize(df, utility.scale_stats(df, ROLES)).select("x").distinct().collect()
    assert [r.x for r in got] == [0.0]


# ---------------------------------------------------------------- sources

def test_arff(spark, tmp_path):
    path = tmp_path / "t.arff"
    path.write_text("% c\n@RELATION r\n\n@ATTRIBUTE 'a b' NUMERIC\n@attribute k {'x y',z}\n@attribute s string\n@DATA\n1.5,'x y',q\n?,z,?\n% end\n")
    assert sorted(map(str, read_arff(spark, str(path)).collect())) == sorted(["Row(a b=1.5, k='x y', s='q')", "Row(a b=None, k='z', s=None)"])
    with pytest.raises(ValueError):
        parse_attribute("@attribute d date")


def test_arff_keeps_every_row(spark, tmp_path):
    path = tmp_path / "t.arff"
    path.write_text("@relation r\n@attribute k {'@x','a, b',\"it's\"}\n@attribute n real\n@data\n'@x',1\n\"@x\",2\n@x,3\n'a, b',4\n% gone\n\n\"it's\",?\n?,6\n@data,7\n".replace("@data,7\n", ""))
    assert sorted(map(str, read_arff(spark, str(path)).collect())) == sorted(
        f"Row(k={k!r}, n={n})" for k, n in (("@x", 1.0), ("@x", 2.0), ("@x", 3.0), ("a, b", 4.0), ("it's", None), (None, 6.0)))
    path.write_text(path.read_text() + "other,1\n")
    with pytest.raises(Exception, match="undeclared value other"):
        read_arff(spark, str(path)).collect()
    path.write_text("@relation r\n@attribute n real\n@data\n1,2\n")
    with pytest.raises(Exception, match="number of fields"):
        read_arff(spark, str(path)).collect()


def test_csv_header_in_another_order_is_an_error(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("b,a\n1,2\n")
    with pytest.raises(Exception):
        read_delimited(spark, str(path), {"a": "int", "b": "int"}, header=True).collect()


def test_intercepts_that_do_not_converge_are_an_error(spark):
    df = numbers(spark)
    with pytest.raises(ArithmeticError):
        A.fit_intercepts(df, {"t": F.col("x").cast("double")}, 0.3, rounds=1)


def test_malformed_csv_is_an_error(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("1,x\n")
    with pytest.raises(Exception):
        read_delimited(spark, str(path), {"a": "int", "b": "double"}).collect()


def write(folder, name, df, **options):
    df.to_csv(folder / catalog.CATALOG[name].file, index=False, **options)


def test_catalog_reads_the_public_tables(spark, tmp_path):
    rng = np.random.default_rng(0)

    def frame(columns, n=6, **fixed):
        return pd.DataFrame({c: fixed.get(c, np.round(rng.random(n), 3)) for c in columns})

    write(tmp_path, "abalone", frame(catalog.ABALONE, Sex=list("MFIMFI"), Rings=[1, 2, 3, 1, 2, 3]), header=False)
    write(tmp_path, "banknote", frame(catalog.BANKNOTE, **{"class": [0, 1] * 3}), header=False)
    write(tmp_path, "breast", frame(["id", "Diagnosis", *catalog.BREAST_NUMBERS], id=range(6), Diagnosis=list("MBMBMB")), header=False)
    write(tmp_path, "letter", frame(catalog.LETTER, **{c: range(6) for c in catalog.LETTER[1:]}, lettr=list("ABCABC")), header=False)
    write(tmp_path, "redwine", frame(catalog.WINE, quality=[5, 6] * 3), sep=";")
    write(tmp_path, "concrete", frame([c + " (unit)" for c in catalog.CONCRETE], **{"Age (unit)": [1, 2, 3] * 2}))
    loan = frame(catalog.LOAN_FILE, Age=[30, None, 40, 41, 42, 43])
    write(tmp_path, "loan", loan)
    write(tmp_path, "anuran", frame(catalog.ANURAN_FILE, Family=list("aabbcc"), Genus=list("aabbcc"), Species=list("aabbcc"), RecordID=range(6)))
    write(tmp_path, "kings", frame(catalog.KINGS_FILE, id=range(6), date=["d"] * 6, zipcode=range(6)))
    sizes = {"abalone": (7, 2), "banknote": (4, 1), "breast": (30, 1), "letter": (16, 1), "redwine": (11, 1),
             "concrete": (8, 1), "loan": (5, 6), "anuran": (22, 3), "kings": (11, 7)}
    for name, (numbers_, categories) in sizes.items():
        df, roles = catalog.load(spark, name, str(tmp_path))
        assert (len(roles.continuous), len(roles.categorical)) == (numbers_, categories), name
        assert df.columns == [roles.key, *roles.features]
        assert sorted(r[0] for r in df.select(roles.key).collect()) == list(range(5 if name == "loan" else 6))
    lines = [f"@attribute V{i} {'{a,b}' if i in catalog.NOMAO_CATEGORICAL else 'real'}" for i in range(1, 119)] + ["@attribute Class {1,-1}", "@data"]
    rows = [",".join(["a" if i in catalog.NOMAO_CATEGORICAL else f"0.{i}" for i in range(1, 119)] + ["1"])]
    (tmp_path / "nomao.arff").write_text("\n".join(["@relation n", *lines, *rows]) + "\n")
    df, roles = catalog.load(spark, "nomao", str(tmp_path))
    assert (len(roles.continuous), len(roles.categorical), df.count()) == (89, 30, 1)
    with pytest.raises(ValueError):
        catalog.load(spark, "unheard", str(tmp_path))


def test_cache_key_holds_every_setting(spark):
    home = new_path(spark, "cache")
    calls = []

    def compute():
        calls.append(1)
        return spark.createDataFrame([(1, [1.0])], "id bigint, vec array<double>")

    for settings in ({"dim": 1, "lr": 0.1}, {"lr": 0.1, "dim": 1}, {"dim": 1, "lr": 0.2}):
        assert tables.cached_embeddings(spark, home, settings, "id", "vec", compute).count() == 1
    assert len(calls) == 2


def test_own_folder_is_dropped_whole(spark, monkeypatch):
    monkeypatch.setattr(scratch, "own_folder", lambda s, base=scratch.own_folder(spark): base + "-other")
    df = scratch.cut(spark.range(5), "t")
    assert df.count() == 5 and scratch.path_exists(spark, df.inputFiles()[0].rsplit("/", 1)[0])
    scratch.drop_tables(spark)
    assert not scratch.path_exists(spark, df.inputFiles()[0].rsplit("/", 1)[0])


# ---------------------------------------------------------------- whole runs

def test_tuned_experiment_with_a_cache(spark, tmp_path):
    """A second run reads the vectors of the first; other settings have vectors of their own."""
    rng = np.random.default_rng(3)
    rows = [(i, float(i % 7), float(rng.normal()), int(i % 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double, c int")
    settings = Settings(missing_type="MCAR", batch_size=8)
    runs = [experiment(df, ROLES, settings, models=("GaussNB",), tune=True, cache=str(tmp_path)).first() for _ in range(2)]
    assert str(runs[0]) == str(runs[1]) and len(list(tmp_path.glob("embeddings-*"))) == 1
    experiment(df, ROLES, Settings(missing_type="MCAR", batch_size=8, seed=1), models=("GaussNB",), tune=True, cache=str(tmp_path))
    experiment(df.where("id < 100"), ROLES, settings, models=("GaussNB",), cache=str(tmp_path))
    assert len(list(tmp_path.glob("embeddings-*"))) == 3
    with pytest.raises(ValueError, match="name"):
        experiment(df, ROLES, settings, make_encoder=lambda: None, cache=str(tmp_path))


def test_experiment_with_a_text_encoder(spark):
    def make():
        def encode(texts):
            return np.array([[t.count(str(d)) for d in range(10)] for t in texts], dtype=np.float32)
        return encode

    df = numbers(spark, 120)
    row = experiment(df, ROLES, Settings(missing_type="MCAR", encoding="tab2json"), make, models=("GaussNB", "KNN")).first().asDict()
    assert 0 <= row["error"] <= 1 and 0 <= row["smape"] <= 1
    assert row["asmape"] == pytest.approx(row["smape"] + row["error"])
    assert 0 <= row["base_cls"] <= 1 and 0 <= row["imputed_cls"] <= 1


def test_truth_as_imputation_scores_best(spark):
    df = numbers(spark, 200)
    ready = prepare(df, ROLES, Settings(missing_type="MCAR"))
    assert row_vectors(ready, ROLES, Settings()).columns[-1] == "vec"
    row = evaluate(ready.truth, ready.truth, ready.test, ready.mask, ROLES, models=("GaussNB", "tree")).first()
    assert (row.smape, row.error) == (0.0, 0.0)
    assert row.base_cls == row.imputed_cls


def test_first_class_only_gives_zeros(spark):
    df = numbers(spark, 100)
    train, test = split.train_test_split(df, ROLES, 0.3, 0)
    got = utility.classification(train, test, train.withColumn("c", F.lit(0)), ROLES, models=("GaussNB",))
    assert (got["imputed_cls"], got["model_selection"], got["feature_selection"]) == (0.0, 0.0, 0.0)


def test_rank_correlation_of_scores():
    assert utility.rank_correlation({"a": 1, "b": 2, "c": 3}, {"a": 3, "b": 2, "c": 1}) == -1.0
    assert math.isnan(utility.rank_correlation({"a": 1, "b": 1}, {"a": 1, "b": 2}))


def test_ranks_of_columns_with_helper_names(spark):
    df = spark.createDataFrame([(i % 4, float(i % 3), i) for i in range(12)], "__pos int, __n double, __file int")
    assert sorted(r.rank for r in position.average_rank(df, "__pos").collect())[:3] == [2.0] * 3
    assert position.average_rank(df, "__n").count() == 12
    placed = position.with_position(df, "__file", "pos").collect()
    assert all(r.pos == r["__file"] for r in placed)
    assert {r.batch_id for r in position.with_batch(df, "__file", 5).collect()} == {0, 1, 2}


def test_texts_are_encoded_once_over_runs(spark, tmp_path):
    """Another seed hides other cells: only texts that no run has seen are encoded."""
    df = numbers(spark, 120)
    seen = spark.sparkContext.accumulator(0)

    def make():
        def encode(texts):
            seen.add(len(texts))
            return np.array([[len(t), t.count("a"), 1.0] for t in texts], np.float32)
        return encode

    def run(seed):
        before = seen.value
        settings = Settings(missing_type="MCAR", seed=seed)
        got = experiment(df, ROLES, settings, make, models=("GaussNB",), cache=str(tmp_path), encoder_name="letters").first()
        ready = prepare(df, ROLES, settings)
        texts = {r.text for r in T.encode_rows(coding.decode(ready.holed, ready.dimension, ROLES.categorical, ready.types), ROLES).collect()}
        return got, seen.value - before, texts

    first, encoded, known = run(0)
    assert encoded == len(known)
    again, encoded, _ = run(0)
    assert encoded == 0 and str(again) == str(first)
    _, encoded, texts = run(1)
    assert encoded == len(texts - known) < len(texts)


def test_tuning_by_epochs_lowers_the_loss(spark, tmp_path):
    df = numbers(spark, 200)
    where = str(tmp_path / "losses")
    got = experiment(df, ROLES, Settings(missing_type="MCAR"), models=("GaussNB",), tune=True, epochs=3, losses=where).first()
    losses = [r.bce_loss for r in spark.read.schema("epoch int, bce_loss double").json(where).orderBy("epoch").collect()]
    assert len(losses) == 3 and losses[-1] < losses[0] and got["smape"] is not None
    none, record = learn.tune_metric(spark, lambda e: spark.createDataFrame([], "batch_id bigint, h_x array<double>, h_pos array<double>, h_neg array<double>"), 3, epochs=1)
    assert none.weights.tolist() == [1.0] * 3 and record.first().bce_loss is None


def test_limits_of_models_reach_a_run(spark):
    df = numbers(spark, 60)
    made = utility.estimators(60, tree_depth=3, bins=7)
    assert made["tree"].getMaxDepth() == 3 and made["tree"].getMaxBins() == 7
    with pytest.raises(TypeError, match="no_such_limit"):
        experiment(df, ROLES, Settings(missing_type="MCAR"), models=("tree",), no_such_limit=1)


def test_batches_of_tokens_hold_little_padding(spark):
    """Texts of very different lengths: batches stay within the budget, and hardly a tenth is padding."""
    pick = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(n))) for i, n in enumerate(pick.lognormal(3, 1.2, 3000))] + [(3000, None), (3001, ""), (3002, "w " * 5000)]
    places, tokens, widest = (spark.sparkContext.accumulator(0) for _ in range(3))

    def model():
        def encode(ids, mask):
            assert ids.size <= 1000 or len(ids) == 1
            places.add(ids.size)
            tokens.add(int(mask.sum()))
            return np.stack([mask.sum(axis=1), (ids * mask).sum(axis=1)], axis=1)
        return encode

    df = spark.createDataFrame([(*r, 0.5) for r in rows], "id bigint, text string, vec double").repartition(2)
    got = {r.id: list(r.vec) for r in embed_tokens(df, "text", lambda: lambda texts: [[1] * len(t.split()) for t in texts], model, limit=512, budget=1000).collect()}
    assert got == {i: [min(512, len((t or "").split()))] * 2 for i, t in rows}
    assert places.value < 1.1 * tokens.value
    assert embed_tokens(df.where("false"), "text", lambda: lambda t: [], model).collect() == []

