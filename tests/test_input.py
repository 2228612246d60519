import numpy as np
import pandas as pd
import pytest

from tessera.sources.input import GlmInput, parse_design, parse_size_factors


class Coo:
    def __init__(self, x):
        self.shape, (self.row, self.col) = x.shape, np.nonzero(x)
        self.data = x[self.row, self.col]

    def tocoo(self):
        return self


class Annotated:
    def __init__(self, x):
        self.X, self.var_names = x, ["g0", "g1", "g2"]


X = np.array([[0, 2, 0], [1, 2, 0], [0, 3, 0], [4, 0, 0]], float)
D = np.array([[1, 0], [1, 0], [1, 1], [1, 1]], float)


def make(spark, data=X, **kw):
    return GlmInput.from_matrix(spark, data, D, ["Intercept", "b"], **kw)


@pytest.mark.parametrize("data", [X, Coo(X), pd.DataFrame(X), Annotated(X)], ids=["dense", "sparse", "frame", "annotated"])
def test_every_source_gives_the_same_cells(spark, data):
    got = make(spark, data)
    want = make(spark).cells().toPandas()
    cells = got.cells().toPandas()
    rename = dict(zip(sorted(cells.feature.unique()), sorted(want.feature.unique()), strict=True))
    key = lambda f: sorted((rename.get(r.feature, r.feature), tuple(r["loc"]), r.x, r.cnt) for _, r in f.iterrows())
    assert key(cells) == key(want)
    assert cells.cnt.sum() == X.size and (got.num_observations, got.num_features) == (4, 3)


def test_cells_count_zeros(spark):
    cells = {(r.feature, tuple(r["loc"]), r.x): r.cnt for r in make(spark).cells().collect()}
    assert cells == {("0", (1, 0), 0): 1, ("0", (1, 0), 1): 1, ("0", (1, 1), 0): 1, ("0", (1, 1), 4): 1, ("1", (1, 0), 2): 2, ("1", (1, 1), 3): 1, ("1", (1, 1), 0): 1, ("2", (1, 0), 0): 2, ("2", (1, 1), 0): 2}


def test_explicit_zeros_change_nothing(spark):
    obs = spark.createDataFrame([(0, 1.0), (1, 1.0)], "o int, one double")
    long = spark.createDataFrame([(0, "a", 0.0), (1, "a", 2.0)], "o int, f string, v double")
    kw = dict(design=obs, loc=["one"], obs_col="o", feature_col="f", value_col="v")
    a, b = (sorted(map(str, GlmInput.from_tables(x, **kw).cells().collect())) for x in (long, long.where("v <> 0")))
    assert a == b


def test_wide_tables(spark):
    wide = spark.createDataFrame([(0, 0.0, 2.0), (1, 1.0, 0.0)], "obs_id int, a double, b double")
    got = GlmInput.from_wide(wide, ["a", "b"], design=wide.selectExpr("obs_id", "1.0 as one"), loc=["one"])
    assert sorted((r.feature, r.obs_id, r.x) for r in got.x.collect()) == [("a", 1, 1.0), ("b", 0, 2.0)]
    arr = spark.createDataFrame([(0, [0.0, 2.0])], "obs_id int, v array<double>")
    got = GlmInput.from_arrays_column(arr, "v", names=["p", "q"], design=arr.selectExpr("obs_id", "1.0 as one"), loc=["one"])
    assert sorted((r.feature, r.x) for r in got.x.collect()) == [("p", 0.0), ("q", 2.0)]


def test_what_is_refused(spark):
    with pytest.raises(ValueError, match="not recognized"):
        make(spark, "text")
    with pytest.raises(ValueError):
        parse_design(D)
    with pytest.raises(AssertionError):
        parse_design(D, ["one"])
    with pytest.raises(ValueError):
        parse_design([[1]], ["a"])
    with pytest.raises(ValueError):
        parse_size_factors(np.ones((4, 2)), 4)
    obs = spark.createDataFrame([(0, 1.0)], "obs_id int, one double")
    null = spark.createDataFrame([(0, "a", None)], "obs_id int, feature string, x double")
    with pytest.raises(Exception, match="null"):
        GlmInput.from_tables(null, obs, ["one"]).cells().collect()
    with pytest.raises(ValueError):
        GlmInput.from_tables(null, obs, ["one"], value_col="nothing")


def test_names_of_a_frame_win():
    rows, names = parse_design(pd.DataFrame(D, columns=["p", "q"]), ["other", "names"])
    assert names == ["p", "q"] and (rows == D).all()


def test_size_factors():
    assert parse_size_factors(np.ones((4, 1)), 4).tolist() == [1, 1, 1, 1] and parse_size_factors(None, 4) is None


def test_selections(spark):
    inp = make(spark, size_factors=[1.0, 2.0, 1.0, 2.0], feature_names=["a", "b", "c"], observation_names=["o0", "o1", "o2", "o3"])
    assert {r.feature: r.allzero for r in inp.feature_isallzero().collect()} == {"a": False, "b": False, "c": True}
    assert {r.feature: r.nonzero for r in inp.feature_isnonzero().collect()} == {"a": True, "b": True, "c": False}
    assert [list(r["loc"]) for r in inp.fetch(["o2"]).collect()] == [[1.0, 1.0]]
    assert sorted(r.size_factor for r in inp.fetch(inp.design.where("obs_id in ('o0', 'o1')"), "size_factor").collect()) == [1.0, 2.0]
    one = inp.subset_features("a")
    assert one.num_features == 1 and {r.feature for r in one.cells().collect()} == {"a"}
    assert (inp.num_design_loc_params, inp.num_loc_params, inp.num_scale_params) == (2, 2, 1)


def test_zeros_count_with_more_design_rows_than_max_groups(spark):
    """501 distinct size factors: every observation has a cell for every feature, zeros too."""
    n = 501
    data = np.zeros((n, 2))
    data[::3, 0] = 2.0
    data[1, 1] = 5.0
    design = np.ones((n, 1))
    inp = GlmInput.from_matrix(spark, data, design, ["Intercept"], size_factors=np.arange(1, n + 1) / 100)
    got = {(r.feature, round(r.size_factor * 100) - 1): (r.x, r.cnt) for r in inp.cells().collect()}
    assert got == {(str(f), o): (data[o, f], 1) for f in range(2) for o in range(n)}


@pytest.mark.parametrize("n", [60, 1100])
def test_moment_cells_have_the_sums_of_the_cells(spark, n):
    """With few and with more than MAX_GROUPS distinct size factors, zeros left out and a feature of zeros alone."""
    rng = np.random.default_rng(n)
    data = np.round(rng.normal(size=(n, 3)) * rng.integers(0, 2, (n, 3)), 2)
    data[:, 2] = 0
    design = np.stack([np.ones(n), np.arange(n) % 3 == 1], axis=1).astype(float)
    inp = GlmInput.from_matrix(spark, data, design, ["a", "b"], size_factors=1 + np.arange(n) // 2 / 100)
    keys = ["feature", "loc", "size_factor"]

    def sums(cells):
        rows = cells.selectExpr(*keys, "cast(x as double) as x", "cast(cnt as double) as cnt").groupBy(*keys).agg({"cnt": "sum"}).collect()
        first = cells.selectExpr(*keys, "x * cnt as s", "x * x * cnt as q").groupBy(*keys).agg({"s": "sum", "q": "sum"}).collect()
        out = {(r.feature, tuple(r["loc"]), r.size_factor): [r["sum(cnt)"]] for r in rows}
        for r in first:
            out[r.feature, tuple(r["loc"]), r.size_factor] += [r["sum(s)"], r["sum(q)"]]
        return out

    one, two = sums(inp.cells()), sums(inp.moment_cells())
    assert one.keys() == two.keys()
    for k, v in one.items():
        assert two[k] == pytest.approx(v, abs=1e-9)
