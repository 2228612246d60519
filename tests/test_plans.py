import logging

import numpy as np
import pytest

from tessera.plans import constraints as cs
from tessera.plans import formula as fo
from tessera.plans import settings


@pytest.fixture()
def samples(spark):
    return spark.createDataFrame([(0, 0, 1, 2.5), (1, 1, 2, 0.5), (2, 1, 2, 1.0), (3, 0, 0, 0.0), (4, 0, 0, 1.5), (5, 1, 3, 4.0)], "obs_id int, condition int, batch int, dose double")


def test_golden_dict(samples):
    out = cs.constraint_system({"batch": "condition"}, sample_description=samples, formula="~0 + condition + batch")
    assert out.names == ["condition[0]", "condition[1]", "batch[0]", "batch[1]", "batch[2]", "batch[3]"]
    assert out.terms == ["condition", "batch"]
    assert out.matrix.tolist() == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, -1, 0], [0, 0, 1, 0], [0, 0, 0, -1], [0, 0, 0, 1]]


def test_golden_list(samples):
    want = [[-1, 0, 0, 0], [1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
    out = cs.constraint_system(["condition[0] + condition[1] = 0"], sample_description=samples, formula="~0 + condition + batch")
    assert out.names == ["condition[0]", "condition[1]", "batch[T.1]", "batch[T.2]", "batch[T.3]"]
    assert out.matrix.tolist() == want
    again = cs.constraint_system(["condition[0] + condition[1] = 0"], design=out.design)
    assert again.matrix.tolist() == want


def test_golden_array(spark):
    samples = spark.createDataFrame([(0, 1), (1, 0), (0, 0), (1, 1)], "condition int, batch int")
    c = np.array([[-1, 0, 0], [0, 1, 0], [0, 0, 1]], float)
    out = cs.constraint_system(c, sample_description=samples, formula="~0 + condition + batch")
    assert out.names == ["condition[0]", "condition[1]", "batch[T.1]"] and (out.matrix == c).all()


def test_refused_constraints(samples):
    names = ["a", "b", "c"]
    for bad in (["a = 0"], ["a + d = 0"], ["a + b = 1"], ["a + b"], ["a + b = 0", "a + c = 0"], ["a + b = 0", "b + c = 0"]):
        with pytest.raises(ValueError):
            cs.constraint_matrix(names, bad)
    with pytest.raises(TypeError):
        cs.constraint_system(3, design=fo.design_matrix(samples, "~1"))
    with pytest.raises(ValueError):
        cs.constraint_system({"condition": "batch"}, sample_description=samples.union(samples.selectExpr("obs_id", "condition", "batch + 1", "dose")), formula="~batch + condition")
    with pytest.raises(ValueError):
        cs.assert_full_rank(np.array([[1.0, 1.0], [2.0, 2.0]]), None)


def test_free_names():
    assert cs.free_names(np.array([[-1.0, 0], [1, 0], [0, 1]]), ["a", "b", "c"]) == ["var_0", "c"]
    assert cs.free_names(None, ["a"]) == ["a"]


@pytest.mark.parametrize(
    "formula,names",
    [
        ("~1", ["Intercept"]),
        ("~1+condition", ["Intercept", "condition[T.1]"]),
        ("~condition - 1", ["condition[0]", "condition[1]"]),
        ("~0+dose", ["dose"]),
        ("~C(batch)", ["Intercept", "batch[T.1]", "batch[T.2]", "batch[T.3]"]),
        ("~condition*dose", ["Intercept", "condition[T.1]", "dose", "condition[T.1]:dose"]),
        ("~condition:dose", ["Intercept", "condition[0]:dose", "condition[1]:dose"]),
        ("~0+condition:batch", [f"condition[{c}]:batch[{b}]" for b in range(4) for c in range(2)]),
    ],
)
def test_names(samples, formula, names):
    assert fo.preview_coef_names(samples, formula, [False, True, True, False]) == names


def test_design_rows_have_the_formulas_rank(samples):
    d = fo.design_matrix(samples, "~1+condition+dose", [False, True, True, False])
    rows = np.array([r[0] for r in d.attach(samples).orderBy("obs_id").select("loc").collect()])
    assert rows.tolist() == [[1, 0, 2.5], [1, 1, 0.5], [1, 1, 1.0], [1, 0, 0.0], [1, 0, 1.5], [1, 1, 4.0]]
    assert (d.rows([r.asDict() for r in samples.orderBy("obs_id").collect()]) == rows).all()
    assert fo.view_coef_names(d) == d.names
    with pytest.raises(ValueError):
        fo.view_coef_names(3)
    for bad in ("~nothing", "~a+", "~log(dose)"):
        if bad != "~a+":
            with pytest.raises(ValueError):
                fo.design_matrix(samples, bad)


def test_logging_and_settings(capsys):
    settings.setup_logging("DEBUG")
    logging.getLogger("tessera").debug("hello")
    settings.unconfigure_logging()
    logging.getLogger("tessera").debug("bye")
    err = capsys.readouterr().err
    assert "hello" in err and "bye" not in err
    assert settings.Settings.from_env({"TESSERA_MARGIN": "3"}).margin == 3.0
