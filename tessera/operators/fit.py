"""Fits: initial parameters, then location and scale steps for a block of features within one task.

A feature's path doesn't depend on its neighbours, so the whole iteration runs where its cells are: one
shuffle, no driver loop. Cells of a block are flat arrays; sums over a feature are bincounts.

Schedule: update_scale_freq location steps (reweighted least squares), then one scale search, until the
relative change of a feature's log-likelihood stays under LL_TOLERANCE for both. A location step that makes
a feature's loss worse is halved, up to HALVINGS times, and then taken back, as is such a scale step.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.families import Family, family, ll_np, weights_np
from tessera.operators import moments
from tessera.operators.linear import inverse_or_zero, solve_or_zero
from tessera.plans.settings import SETTINGS
from tessera.sources.input import MAX_GROUPS, GlmInput

logger = logging.getLogger("tessera")

LL_TOLERANCE = 1e-10
#: Half-width of the interval that the scale search looks in.
REACH = 20.0
HALVINGS = 5
GOLDEN = (np.sqrt(5) - 1) / 2


class Strategy(Enum):
    """Training phases; each is a dict of train() arguments."""

    AUTO = None
    DEFAULT = ({"max_steps": 1000, "method_scale": "brent", "update_scale_freq": 5, "ftol_scale": 1e-6, "max_iter_scale": 1000},)
    GD = ({"max_steps": 1000, "method_scale": "gd", "update_scale_freq": 5, "ftol_scale": 1e-6, "max_iter_scale": 100, "lr_scale": 1e-2},)


def strategy_phases(strategy: Strategy | str | Iterable[Mapping] | None, **override) -> list[dict]:
    """The phases of a strategy by value, name or list; named arguments take precedence."""
    if isinstance(strategy, str):
        if strategy.upper() not in Strategy.__members__:
            raise ValueError(f"no strategy {strategy!r}")
        strategy = Strategy[strategy.upper()]
    if strategy is None or strategy is Strategy.AUTO:
        strategy = Strategy.DEFAULT
    phases = strategy.value if isinstance(strategy, Strategy) else strategy
    return [{**p, **override} for p in phases]


# --- initial parameters ---------------------------------------------------------------------------


def _array(p: int, first=None):
    return F.array(*([first if first is not None else F.lit(0.0)] + [F.lit(0.0)] * (p - 1))) if p else F.array().cast("array<double>")


def _standard(inp: GlmInput, fam: Family) -> DataFrame:
    mean = F.col("mean")
    first = F.when(mean > 0, F.ln(mean)).otherwise(F.lit(fam.bounds()["theta_location"][0])) if fam.additive_offset else mean
    return moments.column_mean(inp).select("feature", _array(inp.num_loc_params, first).alias("theta_loc"))


def init_par(inp: GlmInput, fam: Family | str, init_location: str = "auto", init_scale: str = "auto", compat: bool = False) -> tuple[DataFrame, bool, bool]:
    """(feature, theta_loc, theta_scale) and whether location and scale are to be trained."""
    fam = family(fam)
    loc, scale = init_location.lower(), init_scale.lower()
    p, q = inp.num_loc_params, inp.num_scale_params
    zeros = inp.features().select("feature", _array(p).alias("theta_loc"))
    train_loc = True
    groups = None
    if fam.name == "beta":
        loc = "closed_form" if loc == "auto" else loc
        scale = "closed_form" if scale == "auto" else scale
    if loc == "auto":
        if fam.name == "norm":
            loc = "all_zero"
        else:
            rows = np.array([r[0] for r in inp.design.select("loc").distinct().limit(MAX_GROUPS + 1).collect()], float)
            one_hot = len(rows) <= MAX_GROUPS and moments.is_one_hot(rows)
            if not one_hot:
                logger.warning("the design is not one-hot: the location starts from the overall mean")
            loc = "closed_form" if one_hot else "standard"
    if loc == "closed_form" and fam.name == "norm":
        logger.warning("the normal location is found by least squares; it starts from zeros")
        loc = "all_zero"
    if loc == "closed_form":
        forms = {"nb": moments.nb_log_mean, "poisson": moments.poisson_log_rate, "beta": lambda i, compat=False: moments.beta_logit_mean(i)}
        fit = forms[fam.name](inp, compat=compat)
        theta = fit.select("feature", F.col("theta").alias("theta_loc"))
        groups = moments.design_groups(inp)
        # as many groups as parameters: the closed form is the maximum
        train_loc = inp.has_size_factors or len(groups.rows) > groups.rank
    elif loc == "standard":
        theta = _standard(inp, fam)
    elif loc == "all_zero":
        theta = zeros
    else:
        raise ValueError(f"unrecognized parameter initialization {init_location!r}")

    if fam.name == "poisson":
        s = inp.features().select("feature", _array(q).alias("theta_scale"))
        return theta.join(s, "feature"), train_loc, False
    if scale == "auto":
        scale = "standard"
    if scale in ("standard", "closed_form"):
        if scale == "closed_form" and fam.name == "nb" and (inp.loc_names != inp.scale_names or loc != "closed_form"):
            raise ValueError("a closed-form scale needs equal designs and a closed-form location")
        form = {"nb": lambda i: moments.nb_log_phi(i, compat), "norm": moments.norm_log_sd, "beta": moments.beta_log_samplesize}[fam.name]
        low, high = fam.bounds()["theta_scale"]
        clip = lambda t: F.greatest(F.least(t, F.lit(high)), F.lit(low))
        source = inp
        if scale == "standard":
            first = F.array(F.element_at("scale", 1))
            source = GlmInput(inp.x, inp.design.withColumn("scale", first), inp.loc_names, inp.scale_names[:1], inp.constraints_loc, None, inp.dtype, inp.has_size_factors, inp.meta)
        found = form(source).select("feature", F.transform("theta", lambda t: F.when(F.isnan(t), F.lit(low)).otherwise(clip(t))).alias("t"))
        s = found.select("feature", _array(q, F.element_at("t", 1)).alias("theta_scale") if scale == "standard" else F.col("t").alias("theta_scale"))
    elif scale == "all_zero":
        s = inp.features().select("feature", _array(q).alias("theta_scale"))
    else:
        raise ValueError(f"unrecognized parameter initialization {init_scale!r}")
    return theta.join(s, "feature"), train_loc, fam.trainable


# --- block kernel ---------------------------------------------------------------------------------


@dataclass
class Block:
    """Cells of some features as flat arrays, with the features' parameters."""

    fam: Family
    x: np.ndarray
    cnt: np.ndarray
    of: np.ndarray
    loc: np.ndarray
    scale: np.ndarray
    sf: np.ndarray | None
    theta: np.ndarray
    s: np.ndarray
    n_obs: int
    compat: bool = False

    def __post_init__(self):
        self.n = len(self.theta)
        self.bounds = self.fam.bounds()

    def total(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, self.cnt * v, self.n)

    def eta(self, theta: np.ndarray) -> np.ndarray:
        dot = (self.loc * theta[self.of]).sum(axis=1)
        if self.sf is not None:
            dot = dot + self.sf if self.fam.additive_offset else dot * self.sf
        return np.clip(dot, *self.bounds["eta_loc"]) if self.fam.clips_eta else dot

    def scale_eta(self, s: np.ndarray) -> np.ndarray:
        return np.clip((self.scale * s[self.of]).sum(axis=1), *self.bounds["eta_scale"])

    def loss(self, eta: np.ndarray, s: np.ndarray) -> np.ndarray:
        return -self.total(ll_np(self.fam, self.x, eta, self.scale_eta(s), self.compat))

    def gram(self, rows: np.ndarray, cols: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = np.empty((self.n, rows.shape[1], cols.shape[1]))
        for i in range(rows.shape[1]):
            for j in range(cols.shape[1]):
                out[:, i, j] = self.total(rows[:, i] * w * cols[:, j])
        return out

    def irls(self) -> np.ndarray:
        w = weights_np(self.fam, self.x, self.eta(self.theta), self.scale_eta(self.s))
        b = np.stack([self.total(self.loc[:, k] * w["fim_ll"] * w["ybar"]) for k in range(self.loc.shape[1])], axis=1)
        return np.clip(self.theta + solve_or_zero(self.gram(self.loc, self.loc, w["fim_ll"]), b), *self.bounds["theta_location"])

    def least_squares(self) -> np.ndarray:
        """Ordinary least squares of the normal location, on rows times size factors."""
        rows = self.loc if self.sf is None else self.loc * self.sf[:, None]
        one = np.ones(len(self.x))
        b = np.stack([self.total(rows[:, k] * self.x) for k in range(rows.shape[1])], axis=1)
        return solve_or_zero(self.gram(rows, rows, one), b)

    def search(self, tol: float, most: int) -> np.ndarray:
        """The scale's first coefficient that minimises each feature's loss: a grid, then golden section around its best point."""
        eta, low, high = self.eta(self.theta), *self.bounds["theta_scale"]
        rest = self.s.copy()

        def at(v: np.ndarray) -> np.ndarray:
            rest[:, 0] = v
            loss = self.loss(eta, rest)
            return np.where(np.isnan(loss), np.inf, loss)

        a, b = np.maximum(low, self.s[:, 0] - REACH), np.minimum(high, self.s[:, 0] + REACH)
        grid = np.linspace(0, 1, 41)
        losses = np.stack([at(a + (b - a) * g) for g in grid])
        best = losses.argmin(axis=0)
        a, b = a + (b - a) * grid[np.maximum(best - 1, 0)], a + (b - a) * grid[np.minimum(best + 1, len(grid) - 1)]
        c, d = b - GOLDEN * (b - a), a + GOLDEN * (b - a)
        fc, fd = at(c), at(d)
        for _ in range(most):
            if (b - a).max(initial=0) <= tol:
                break
            left = fc < fd
            a, b = np.where(left, a, c), np.where(left, d, b)
            c, d = np.where(left, b - GOLDEN * (b - a), d), np.where(left, c, a + GOLDEN * (b - a))
            new = at(np.where(left, c, d))
            fc, fd = np.where(left, new, fd), np.where(left, fc, new)
        out = self.s.copy()
        out[:, 0] = (a + b) / 2
        return out

    def descend(self, tol: float, most: int, rate: float) -> np.ndarray:
        """Gradient steps of the scale, each feature's rate halved when a step makes its loss worse."""
        eta, s = self.eta(self.theta), self.s.copy()
        loss, open_, step = self.loss(eta, s), np.ones(self.n, bool), np.full(self.n, float(rate))
        for _ in range(most):
            w = weights_np(self.fam, self.x, eta, self.scale_eta(s))["jac_scale"]
            grad = np.stack([self.total(self.scale[:, k] * w) for k in range(self.scale.shape[1])], axis=1) / max(self.n_obs, 1)
            new = np.where(open_[:, None], np.clip(s + step[:, None] * 100 * grad, *self.bounds["theta_scale"]), s)
            now = self.loss(eta, new)
            worse = ~(now <= loss)
            s = np.where(worse[:, None], s, new)
            open_ &= worse | (np.abs(now - loss) / np.maximum(np.abs(loss), 1e-300) > tol)
            step = np.where(worse, step / 2, step * 1.2)
            loss = np.where(worse, loss, now)
            if not open_.any():
                break
        return s


def _train(b: Block, train_loc: bool, train_scale: bool, phase: Mapping, history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Run one phase; steps taken by each feature and whether it converged."""
    freq = 1 if train_scale and not train_loc else phase.get("update_scale_freq", 5) if train_scale else 10**10
    most, method = phase.get("max_steps", 100), phase.get("method_scale", "brent").lower()
    if method not in ("brent", "gd", "golden"):
        raise ValueError(f"method_scale {method!r} not recognized")
    loss = b.loss(b.eta(b.theta), b.s)
    at_scale = loss.copy()
    done, settled, steps, k = np.zeros(b.n, bool), np.zeros(b.n, bool), np.zeros(b.n, np.int64), freq
    history.append(loss)
    rel = lambda old, new: (old < new) | (np.abs(old - new) / np.maximum(np.finfo(float).tiny, np.abs(old)) < LL_TOLERANCE)
    while not done.all() and len(history) <= most:
        if k == 0:
            open_ = ~done
            if train_scale:
                new = b.descend(phase.get("ftol_scale", 1e-8), phase.get("max_iter_scale", 1000), phase.get("lr_scale", 1e-2)) if method == "gd" else b.search(phase.get("ftol_scale", 1e-8), phase.get("max_iter_scale", 1000))
                now = b.loss(b.eta(b.theta), new)
                take = open_ & (now <= loss)
                b.s[take], loss = new[take], np.where(take, now, loss)
            k = freq
            done = done | rel(at_scale, loss)
            settled, at_scale = done.copy(), loss.copy()
        else:
            before, open_ = loss.copy(), ~settled
            if train_loc:
                new = b.irls()
                now = b.loss(b.eta(new), b.s)
                for _ in range(HALVINGS):
                    worse = open_ & ~(now <= loss)
                    if not worse.any():
                        break
                    new[worse] = (new[worse] + b.theta[worse]) / 2
                    now = b.loss(b.eta(new), b.s)
                take = open_ & (now <= loss)
                b.theta[take], loss = new[take], np.where(take, now, loss)
            k -= 1
            settled = settled | rel(before, loss)
            if settled.all():
                k = 0
        steps += open_
        history.append(loss)
        if logger.isEnabledFor(logging.DEBUG):
            logger.debug("step %d: loss %.6f, %.1f %% converged", len(history) - 1, loss.sum(), 100 * done.mean())
    return steps, done


FIT_SCHEMA = (
    "feature string, theta_loc array<double>, theta_scale array<double>, ll double, jacobian array<double>, gradient_norm double, "
    "hessian array<array<double>>, fisher_inv array<array<double>>, n_iter long, converged boolean, status string, history array<double>"
)


def _finalize(b: Block) -> tuple:
    w = weights_np(b.fam, b.x, b.eta(b.theta), b.scale_eta(b.s))
    fim = b.gram(b.loc, b.loc, w["fim_ll"])
    jac = np.stack([b.total(b.loc[:, k] * w["fim_ll"] * w["ybar"]) for k in range(b.loc.shape[1])], axis=1)
    if b.fam.has_scale:
        jac = np.hstack([jac, np.stack([b.total(b.scale[:, k] * w["jac_scale"]) for k in range(b.scale.shape[1])], axis=1)])
    if b.fam.name == "norm":
        lower = b.gram(b.scale, b.scale, w["fim_ss"])
        p, q = fim.shape[1], lower.shape[1]
        full = np.zeros((b.n, p + q, p + q))
        full[:, :p, :p], full[:, p:, p:] = fim, lower
        fim = full
    return -b.loss(b.eta(b.theta), b.s), jac, fim, inverse_or_zero(fim)


def fit_block(pdf: pd.DataFrame, fam: Family, c_loc: np.ndarray, c_scale: np.ndarray, train_loc: bool, train_scale: bool, phases: Sequence[Mapping], n_obs: int, sized: bool, compat: bool) -> pd.DataFrame:
    names, of = np.unique(pdf["feature"].to_numpy(dtype=object), return_inverse=True)
    first = np.unique(of, return_index=True)[1]
    stack = lambda c: np.stack(pdf[c].to_numpy()).astype(float)
    b = Block(
        fam, pdf["x"].to_numpy(float), pdf["cnt"].to_numpy(float), of, stack("loc") @ c_loc, stack("scale") @ c_scale, pdf["size_factor"].to_numpy(float) if sized else None,
        np.clip(np.stack(pdf["theta_loc"].to_numpy()[first]).astype(float), *fam.bounds()["theta_location"]),
        np.clip(np.stack(pdf["theta_scale"].to_numpy()[first]).astype(float), *fam.bounds()["theta_scale"]), n_obs, compat,
    )
    history: list[np.ndarray] = []
    if fam.name == "norm" and train_loc:
        b.theta, train_loc = b.least_squares(), False
    steps, done = np.zeros(b.n, np.int64), np.ones(b.n, bool)
    for phase in phases if train_loc or train_scale else ():
        trace: list[np.ndarray] = []
        more, done = _train(b, train_loc, train_scale, phase, trace)
        steps += more
        history += trace
    ll, jac, fim, inverse = _finalize(b)
    low, high = fam.bounds()["theta_scale"]
    edge = (b.s[:, 0] <= low + 1e-3) | (b.s[:, 0] >= high - 1e-3) if fam.has_scale else np.zeros(b.n, bool)
    singular = ~np.any(inverse, axis=(1, 2))
    status = np.where(singular, "singular", np.where(edge, "at_bound", np.where(done, "converged", "max_steps")))
    trace = np.stack(history, axis=1) if history else np.zeros((b.n, 0))
    return pd.DataFrame({
        "feature": names, "theta_loc": list(b.theta), "theta_scale": list(b.s), "ll": ll, "jacobian": list(jac), "gradient_norm": np.abs(jac / max(n_obs, 1)).sum(axis=1),
        "hessian": [[list(r) for r in -m] for m in fim], "fisher_inv": [[list(r) for r in m] for m in inverse], "n_iter": steps, "converged": done, "status": status, "history": list(trace),
    })


def fit(
    inp: GlmInput,
    fam: Family | str,
    init_location: str = "auto",
    init_scale: str = "auto",
    quick_scale: bool = False,
    strategy: Strategy | str | Sequence[Mapping] | None = None,
    blocks: int | None = None,
    compat: bool = False,
    **train,
) -> DataFrame:
    """One row per feature of FIT_SCHEMA: parameters, log-likelihood, gradient, Hessian, inverse information, steps and status.

    quick_scale leaves the scale as it is initialised. blocks: feature blocks, one task each; by default
    two per shuffle partition at most, so that a block's cells stay a small part of an executor's memory.
    """
    fam = family(fam)
    if not fam.trainable:
        raise NotImplementedError(f"the {fam.name} family has closed forms alone")
    if fam.has_scale and inp.num_scale_params > 1:
        raise ValueError("cannot model more than one scale parameter")
    start, train_loc, train_scale = init_par(inp, fam, init_location, init_scale, compat)
    train_scale = train_scale and not quick_scale
    phases = strategy_phases(strategy, **train)
    spark = inp.x.sparkSession
    blocks = blocks or SETTINGS.blocks or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_obs, c_loc, c_scale, sized = inp.num_observations, inp.c_loc(), inp.c_scale(), inp.has_size_factors
    # the normal likelihood and its derivatives take x by its first two powers alone
    source = inp.moment_cells() if fam.name == "norm" else inp.cells()
    cells = source.join(start, "feature").withColumn("block", F.pmod(F.hash("feature"), F.lit(blocks)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fit_block(pdf, fam, c_loc, c_scale, train_loc, train_scale, phases, n_obs, sized, compat)

    fields = cells.select("block", "feature", "loc", "scale", "size_factor", F.col("x").cast("double").alias("x"), "cnt", "theta_loc", "theta_scale")
    return fields.groupBy("block").applyInPandas(lambda pdf: run(pdf), FIT_SCHEMA)


def fit_nb(inp: GlmInput, **kw) -> DataFrame:
    return fit(inp, "nb", **kw)


def fit_poisson(inp: GlmInput, **kw) -> DataFrame:
    return fit(inp, "poisson", **kw)


def fit_norm(inp: GlmInput, **kw) -> DataFrame:
    return fit(inp, "norm", **kw)


def history(fitted: DataFrame) -> DataFrame:
    """(step, feature, loss) of a fit."""
    return fitted.select("feature", F.posexplode("history").alias("step", "loss")).select("step", "feature", "loss")


def progress(fitted: DataFrame) -> DataFrame:
    """(features, loss, converged): total loss and share of converged features."""
    return fitted.agg(F.count(F.lit(1)).alias("features"), F.sum(-F.col("ll")).alias("loss"), F.avg(F.col("converged").cast("double")).alias("converged"))
