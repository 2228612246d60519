"""Linear constraints on coefficients: from a dict of nested factors, from equations, or as a matrix.

A constraint matrix has a row per coefficient of the design and a column per free coefficient.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .formula import Design, design_matrix


@dataclass(frozen=True)
class ConstraintSystem:
    design: Design | np.ndarray
    names: list[str]
    matrix: np.ndarray | None
    terms: list[str]


def parse_equation(text: str, names: Sequence[str]) -> list[str]:
    """The coefficients of `a + b + ... = 0`; other weights and right-hand sides are refused."""
    left, mark, right = text.partition("=")
    if not mark or right.strip() != "0":
        raise ValueError(f"a constraint reads 'a + b = 0': {text!r}")
    parts = [p.strip() for p in re.split(r"\+(?![^\[]*\])", left)]
    unknown = [p for p in parts if p not in names]
    if unknown:
        raise ValueError(f"not a coefficient: {', '.join(unknown)}")
    if len(parts) < 2:
        raise ValueError(f"a constraint of a single coefficient: {text!r}")
    return parts


def constraint_matrix(names: Sequence[str], equations: Sequence[str]) -> np.ndarray:
    """The matrix of the equations; the first coefficient of each depends on the others."""
    parsed = [parse_equation(e, names) for e in equations]
    dependent = [p[0] for p in parsed]
    if len(set(dependent)) < len(dependent):
        raise ValueError("two constraints determine the same coefficient")
    free = [n for n in names if n not in dependent]
    out = np.zeros((len(names), len(free)))
    for k, n in enumerate(free):
        out[list(names).index(n), k] = 1.0
    for p in parsed:
        for other in p[1:]:
            if other not in free:
                raise ValueError(f"{other} is determined by another constraint")
            out[list(names).index(p[0]), free.index(other)] = -1.0
    if np.linalg.matrix_rank(out) < out.shape[1]:
        raise ValueError("the constraint matrix has not full column rank")
    return out


def nested_equations(sample_description: DataFrame, constraints: Mapping[str, str]) -> list[str]:
    """For each level of the grouping factor: the levels of the constrained factor found in it sum to 0."""
    out = []
    for inner, outer in constraints.items():
        groups = (
            sample_description.select(inner, outer).distinct().groupBy(outer)
            .agg(F.sort_array(F.collect_set(inner)).alias("levels")).orderBy(outer).collect()
        )
        seen: set = set()
        for g in groups:
            levels = list(g["levels"])
            if seen & set(levels):
                raise ValueError(f"{inner} is not nested in {outer}")
            seen |= set(levels)
            if len(levels) > 1:
                out.append(" + ".join(f"{inner}[{v}]" for v in levels) + " = 0")
    return out


def from_dict(constraints: Mapping[str, str], sample_description: DataFrame, formula: str, as_categorical=True) -> ConstraintSystem:
    """Constrained factors get a column for every level, after the columns of the rest of the formula."""
    rest = [t.strip() for t in formula.split("~", 1)[-1].split("+")]
    rest = [t for t in rest if t not in constraints]
    base = design_matrix(sample_description, "~" + "+".join(rest), as_categorical)
    columns, levels = list(base.columns), dict(base.levels)
    for inner in constraints:
        own = design_matrix(sample_description.select(inner), f"~0+{inner}")
        columns += own.columns
        levels |= own.levels
    design = Design(columns, levels, formula)
    return ConstraintSystem(design, design.names, constraint_matrix(design.names, nested_equations(sample_description, constraints)), design.terms)


def constraint_system(
    constraints: Mapping[str, str] | Sequence[str] | np.ndarray | None,
    design: Design | np.ndarray | None = None,
    sample_description: DataFrame | None = None,
    formula: str | None = None,
    as_categorical=True,
    names: Sequence[str] | None = None,
    distinct_rows: np.ndarray | None = None,
) -> ConstraintSystem:
    """Design, names, matrix and terms of any kind of constraints.

    distinct_rows, the distinct rows of the design, lets the product with the matrix be checked for full rank.
    """
    if isinstance(constraints, Mapping):
        out = from_dict(constraints, sample_description, formula, as_categorical)
    else:
        if design is None:
            design = design_matrix(sample_description, formula, as_categorical)
        own = list(names) if names is not None else design.names if isinstance(design, Design) else []
        terms = design.terms if isinstance(design, Design) else own
        if constraints is None:
            out = ConstraintSystem(design, own, None, terms)
        elif isinstance(constraints, np.ndarray):
            if own and constraints.shape[0] != len(own):
                raise ValueError(f"the constraint matrix has {constraints.shape[0]} rows for {len(own)} coefficients")
            out = ConstraintSystem(design, own, constraints, terms)
        elif isinstance(constraints, Sequence) and not isinstance(constraints, str):
            out = ConstraintSystem(design, own, constraint_matrix(own, constraints), terms)
        else:
            raise TypeError(f"constraints of type {type(constraints)} are not known")
    if distinct_rows is not None:
        assert_full_rank(distinct_rows, out.matrix)
    return out


def assert_full_rank(rows: np.ndarray, matrix: np.ndarray | None) -> None:
    product = rows if matrix is None else rows @ matrix
    if np.linalg.matrix_rank(product) < product.shape[1]:
        raise ValueError(f"constrained design has rank {np.linalg.matrix_rank(product)} and {product.shape[1]} columns")


def free_names(matrix: np.ndarray | None, names: Sequence[str]) -> list[str]:
    """Names of the free coefficients: the design's name where a column maps one coefficient, else var_i."""
    if matrix is None:
        return list(names)
    if matrix.shape[0] != len(names):
        raise ValueError(f"the constraint matrix has {matrix.shape[0]} rows for {len(names)} coefficients")
    return [f"var_{k}" if np.count_nonzero(c) > 1 else names[int(np.flatnonzero(c)[0])] for k, c in enumerate(matrix.T)]
