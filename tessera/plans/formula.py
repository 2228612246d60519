"""A formula language for designs: `~ 1 + condition + batch`, `0`, `-1`, `a:b`, `a*b`, `C(x)`.

Factors are treatment-coded with the first sorted level dropped, unless the term's margin is not in the
model, in which case all levels are coded. Levels come from the data; every design column is a Spark
expression, so a design is one projection.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A factor with more levels than this is refused: its design would be as wide.
MAX_LEVELS = 10_000


@dataclass(frozen=True)
class Term:
    """Covariates that are multiplied; none: the intercept."""

    names: tuple[str, ...]


@dataclass(frozen=True)
class DesignColumn:
    name: str
    term: str
    #: Of each factor the level that must hold, of each numeric covariate None.
    parts: tuple[tuple[str, object], ...]

    def expression(self) -> Column:
        out = F.lit(1.0)
        for name, level in self.parts:
            out = out * (F.col(name).cast("double") if level is None else F.when(F.col(name) == F.lit(level), 1.0).otherwise(0.0))
        return out


def parse(formula: str) -> tuple[bool, list[Term], set[str]]:
    """Whether there is an intercept, the terms by order and place, and the names marked C()."""
    text = formula.split("~", 1)[1] if "~" in formula else formula
    if "~" in text:
        raise ValueError(f"more than one ~ in {formula!r}")
    forced = set(re.findall(r"C\(\s*(\w+)\s*\)", text))
    text = re.sub(r"C\(\s*(\w+)\s*\)", r"\1", text)
    intercept, terms = True, []
    for sign, part in re.findall(r"([+-]?)\s*([^+-]+)", text):
        part = re.sub(r"\s+", "", part)
        if not part:
            continue
        if part in ("0", "1"):
            intercept = (part == "1") == (sign != "-")
            continue
        if not re.fullmatch(r"[A-Za-z_]\w*([:*][A-Za-z_]\w*)*", part):
            raise ValueError(f"can't read {part!r} in {formula!r}")
        if "*" in part:
            if ":" in part:
                raise ValueError(f"':' and '*' in one term: {part!r}")
            names = part.split("*")
            wanted = [Term(tuple(n for k, n in enumerate(names) if m >> k & 1)) for m in range(1, 1 << len(names))]
        else:
            wanted = [Term(tuple(part.split(":")))]
        for t in wanted:
            if sign == "-":
                terms = [u for u in terms if set(u.names) != set(t.names)]
            elif all(set(u.names) != set(t.names) for u in terms):
                terms.append(t)
    terms.sort(key=lambda t: len(t.names))
    return intercept, terms, forced


class Design:
    """A compiled formula: names, terms and one expression per column."""

    def __init__(self, columns: list[DesignColumn], levels: dict[str, list], formula: str):
        self.columns, self.levels, self.formula = columns, levels, formula

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def terms(self) -> list[str]:
        return list(dict.fromkeys(c.term for c in self.columns))

    def array(self) -> Column:
        return F.array(*[c.expression() for c in self.columns])

    def attach(self, df: DataFrame, name: str = "loc") -> DataFrame:
        return df.withColumn(name, self.array())

    def rows(self, records: Iterable[dict]) -> np.ndarray:
        """The design of driver-side records."""
        return np.array([[float(np.prod([float(r[n]) if v is None else float(r[n] == v) for n, v in c.parts] or [1.0])) for c in self.columns] for r in records]).reshape(-1, len(self.columns))


def _levels(df: DataFrame, names: Sequence[str]) -> dict[str, list]:
    out = {}
    for n in names:
        rows = df.select(n).where(F.col(n).isNotNull()).distinct().orderBy(n).limit(MAX_LEVELS + 1).collect()
        if len(rows) > MAX_LEVELS:
            raise ValueError(f"{n} has more than {MAX_LEVELS} levels")
        out[n] = [r[0] for r in rows]
    return out


def design_matrix(sample_description: DataFrame, formula: str, as_categorical: bool | Sequence[bool] = True) -> Design:
    """Compile formula for the table's covariates.

    as_categorical: True for factors alone, False to keep numeric columns numeric, or a flag per column
    of the table. Null covariates fall in no level; a numeric null gives a null design value.
    """
    intercept, terms, forced = parse(formula)
    used = list(dict.fromkeys(n for t in terms for n in t.names))
    missing = [n for n in used if n not in sample_description.columns]
    if missing:
        raise ValueError(f"no such covariate: {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in sample_description.schema}
    if isinstance(as_categorical, bool):
        flags = dict.fromkeys(sample_description.columns, as_categorical)
    else:
        if len(as_categorical) != len(sample_description.columns):
            raise ValueError("as_categorical needs a flag per column")
        flags = dict(zip(sample_description.columns, as_categorical, strict=True))
    factors = [n for n in used if n in forced or flags[n] or not isinstance(kinds[n], T.NumericType)]
    levels = _levels(sample_description, factors)
    columns = [DesignColumn("Intercept", "Intercept", ())] if intercept else []
    done: list[frozenset] = [frozenset()] if intercept else []
    for t in terms:
        label, choices = ":".join(t.names), []
        for n in t.names:
            if n not in levels:
                choices.append([(n, None, n)])
                continue
            margin = frozenset(m for m in t.names if m != n)
            full = margin not in done
            choices.append([(n, v, f"{n}[{v}]" if full else f"{n}[T.{v}]") for v in levels[n][0 if full else 1 :]])
            if full:
                done.append(margin)
        # the first covariate's levels vary fastest
        for pick in product(*reversed(choices)):
            pick = pick[::-1]
            columns.append(DesignColumn(":".join(p[2] for p in pick), label, tuple((p[0], p[1]) for p in pick)))
        done.append(frozenset(t.names))
    return Design(columns, levels, formula)


def preview_coef_names(sample_description: DataFrame, formula: str, as_categorical: bool | Sequence[bool] = True) -> list[str]:
    return design_matrix(sample_description, formula, as_categorical).names


def view_coef_names(design) -> list[str]:
    """Names of a Design, or of a table with a column per coefficient."""
    if isinstance(design, Design):
        return design.names
    if hasattr(design, "columns"):
        return list(design.columns)
    raise ValueError(f"a design of type {type(design)} has no coefficient names")
