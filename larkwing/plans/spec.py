"""What a model's utility is made of: Wilkinson formulas and scoped terms, both turned into named Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Design:
    """Named columns of the linear predictor, and what is known about their coefficients."""

    columns: dict[str, Column]
    fixed: dict[str, float] = field(default_factory=dict)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    initial: dict[str, float] = field(default_factory=dict)

    names = property(lambda self: list(self.columns))


@dataclass(frozen=True)
class InteractionTerm:
    name: str
    left: str
    right: str
    op: str = "product"
    missing_policy: str = "error"


def interaction(name: str, left: str, right: str, missing_policy: str = "error") -> InteractionTerm:
    return InteractionTerm(name, left, right, "product", missing_policy)


@dataclass(frozen=True)
class ScopedTerm:
    variable: str
    scope: str = "generic"  # generic, alternative, group
    name: str | None = None
    reference: object = None
    groups: dict | None = None
    fixed: float | None = None
    bounds: tuple[float, float] | None = None

    def __post_init__(self):
        if self.scope not in ("generic", "alternative", "group"):
            raise ValueError(f"unknown scope {self.scope!r}")
        if self.scope == "group" and not self.groups:
            raise ValueError("a grouped term needs groups")


@dataclass(frozen=True)
class ModelSpec:
    """Copy-on-write: every method returns a new specification."""

    terms: tuple[ScopedTerm, ...] = ()
    interactions: tuple[InteractionTerm, ...] = ()

    def _and(self, term: ScopedTerm) -> ModelSpec:
        return replace(self, terms=(*self.terms, term))

    def generic(self, variable: str, name: str | None = None) -> ModelSpec:
        return self._and(ScopedTerm(variable, name=name))

    def alternative_specific(self, variable: str, name: str | None = None, reference=None) -> ModelSpec:
        return self._and(ScopedTerm(variable, "alternative", name, reference))

    def grouped(self, variable: str, groups: dict, name: str | None = None) -> ModelSpec:
        return self._and(ScopedTerm(variable, "group", name, groups=groups))

    def fixed(self, variable: str, value: float = 0.0) -> ModelSpec:
        return self._and(ScopedTerm(variable, fixed=value))

    def bounded(self, variable: str, lower: float = -1e6, upper: float = 1e6, scope: str = "generic", groups: dict | None = None, reference=None) -> ModelSpec:
        if lower > upper:
            raise ValueError("lower is above upper")
        return self._and(ScopedTerm(variable, scope, groups=groups, reference=reference, bounds=(lower, upper)))

    def with_interaction(self, term: InteractionTerm) -> ModelSpec:
        return replace(self, interactions=(*self.interactions, term))

    def prepare_data(self, table):
        for t in self.interactions:
            table = table.add_interaction(t.name, t.left, t.right, t.op, t.missing_policy)
        return table

    def validate(self, table) -> None:
        missing = [t.variable for t in self.terms if t.variable != "1" and t.variable not in table.df.columns]
        if missing:
            raise KeyError(f"not in the table: {missing}")

    def design(self, table) -> Design:
        self.validate(table)
        columns, fixed, bounds = {}, {}, {}
        for t in self.terms:
            base, value = t.name or t.variable, F.lit(1.0) if t.variable == "1" else F.col(t.variable).cast("double")
            if t.scope == "generic":
                made = {base: value}
            elif t.scope == "group":
                made = {f"{base}[{g}]": F.when(F.col(table.alt_id).isin(list(ids)), value).otherwise(0.0) for g, ids in t.groups.items()}
            else:
                alts = [r[0] for r in table.universe.select(table.alt_id).orderBy(table.alt_id).collect()]
                made = {f"{base}[{a}]": F.when(F.col(table.alt_id) == F.lit(a), value).otherwise(0.0) for a in alts if a != t.reference}
            columns |= made
            if t.fixed is not None:
                fixed |= dict.fromkeys(made, t.fixed)
            if t.bounds and t.bounds != (-1e6, 1e6):
                bounds |= dict.fromkeys(made, t.bounds)
        return Design(columns, fixed, bounds)

    def param_metadata(self, table) -> list[dict]:
        d = self.design(table)
        return [{"name": n, "fixed": d.fixed.get(n), "bounds": d.bounds.get(n)} for n in d.names]


def _split_terms(formula: str) -> list[str]:
    """At + outside parentheses; terms after a minus sign keep it."""
    out, depth, now = [], 0, ""
    for c in formula.split("~")[-1]:
        depth += (c == "(") - (c == ")")
        if c in "+-" and depth == 0:
            out.append(now)
            now = "-" if c == "-" else ""
        else:
            now += c
    return [t.strip() for t in [*out, now] if t.strip() and t.strip() != "-"]


def _factor(text: str, table) -> dict[str, Column]:
    text = text.strip()
    if m := re.fullmatch(r"I\((.*)\)", text):
        sql = re.sub(r"([\w.]+|\([^()]*\))\s*\*\*\s*([\w.]+)", r"power(\1, \2)", m[1])
        return {text: F.expr(sql).cast("double")}
    if m := re.fullmatch(r"C\(\s*(\w+)\s*\)", text):
        levels = [r[0] for r in table.df.select(m[1]).distinct().orderBy(m[1]).collect() if r[0] is not None]
        return {f"{text}[{v}]": F.when(F.col(m[1]) == F.lit(v), 1.0).otherwise(0.0) for v in levels[1:]}
    if m := re.fullmatch(r"(log|exp|sqrt|abs|log1p)\((.*)\)", text):
        return {text: F.expr(f"{m[1]}({m[2]})").cast("double")}
    if text not in table.df.columns:
        raise KeyError(f"not in the table: {text}")
    return {text: F.col(text).cast("double")}


def formula_design(formula: str, table) -> Design:
    """a + b, a:b, a*b, I(expression), C(category) (the first level is the base) and log(), exp(), sqrt(), abs(), log1p().
    There is never an intercept, which a choice model cannot identify; 1, 0 and -1 are ignored."""
    columns: dict[str, Column] = {}
    for term in _split_terms(formula):
        if term in ("0", "1", "-1", "-0"):
            continue
        if term.startswith("-"):
            columns.pop(term[1:].strip(), None)
            continue
        parts, depth, now, star = [], 0, "", False
        for c in term:
            depth += (c == "(") - (c == ")")
            if c in ":*" and depth == 0:
                star |= c == "*"
                parts.append(now)
                now = ""
            else:
                now += c
        parts.append(now)
        factors = [_factor(p, table) for p in parts]
        if star:
            for f in factors:
                columns |= f
        product = {"": F.lit(1.0)} if len(factors) > 1 else factors[0]
        if len(factors) > 1:
            for f in factors:
                product = {(f"{a}:{b}" if a else b): x * y for a, x in product.items() for b, y in f.items()}
        columns |= product
    if not columns:
        raise ValueError("the formula has no terms")
    return Design(columns)


def design_of(table, formula: str | None = None, spec: ModelSpec | None = None) -> Design:
    if spec is not None:
        return spec.design(table)
    if formula:
        return formula_design(formula, table)
    return Design({c: F.col(c).cast("double") for c in table.numeric_columns()})
