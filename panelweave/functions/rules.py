"""The fill-rule language.

A rule is text: ``value:0``, ``formula:a-b/c*100`` or ``method:name(key=value, ...)``. Formulas apply their
operators strictly from left to right, without precedence; a leading minus means ``0 - x``.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelweave.spec import q

LINEAR_METHODS = ("linear", "linear_or_mean", "linear_or_0")


@dataclass(frozen=True)
class Rule:
    kind: str  # value | formula | method
    body: str
    kwargs: Mapping[str, str] = field(default_factory=dict)

    @property
    def others(self) -> list[str]:
        """Regressor columns of ``method:approx``."""
        names = self.kwargs.get("other", "").strip("[] ")
        return [n.strip().lower() for n in names.split(",") if n.strip()]


def parse_rule(text: str) -> Rule:
    kind, sep, body = text.strip().partition(":")
    if not sep:
        raise ValueError(f"rule {text!r} has no ':'")
    kind = {"number": "value"}.get(kind, kind)
    if kind not in ("value", "formula", "method"):
        raise ValueError(f"unknown rule type {kind!r} in {text!r}")
    if kind == "value":
        float(body)
        return Rule(kind, body.strip())
    if kind == "formula":
        return Rule(kind, body.strip())
    found = re.fullmatch(r"\s*(\w+)\s*(?:\((.*)\))?\s*", body)
    if not found:
        raise ValueError(f"cannot read method rule {text!r}")
    kwargs = {}
    # Commas inside a [list] do not separate arguments.
    for part in re.findall(r"[^,\[]*\[[^\]]*\]|[^,]+", found.group(2) or ""):
        key, eq, value = part.partition("=")
        if not eq:
            warnings.warn(f"argument {part.strip()!r} of rule {text!r} has no '=' and is ignored", stacklevel=2)
            continue
        kwargs[key.strip()] = value.strip()
    return Rule(kind, found.group(1), kwargs)


def parse_rules(texts: Iterable[str]) -> list[Rule]:
    return [parse_rule(t) for t in texts]


def formula_terms(formula: str) -> list[tuple[str, str]]:
    """``a-b/c*100`` -> [('+', 'a'), ('-', 'b'), ('/', 'c'), ('*', '100')]."""
    parts = re.split(r"([/*+\-])", formula.replace(" ", "").lower())
    terms = [("+", parts[0] if parts[0] else "0")]
    terms += [(parts[i], parts[i + 1]) for i in range(1, len(parts), 2)]
    if any(not name for _, name in terms):
        raise ValueError(f"formula {formula!r} lacks an operand")
    return terms


def operands(rule: Rule) -> list[str]:
    """Names (lower case) of the columns that a rule reads besides its own."""
    if rule.kind == "formula":
        return [name for _, name in formula_terms(rule.body) if not name.isdigit()]
    return rule.others if rule.kind == "method" else []


def usable_rules(rules: Mapping[str, Sequence[Rule]], columns: Sequence[str]) -> tuple[dict[str, list[Rule]], list[str]]:
    """(rules by column as the frame spells it, texts about rules that can't apply).

    Names are matched without regard to case. A rule for a column that is not there, or that reads one, is left out.
    """
    known = {c.lower(): c for c in columns}
    kept: dict[str, list[Rule]] = {}
    left_out = []
    for name, own in rules.items():
        for rule in own:
            absent = [x for x in (name.lower(), *operands(rule)) if x not in known]
            if absent:
                left_out.append(f"{name}: {rule.kind}:{rule.body} needs {', '.join(dict.fromkeys(absent))}")
            else:
                kept.setdefault(known[name.lower()], []).append(rule)
    return kept, left_out


def compile_formula(formula: str, columns: Sequence[str]) -> Column:
    """Left-to-right expression; dividing by zero gives NULL. Unknown names raise here, before any job runs."""
    known = {c.lower(): c for c in columns}

    def operand(name: str) -> Column:
        if name.isdigit():
            return F.lit(float(name))
        if name not in known:
            raise ValueError(f"formula {formula!r} names the unknown column {name!r}")
        return q(known[name])

    (_, first), *rest = formula_terms(formula)
    out = operand(first)
    for sign, name in rest:
        x = operand(name)
        out = {
            "+": lambda a, b: a + b,
            "-": lambda a, b: a - b,
            "*": lambda a, b: a * b,
            "/": F.try_divide,
        }[sign](out, x)
    return out


def compile_rule(text: str, column: str, columns: Sequence[str]) -> Column:
    """A row-local rule (``value:`` or ``formula:``) as the filled form of ``column``."""
    rule = parse_rule(text)
    if rule.kind == "value":
        return F.coalesce(q(column), F.lit(float(rule.body)))
    if rule.kind == "formula":
        return F.coalesce(q(column), compile_formula(rule.body, columns))
    raise ValueError(f"{text!r} needs neighbouring rows: use operators.fill.apply_rules")
