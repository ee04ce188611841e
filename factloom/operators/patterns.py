"""Rules with any number of patterns that share variables: all bindings, by semi-join reduction before any join.

    Pattern("weak", "Vulnerability", {"f": "file", "w": "flow_id"}, "severity = 'Critical'")
    Pattern("bare", "UncoveredLine", {"f": "file"})

Each pattern picks facts and names the columns that its variables bind. The patterns are put in a tree in which every variable's patterns
hang together. A pass from the leaves up and one from the root down keep, of each pattern, the facts that are in some whole binding. The
joins from the root on then make no row that is not part of a result, so no table in between is larger than the input and the output, whatever
the order in which a plain plan would have joined. The pattern with the fewest facts, as counted in one pass, is the root and is joined
first. Patterns that share variables in a cycle have no such tree and are an error; so are patterns that share none, whose bindings would be
a product.

A null value binds nothing. A pattern with exists=True must have a fact but binds no variable of its own and does not multiply bindings.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.checkpoints import table


@dataclass(frozen=True)
class Pattern:
    name: str
    kind: str
    variables: dict[str, str]
    condition: str = "true"
    exists: bool = False
    keep: tuple[str, ...] = ("fact_id",)

    def meets(self) -> Column:
        bound = F.lit(True)
        for column in self.variables.values():
            bound = bound & F.col(column).isNotNull()
        return (F.col("fact_type") == self.kind) & F.coalesce(F.expr(self.condition), F.lit(False)) & bound

    def rows(self, facts: DataFrame) -> DataFrame:
        """Its variables, and (unless it only has to exist) the columns that it keeps, as <name>_<column>."""
        out = facts.where(self.meets())
        variables = [F.col(c).alias(v) for v, c in self.variables.items()]
        return out.select(*variables).distinct() if self.exists else out.select(*variables, *[F.col(c).alias(f"{self.name}_{c}") for c in self.keep])


@dataclass
class Plan:
    """The patterns from the root on: of each its parent and the variables that it shares with it; and their counted facts."""

    order: list[Pattern]
    parent: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)


def counted(facts: DataFrame, patterns: list[Pattern]) -> dict[str, int]:
    """The facts of each pattern, in one pass."""
    row = facts.agg(*[F.count_if(p.meets()).alias(p.name) for p in patterns]).first()
    return row.asDict()


def tree(patterns: list[Pattern], counts: dict[str, int]) -> Plan:
    """A join tree: again and again, the pattern with most facts whose shared variables another pattern has all becomes a leaf below the one
    of those with fewest facts. Existence patterns go first, so that none of them has anything below it."""
    left, removed = list(patterns), []
    plan = Plan([], counts=counts)
    while len(left) > 1:
        for p in sorted(left, key=lambda p: (not p.exists, -counts[p.name], p.name)):
            others = [o for o in left if o is not p]
            shared = {v for v in p.variables if any(v in o.variables for o in others)}
            hosts = [o for o in others if shared <= o.variables.keys() and not o.exists]
            if shared and hosts:
                host = min(hosts, key=lambda o: (counts[o.name], o.name))
                plan.parent[p.name] = (host.name, tuple(sorted(shared)))
                break
        else:
            raise ValueError("these patterns share no variable, or share variables in a cycle: " + ", ".join(sorted(p.name for p in left)))
        left.remove(p)
        removed.append(p)
    if left[0].exists:
        raise ValueError("some pattern must bind variables")
    plan.order = [left[0], *reversed(removed)]
    return plan


def reduced(facts: DataFrame, patterns: list[Pattern]) -> tuple[Plan, dict[str, DataFrame]]:
    """The plan, and of each binding pattern the rows that are in some whole binding; they are written, so that each is made once."""
    if len({p.name for p in patterns}) < len(patterns) or not patterns:
        raise ValueError("patterns need names of their own")
    plan = tree(patterns, counted(facts, patterns))
    rows = {p.name: p.rows(facts) for p in patterns}
    known = {p.name: p for p in patterns}
    inner = {host for host, _ in plan.parent.values()}
    for p in reversed(plan.order[1:]):  # the leaves first
        host, on = plan.parent[p.name]
        if p.name in inner:
            rows[p.name] = table(rows[p.name])
        rows[host] = rows[host].join(rows[p.name], list(on), "left_semi")
    rows[plan.order[0].name] = table(rows[plan.order[0].name])
    for p in plan.order[1:]:
        host, on = plan.parent[p.name]
        if known[p.name].exists:
            del rows[p.name]
        else:
            rows[p.name] = table(rows[p.name].join(rows[host], list(on), "left_semi"))
    plan.order = [p for p in plan.order if not p.exists]
    return plan, rows


def partial_bindings(plan: Plan, rows: dict[str, DataFrame]) -> list[DataFrame]:
    """The joins from the root on, the last being all bindings; each has at most as many rows as the next."""
    out = [rows[plan.order[0].name]]
    for p in plan.order[1:]:
        out.append(out[-1].join(rows[p.name], list(plan.parent[p.name][1])))
    return out


def bindings(facts: DataFrame, patterns: list[Pattern], where: Column | None = None) -> DataFrame:
    """A row for each whole binding: the variables, and <name>_<column> of each pattern; `where` compares what was bound."""
    plan, rows = reduced(facts, patterns)
    out = partial_bindings(plan, rows)[-1]
    return out if where is None else out.where(where)
