"""Sets of rules over tables, recursive ones too, by semi-naive evaluation.

    solve({"source": sources, "passes": passes}, [
        Rule(Atom("tainted", "f"), [Atom("source", "f")]),
        Rule(Atom("tainted", "g"), [Atom("tainted", "f"), Atom("passes", "f", "g")]),
        Rule(Atom("clean", "f"), [Atom("flow", "f")], absent=[Atom("tainted", "f")]),
    ])

A table's rows are an atom's values by position; a term is a variable, Value(x) for a constant, or "_". Tables are sets: nulls are in none and
repeated rows count once. Rules are sorted into layers: those that depend on each other are solved together, and a table that is negated
must be of an earlier layer. Within a layer each round joins what the last round found (the delta) with the rest, so a row is joined
once, not in every round; a round writes its delta alone and the deltas are made one table every TOGETHER rounds, so neither the lineage
nor the number of tables grows with the depth. The rounds end when no delta is left.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.checkpoints import table

#: Rounds after which the deltas of a table are made one.
TOGETHER = 16


@dataclass(frozen=True)
class Value:
    value: object


@dataclass(frozen=True)
class Atom:
    name: str
    terms: tuple

    def __init__(self, name: str, *terms) -> None:
        object.__setattr__(self, "name", name)
        object.__setattr__(self, "terms", terms)

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(t for t in self.terms if isinstance(t, str) and t != "_"))

    def bound(self, rows: DataFrame) -> DataFrame:
        """Its variables as columns, of the rows that its constants and repeated variables allow."""
        if len(rows.columns) != len(self.terms):
            raise ValueError(f"{self.name} has {len(rows.columns)} columns, not {len(self.terms)}")
        out, first = rows.toDF(*[f"c{k}" for k in range(len(self.terms))]), {}
        for k, t in enumerate(self.terms):
            if isinstance(t, Value):
                out = out.where(F.col(f"c{k}") == F.lit(t.value))
            elif t != "_":
                out = out.where(F.col(f"c{k}") == F.col(f"c{first[t]}")) if t in first else out.where(F.col(f"c{k}").isNotNull())
                first.setdefault(t, k)
        return out.select(*[F.col(f"c{k}").alias(t) for t, k in first.items()]) if first else out.select(F.lit(1).alias("_"))


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: list[Atom]
    absent: list[Atom] = field(default_factory=list)
    where: Column | None = None

    def check(self) -> None:
        known = {v for a in self.body for v in a.variables}
        loose = [t for a in (self.head, *self.absent) for t in a.variables if t not in known]
        if not self.body or loose or "_" in self.head.terms:
            raise ValueError(f"{self.head.name}: the body must bind {', '.join(loose) or 'every term of the head'}")


def layers(rules: list[Rule]) -> list[list[Rule]]:
    """The rules in layers. A table is in the layer after those that it negates, and not before those that it uses."""
    heads = {r.head.name for r in rules}
    level = dict.fromkeys(heads, 0)
    for _ in range(len(heads) + 1):
        moved = False
        for r in rules:
            least = max([0, *(level[a.name] for a in r.body if a.name in heads), *(level[a.name] + 1 for a in r.absent if a.name in heads)])
            if least > level[r.head.name]:
                level[r.head.name], moved = least, True
        if not moved:
            return [[r for r in rules if level[r.head.name] == k] for k in sorted(set(level.values()))]
    raise ValueError("a table is negated by rules that it depends on")


def _fired(rule: Rule, tables: dict[str, DataFrame], first: int, used: list[DataFrame]) -> DataFrame:
    """The head's rows, with the body's atoms taken from `used`. The joins start at atom `first` and follow shared variables."""
    left = {k: a.bound(t) for k, (a, t) in enumerate(zip(rule.body, used, strict=True))}
    out = left.pop(first)
    while left:
        on = {k: [v for v in rule.body[k].variables if v in out.columns] for k in left}
        k = max(left, key=lambda k: (len(on[k]), -k))
        if not on[k]:
            raise ValueError(f"{rule.head.name}: the atoms of its body share no variable")
        needed = {v for a in (rule.head, *rule.absent) for v in a.variables} | {v for j in left if j != k for v in rule.body[j].variables}
        new = left.pop(k)
        filters_only = rule.where is None and not any(v in needed for v in new.columns if v not in out.columns)
        out = out.join(new, on[k], "left_semi" if filters_only else "inner")
    if rule.where is not None:
        out = out.where(rule.where)
    for a in rule.absent:
        own = a.bound(tables[a.name])
        out = out.join(own, a.variables, "left_anti")
    terms = [F.lit(t.value) if isinstance(t, Value) else F.col(t) for t in rule.head.terms]
    return out.select(*[t.alias(f"c{k}") for k, t in enumerate(terms)])


def _without(df: DataFrame, seen: list[DataFrame]) -> DataFrame:
    return df.join(reduce(DataFrame.union, seen), df.columns, "left_anti") if seen else df


def solve(tables: dict[str, DataFrame], rules: list[Rule], most: int | None = None) -> dict[str, DataFrame]:
    """The tables that the rules derive, by name, with columns c0, c1, ...; `most` bounds the rounds (more are an error)."""
    for r in rules:
        r.check()
    known = dict(tables)
    for layer in layers(rules):
        own = {r.head.name for r in layer}
        steps: dict[str, list[DataFrame]] = {n: [] for n in own}  # what is known of each table, in disjoint parts
        delta: dict[str, DataFrame] = {}

        def found(fired: dict[str, list[DataFrame]], steps=steps) -> dict[str, DataFrame]:
            new = {n: table(_without(reduce(DataFrame.union, rows).distinct(), steps[n])) for n, rows in fired.items() if rows}
            return {n: d for n, d in new.items() if not d.isEmpty()}

        start: dict[str, list[DataFrame]] = {n: [] for n in own}
        for r in layer:
            if not any(a.name in own for a in r.body):
                start[r.head.name].append(_fired(r, known, 0, [known[a.name] for a in r.body]))
        # Given tables that are joined in every round are made once.
        known |= {n: table(known[n]) for n in {a.name for r in layer if any(b.name in own for b in r.body) for a in r.body} - own}
        delta, rounds = found(start), 0
        while delta:
            rounds += 1
            if most is not None and rounds > most:
                raise ValueError(f"no end after {most} rounds")
            before = {n: list(s) for n, s in steps.items()}
            for n, d in delta.items():
                steps[n] = [table(reduce(DataFrame.union, [*steps[n], d]))] if rounds % TOGETHER == 0 else [*steps[n], d]
            fired: dict[str, list[DataFrame]] = {n: [] for n in own}
            for r in layer:
                for k, a in enumerate(r.body):
                    if a.name not in delta:
                        continue
                    # What is new at atom k meets all that is known at atoms before it, and all but the new at atoms after it.
                    used = []
                    for j, b in enumerate(r.body):
                        parts = [delta[b.name]] if j == k else known.get(b.name) if b.name not in own else steps[b.name] if j < k else before[b.name]
                        used.append(parts if isinstance(parts, DataFrame) else reduce(DataFrame.union, parts) if parts else None)
                    if all(u is not None for u in used):
                        fired[r.head.name].append(_fired(r, known, k, used))
            delta = found(fired)
        for n in own:
            if steps[n]:
                known[n] = reduce(DataFrame.union, steps[n])
            else:  # nothing was derived: an empty table of the right types
                r = next((r for r in layer if r.head.name == n and all(a.name in known for a in r.body)), None)
                if r is None:
                    raise ValueError(f"no rule of {n} starts from given tables")
                known[n] = _fired(r, known, 0, [known[a.name] for a in r.body]).limit(0)
    return {r.head.name: known[r.head.name] for r in rules}
