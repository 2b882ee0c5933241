"""Graph-pattern algebra over a triple table, as joins.

A triple table has the columns s, p, o and may have more. ``Pattern`` builds plans step by step; variables are columns,
and shared variables are the join keys. Unbound values are null. Nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variables(*terms: str) -> list[str]:
    return list(dict.fromkeys(t[1:] for t in terms if t.startswith("?")))


def match(triples: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """Bindings of one triple pattern; terms starting with ``?`` are variables, others constants."""
    out, bound = triples, {}
    for column, term in (("s", s), ("p", p), ("o", o)):
        if not term.startswith("?"):
            out = out.where(F.col(column) == term)
        elif term in bound:
            out = out.where(F.col(column) == F.col(bound[term]))
        else:
            bound[term] = column
    return out.select(*[F.col(column).alias(term[1:]) for term, column in bound.items()]) if bound else out.limit(1).select(F.lit(True).alias("_matched"))


@dataclass(frozen=True)
class Pattern:
    """A plan of solutions; ``loose`` names the variables that may be unbound, which agree with any value in a join."""

    triples: DataFrame
    rows: DataFrame | None = None
    loose: frozenset[str] = frozenset()

    def _with(self, rows: DataFrame, loose: frozenset[str] | None = None) -> Pattern:
        return Pattern(self.triples, rows, self.loose if loose is None else loose & frozenset(rows.columns))

    def _joined(self, other: Pattern, how: str) -> Pattern:
        """Join on what both name. Without an unbound variable that is an equi-join; else unbound ones agree with all."""
        a, b = self.rows, other.rows
        if a is None:
            return other
        keys = [c for c in a.columns if c in b.columns]
        if not keys:
            raise ValueError("patterns without a shared variable would be a cross join")
        free = [k for k in keys if k in self.loose or k in other.loose]
        new = frozenset(b.columns) - frozenset(a.columns)
        loose = {"inner": (self.loose - frozenset(keys)) | other.loose - frozenset(keys) | (self.loose & other.loose), "left": self.loose | other.loose | new}.get(how, self.loose)
        if not free:
            return self._with(a.join(b, keys, how), loose)
        if len(free) == len(keys):
            raise ValueError("a variable that all solutions bind must be shared; unbound ones alone would be a cross join")
        a, b = a.alias("a"), b.alias("b")
        agree = lambda k: F.col(f"a.{k}") == F.col(f"b.{k}")
        same = reduce(Column.__and__, [agree(k) if k not in free else F.coalesce(agree(k), F.lit(True)) for k in keys])
        rows = a.join(b, same, how)
        if how in ("left_semi", "left_anti"):
            return self._with(rows)
        merged = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) if c in keys else F.col(f"a.{c}") for c in self.rows.columns]
        return self._with(rows.select(*merged, *[F.col(f"b.{c}") for c in other.rows.columns if c not in keys]), loose)

    def _group(self, patterns) -> Pattern:
        return reduce(lambda acc, t: acc.where(*t), patterns, Pattern(self.triples))

    def where(self, s: str, p: str, o: str) -> Pattern:
        return self._joined(Pattern(self.triples, match(self.triples, s, p, o)), "inner")

    def join(self, other: Pattern) -> Pattern:
        """Join with another pattern, such as a sub-select."""
        return self._joined(other, "inner")

    def optional(self, *patterns: tuple[str, str, str]) -> Pattern:
        """Left join with the inner join of ``patterns``."""
        return self._joined(self._group(patterns), "left")

    def minus(self, *patterns: tuple[str, str, str]) -> Pattern:
        return self._joined(self._group(patterns), "left_anti")

    def exists(self, *patterns: tuple[str, str, str]) -> Pattern:
        return self._joined(self._group(patterns), "left_semi")

    def union(self, other: Pattern) -> Pattern:
        rows = self.rows.unionByName(other.rows, allowMissingColumns=True)
        return self._with(rows, self.loose | other.loose | (frozenset(self.rows.columns) ^ frozenset(other.rows.columns)))

    def values(self, variable: str, constants: list[str]) -> Pattern:
        return self._with(self.rows.where(F.col(variable).isin(constants)))

    def filter(self, condition: Column | str) -> Pattern:
        return self._with(self.rows.where(condition))

    def bind(self, variable: str, value: Column) -> Pattern:
        return self._with(self.rows.withColumn(variable, value), self.loose | {variable})

    def path(self, s: str, steps: str, o: str, depth: int | None = None) -> Pattern:
        """A property path: ``a/b``, ``^a``, ``a|b``, ``a+``, ``a*`` or ``a?``."""
        return self._joined(Pattern(self.triples, path(self.triples, steps, depth).select(F.col("s").alias(s[1:]), F.col("o").alias(o[1:]))), "inner")

    def group(self, *by: str, **aggregates: Column) -> Pattern:
        """One solution for each group; ``filter`` behind it is HAVING, and it may be joined as a sub-select."""
        named = [c.alias(name) for name, c in aggregates.items()]
        return self._with(self.rows.groupBy(*by).agg(*named), self.loose | frozenset(aggregates))

    def order(self, *keys: str | Column) -> Pattern:
        """Unbound values come first, as Spark orders nulls."""
        return self._with(self.rows.orderBy(*keys))

    def slice(self, limit: int | None = None, offset: int = 0) -> Pattern:
        rows = self.rows.offset(offset) if offset else self.rows
        return self._with(rows if limit is None else rows.limit(limit))

    def project(self, *names: str, distinct: bool = False) -> Pattern:
        rows = self.rows.select(*names)
        return self._with(rows.distinct() if distinct else rows)

    def select(self, *names: str, distinct: bool = False) -> DataFrame:
        return self.project(*names, distinct=distinct).rows

    def ask(self) -> bool:
        return not self.rows.isEmpty()

    def construct(self, s: Column, p: Column, o: Column) -> DataFrame:
        return self.rows.select(s.alias("s"), p.alias("p"), o.alias("o")).dropna().distinct()


def path(triples: DataFrame, steps: str, depth: int | None = None) -> DataFrame:
    """Distinct (s, o) of a property path; for ``depth`` see ``closure``."""
    if "|" in steps:
        return reduce(DataFrame.unionByName, (path(triples, x, depth) for x in steps.split("|"))).distinct()
    if "/" in steps:
        first, rest = steps.split("/", 1)
        a, b = path(triples, first, depth), path(triples, rest, depth)
        return a.withColumnRenamed("o", "m").join(b.withColumnRenamed("s", "m"), "m").select("s", "o").distinct()
    if steps.startswith("^"):
        return path(triples, steps[1:], depth).select(F.col("o").alias("s"), F.col("s").alias("o"))
    if steps[-1] in "+*?":
        once = path(triples, steps[:-1], depth)
        zero = once.select("s").unionByName(once.select(F.col("o").alias("s"))).distinct().select("s", F.col("s").alias("o"))
        if steps[-1] == "?":
            return zero.unionByName(once).distinct()
        return closure(once, depth) if steps[-1] == "+" else zero.unionByName(closure(once, depth)).distinct()
    return triples.where(F.col("p") == steps).select("s", "o").distinct()


def closure(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """Transitive closure of (s, o) by doubling: about log2(longest path) joins, each cut into the checkpoint folder.

    Paths that take more doublings than ``depth`` steps need raise an error.
    """
    from ruleweave.operators.graph import cut

    now = cut(edges.select("s", "o").distinct())
    n, rounds = now.count(), 0
    while True:
        longer = now.withColumnRenamed("o", "m").join(now.select(F.col("s").alias("m"), "o"), "m").select("s", "o")
        now = cut(now.unionByName(longer).distinct())
        before, n, rounds = n, now.count(), rounds + 1
        if n == before:
            return now
        if depth is not None and rounds > max(1, depth).bit_length():
            raise ValueError(f"the closure has paths of more than {depth} steps")
