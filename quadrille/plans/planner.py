"""Basic graph patterns as Spark plans.

Each pattern is one filtered, pruned scan of triples(s, p, o); patterns join on shared variables.  Order is greedy: the most selective
pattern first, then always one that is connected to what is bound, so no cartesian product arises unless the query itself is
disconnected.  Spark picks the join strategy; AQE re-plans at run time.  With the triples written by ``sources.triples.write`` a
constant predicate prunes partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.plans.model import Const, Pattern, Query, Var
from quadrille.sources.triples import stored

Source = DataFrame | Callable[[Pattern], DataFrame]


def match(triples: DataFrame, pattern: Pattern) -> DataFrame:
    """Bindings of one pattern's variables.  Where a constant set stands in a position, a binding appears once however many of its
    members match; a variable that stands twice must have one value."""
    out, seen = triples, {}
    for column, x in pattern.positions:
        if isinstance(x, Const):
            c = F.col(column)
            out = out.where(c == x.terms[0] if len(x.terms) == 1 else c.isin(*x.terms))
        elif x.name in seen:
            out = out.where(F.col(column) == F.col(seen[x.name]))
        else:
            seen[x.name] = column
    out = out.select(*[F.col(c).alias(v) for v, c in seen.items()])
    if not seen:
        return out.limit(1).select()  # a fact that holds or not
    return out.distinct() if pattern.disjunctive else out


def fan_out(pattern: Pattern, stats: dict[str, tuple[int, int, int]] | None, bound: set[str]) -> float:
    """Estimated rows of a pattern for one binding of the variables that are bound: what a join with it multiplies rows by."""
    base = weight(pattern, stats)
    at = [i for i, x in ((1, pattern.s), (2, pattern.o)) if isinstance(x, Var) and x.name in bound]
    if stats and isinstance(pattern.p, Const):
        for i in at:
            base /= max(1, sum(stats.get(p, (0, 1, 1))[i] for p in pattern.p.terms))
        return base
    return base / 10 ** (2 * len(bound & set(pattern.variables)))


def weight(pattern: Pattern, stats: dict[str, tuple[int, int, int]] | None) -> float:
    """Estimated rows of a pattern; stats: predicate -> (triples, distinct subjects, distinct objects)."""
    bound_s, bound_o = isinstance(pattern.s, Const), isinstance(pattern.o, Const)
    if stats and isinstance(pattern.p, Const):
        rows = 0.0
        for p in pattern.p.terms:
            n, s, o = stats.get(p, (0, 1, 1))
            rows += n / (max(s, 1) / len(pattern.s.terms) if bound_s else 1) / (max(o, 1) / len(pattern.o.terms) if bound_o else 1)
        return rows
    return 1e12 / (1e6 if bound_s else 1) / (1e4 if bound_o else 1) / (1e2 if isinstance(pattern.p, Const) else 1)


def order(body: list[Pattern], stats: dict | None = None, given: set[str] = frozenset()) -> list[Pattern]:
    """Greedy connected order: selective first, ties by place in the text; given variables are bound already."""
    left, out, bound = list(enumerate(body)), [], set(given)
    while left:
        near = [x for x in left if not (out or given) or bound & set(x[1].variables) or not x[1].variables] or left
        best = min(near, key=lambda x: (fan_out(x[1], stats, bound), x[0]))
        left.remove(best)
        out.append(best[1])
        bound |= set(best[1].variables)
    return out


def _scan(triples: Source, pattern: Pattern) -> DataFrame:
    return triples(pattern) if callable(triples) else triples


def candidates(triples: Source, pattern: Pattern, variable: str) -> DataFrame:
    """Distinct values of a variable that one pattern allows."""
    return match(_scan(triples, pattern), pattern).select(variable).distinct()


def star(triples: Source, patterns: list[Pattern], variable: str, stats: dict | None = None) -> DataFrame:
    """Values of a variable that all these patterns allow: the smallest estimated candidate set first, the others by semi-join."""
    ranked = sorted(patterns, key=lambda p: weight(p, stats))
    return reduce(lambda x, p: x.join(match(_scan(triples, p), p).select(variable), variable, "left_semi"), ranked[1:], candidates(triples, ranked[0], variable))


def solve(triples: Source, query: Query, stats: dict | None = None, distinct: bool = False, given: DataFrame | None = None) -> DataFrame:
    """All solutions projected on the head, as a bag (or a set).  triples: a frame, or a function from a pattern to the frame to scan for
    it, which lets a view or a store prune.  An empty body has one empty solution.  given: bindings of some
    variables, a row for each; solutions are those that agree with one."""
    query.check()
    plan = order(query.body, stats, set(given.columns) if given is not None else set())
    if not plan:
        return SparkSession.active().range(1).select()
    needed, out = set(query.head), given
    for i, p in enumerate(plan):
        one = match(_scan(triples, p), p)
        if out is None:
            out = one
            continue
        shared = [v for v in p.variables if v in out.columns]
        later = needed | {v for x in plan[i + 1 :] for v in x.variables}
        if not shared:
            out = out.crossJoin(one)  # the query itself has unconnected parts
        elif set(p.variables) == set(shared):  # triples are a set, so a pattern gives each binding once
            out = out.join(one, shared, "left_semi")
        else:
            out = out.join(one, shared)
        out = out.select(*[v for v in out.columns if v in later])
    out = out.select(*query.head)
    return out.distinct() if distinct else out


def reduce_semi(triples: Source, query: Query) -> list[DataFrame]:
    """For each pattern the bindings that survive semi-joins along a tree of the body: children prune their parents from the leaves
    up, then parents prune their children from the root down.  2 (n - 1) semi-joins; exact on acyclic bodies, elsewhere a
    sound pre-filter."""
    plan, parent, seen = [match(_scan(triples, p), p) for p in query.body], {}, []
    for p in order(query.body):
        i = next(k for k, x in enumerate(query.body) if x is p)
        shared = {k: [v for v in p.variables if v in query.body[k].variables] for k in seen}
        near = max(shared, key=lambda k: len(shared[k]), default=None)
        if near is not None and shared[near]:
            parent[i] = (near, shared[near])
        seen.append(i)
    for i in reversed(seen):
        if i in parent:
            up, on = parent[i]
            plan[up] = plan[up].join(plan[i].select(*on), on, "left_semi")
    for i in seen:
        if i in parent:
            up, on = parent[i]
            plan[i] = plan[i].join(plan[up].select(*on), on, "left_semi")
    return plan


def _whole(triples: Source, query: Query, stats: dict | None) -> DataFrame:
    """All solutions with all variables, stored: the parts of a factorised result are read from them."""
    return stored(solve(triples, Query(query.variables, query.body), stats), "solutions")


def bindings(triples: Source, query: Query, stats: dict | None = None) -> dict[str, DataFrame]:
    """Factorised result: the values of each variable that occur in some solution."""
    full = _whole(triples, query, stats)
    return {v: full.select(v).distinct() for v in query.variables}


def edges(triples: Source, query: Query, stats: dict | None = None) -> list[DataFrame]:
    """Factorised result: for each pattern its triples that take part in some solution."""
    full, out = _whole(triples, query, stats), []
    for p in query.body:
        part = full.select(*p.variables).distinct() if p.variables else None
        cols = [F.col(x.name).alias(c) if isinstance(x, Var) else F.lit(x.terms[0]).alias(c) if len(x.terms) == 1 else None for c, x in p.positions]
        if part is not None and all(c is not None for c in cols):
            out.append(part.select(*cols))
        else:
            named = [F.col(c).alias(x.name) for c, x in p.positions if isinstance(x, Var)]
            rows = reduce(lambda d, cx: d.where(F.col(cx[0]).isin(*cx[1].terms)) if isinstance(cx[1], Const) else d, p.positions, _scan(triples, p))
            rows = rows.select("s", "p", "o", *named)
            out.append((rows.join(part, list(p.variables), "left_semi") if part is not None else rows).select("s", "p", "o"))
    return out


def to_sql(query: Query, source: str | Callable[[Pattern], str] = "triples", stats: dict | None = None) -> str:
    """The same query as ANSI SQL: one relation for each pattern, joined on shared variables in the planned order.  source: the name of
    a relation of triples, or a function from a pattern to a query of the triples that it can match."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    parts, at, out = [], {}, ""
    for i, p in enumerate(order(query.body, stats)):
        cols, cond, own = [], [], {}
        for c, x in p.positions:
            if isinstance(x, Const):
                cond.append(f"{c} IN ({', '.join(map(quote, x.terms))})")
            elif x.name in own:
                cond.append(f"{c} = {own[x.name]}")
            else:
                own[x.name] = c
                cols.append(f'{c} AS "{x.name}"')
        rows = source if isinstance(source, str) else f"({source(p)}) AS triples"
        parts.append(f"t{i} AS (SELECT {'DISTINCT ' * p.disjunctive}{', '.join(cols) or '1 AS one'} FROM {rows}{' WHERE ' + ' AND '.join(cond) if cond else ''})")
        on = [f'{at[v]} = t{i}."{v}"' for v in p.variables if v in at]
        out += f"t{i}" if not i else f" JOIN t{i} ON {' AND '.join(on)}" if on else f" CROSS JOIN t{i}"
        for v in p.variables:
            at.setdefault(v, f't{i}."{v}"')
    heads = ", ".join(f'{at[v]} AS "{v}"' for v in query.head)
    return f"WITH {', '.join(parts)} SELECT {heads} FROM {out}"
