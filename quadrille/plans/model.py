"""Query model: variables, constants, patterns and queries, their text form and their JSON-ready form."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str  # without the question mark

    def __str__(self) -> str:
        return f"?{self.name}"


@dataclass(frozen=True)
class Const:
    """One constant, or several of which any may match."""

    terms: tuple[str, ...]

    def __post_init__(self):
        if not self.terms:
            raise ValueError("a constant position needs at least one term")

    def __str__(self) -> str:
        return self.terms[0] if len(self.terms) == 1 else "{" + ", ".join(self.terms) + "}"


Position = Var | Const


def position(x: str | Position | list[str] | tuple[str, ...]) -> Position:
    """'?x' is a variable, other text one constant, a list a disjunction of constants."""
    if isinstance(x, (Var, Const)):
        return x
    if isinstance(x, str):
        return Var(x[1:]) if x.startswith("?") else Const((x,))
    if any(str(t).startswith("?") for t in x):
        raise ValueError("a variable cannot be a member of a disjunction")
    return Const(tuple(dict.fromkeys(x)))


@dataclass(frozen=True)
class Pattern:
    s: Position
    p: Position
    o: Position

    @classmethod
    def of(cls, s, p, o) -> Pattern:
        return cls(position(s), position(p), position(o))

    @property
    def positions(self) -> tuple[tuple[str, Position], ...]:
        return (("s", self.s), ("p", self.p), ("o", self.o))

    @property
    def variables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(x.name for _, x in self.positions if isinstance(x, Var)))

    @property
    def disjunctive(self) -> bool:
        return any(isinstance(x, Const) and len(x.terms) > 1 for _, x in self.positions)

    def __str__(self) -> str:
        return f"{self.s} {self.p} {self.o}"


@dataclass
class Query:
    """head: variables to return, in order; body: patterns that must hold together."""

    head: list[str] = field(default_factory=list)
    body: list[Pattern] = field(default_factory=list)

    def add_to_head(self, v: str | Var) -> Query:
        v = position(v)
        if not isinstance(v, Var):
            raise ValueError("only variables can be returned")
        self.head.append(v.name)
        return self

    def add_to_body(self, s, p, o) -> Query:
        self.body.append(Pattern.of(s, p, o))
        return self

    def pattern(self, i: int) -> Pattern:
        if not 0 <= i < len(self.body):
            raise IndexError(f"no pattern {i} in a body of {len(self.body)}")
        return self.body[i]

    def replace(self, old: Pattern, new: Pattern) -> int:
        """Replace all patterns equal to old; the number replaced, -1 if there is none."""
        n = self.body.count(old)
        self.body = [new if x == old else x for x in self.body]
        return n or -1

    def copy(self) -> Query:
        return Query(list(self.head), list(self.body))

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for p in self.body for v in p.variables))

    @property
    def predicates(self) -> set[str] | None:
        """The constant predicates of the body; None if some predicate is a variable, so any may match."""
        ps = [p.p for p in self.body]
        return None if any(isinstance(x, Var) for x in ps) else {t for x in ps for t in x.terms}

    def check(self) -> None:
        missing = [v for v in self.head if v not in self.variables]
        if missing:
            raise ValueError(f"head variables that no pattern binds: {missing}")

    def __str__(self) -> str:
        return "SELECT " + " ".join(f"?{v}" for v in self.head) + " WHERE {\n" + "".join(f"\t{p} .\n" for p in self.body) + "}\n"

    def to_dict(self) -> dict:
        side = lambda x: f"?{x.name}" if isinstance(x, Var) else list(x.terms)
        return {"head": list(self.head), "body": [[side(x) for _, x in p.positions] for p in self.body]}

    @classmethod
    def from_dict(cls, d: dict) -> Query:
        return cls(list(d["head"]), [Pattern.of(*p) for p in d["body"]])


@dataclass
class Request:
    """A query with what its client goes by; JSON takes the place of a wire format."""

    query: Query
    number: int = 0
    client: str = ""
    sent: float = 0.0

    def to_json(self) -> str:
        return json.dumps({"query": self.query.to_dict(), "number": self.number, "client": self.client, "sent": self.sent})

    @classmethod
    def from_json(cls, text: str) -> Request:
        d = json.loads(text)
        return cls(Query.from_dict(d["query"]), d["number"], d["client"], d["sent"])


_TOKEN = re.compile(r'\{[^{}]*\}|"(?:[^"\\]|\\.)*"\S*|<[^>]*>|[^\s{}]+')


def parse_pattern(text: str) -> Pattern:
    tokens = _TOKEN.findall(text)
    if len(tokens) == 4 and tokens[3] == ".":
        tokens = tokens[:3]
    if len(tokens) != 3:
        raise ValueError(f"a pattern has three terms: {text!r}")
    return Pattern.of(*[[y.strip() for y in x[1:-1].split(",")] if x.startswith("{") else x for x in tokens])


def parse_queries(text: str) -> list[Query]:
    """All `SELECT ?a ?b WHERE { s p o . ... }` blocks of a text; white space is free, braces inside a body are disjunctions."""
    out = []
    for m in re.finditer(r"SELECT\s+((?:\?\S+\s*)*?)WHERE\s*\{((?:[^{}]|\{[^{}]*\})*)\}", text, re.IGNORECASE):
        q = Query([v[1:] for v in m[1].split()])
        tokens = _TOKEN.findall(m[2])
        now: list[str] = []
        for t in [*tokens, "."]:
            if t == ".":
                if now:
                    q.body.append(parse_pattern(" ".join(now)))
                now = []
            else:
                now.append(t)
        q.check()
        out.append(q)
    return out


def parse(text: str) -> Query:
    found = parse_queries(text)
    if len(found) != 1:
        raise ValueError(f"{len(found)} queries in the text")
    return found[0]


def q(head: str, body: str) -> Query:
    """Short form: q("?x ?y", "?x p ?y . ?y {a, b} c")."""
    return parse(f"SELECT {head} WHERE {{ {body} }}")
