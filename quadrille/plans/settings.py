"""Settings: files of `name = value` with strings, numbers, truth values, lists in ( ) or [ ] and groups in { }; host and file lists."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from quadrille.operators.placement import Config

_TOKEN = re.compile(r'\s+|//[^\n]*|#[^\n]*|/\*.*?\*/|("(?:[^"\\]|\\.)*"|[=:;,(){}\[\]]|[^\s=:;,(){}\[\]"]+)', re.DOTALL)

# The shipped workload settings.  Bank, patterns by their number in it, percentages of each workload, queries in each.
WORKLOAD = {"bank": "lubm", "pattern": [1, 6, 7, 8, 11], "frequency": [[100, 0, 0, 0, 0], [0, 100, 0, 0, 0], [0, 0, 100, 0, 0], [0, 0, 0, 100, 0], [0, 0, 0, 0, 100]], "queries": [10, 10, 10, 10, 10]}
#: Names in a settings file of the fields of Config.
FIELDS = {"enable_reassign": "ENABLE_REASSIGN", "trigger_k": "TRIGGER_K", "trigger_double": "TRIGGER_DOUBLE", "gamma": "GAMA", "beta": "BETA", "log_limit": "EDGELOG_LEN"}


def parse_settings(text: str) -> dict:
    tokens, at = [m[1] for m in _TOKEN.finditer(text) if m[1]], 0

    def take(what: str | None = None) -> str:
        nonlocal at
        if at == len(tokens) or what not in (None, tokens[at]):
            raise ValueError(f"{what or 'a value'} expected, not {tokens[at] if at < len(tokens) else 'the end'}")
        at += 1
        return tokens[at - 1]

    def value():
        t = take()
        if t == "{":
            return group("}")
        if t in "([":
            end, out = ")" if t == "(" else "]", []
            while tokens[at : at + 1] != [end]:
                out.append(value())
                if tokens[at : at + 1] != [end]:
                    take(",")
            take(end)
            return out
        if t.startswith('"'):
            return re.sub(r"\\(.)", r"\1", t[1:-1])
        if t.lower() in ("true", "false"):
            return t.lower() == "true"
        try:
            return int(t)
        except ValueError:
            return float(t)

    def group(end: str | None) -> dict:
        out = {}
        while at < len(tokens) and tokens[at] != end:
            name = take()
            if take() not in "=:":
                raise ValueError(f"no value for {name!r}")
            out[name] = value()
            while tokens[at : at + 1] in ([";"], [","]):
                take()
        if end:
            take(end)
        return out

    return group(None)


@dataclass(frozen=True)
class Host:
    address: str
    port: int
    socket: str


def read_hosts(path: str | Path) -> list[Host]:
    """Lines `address port socket`."""
    rows = [line.split() for line in Path(path).read_text().splitlines() if line.strip()]
    return [Host(a, int(p), s) for a, p, s in rows]


def read_list(path: str | Path) -> list[str]:
    """Names of data or dictionary files, parted by white space."""
    return Path(path).read_text().split()


def config(settings: dict, servers: int) -> Config:
    """Placement settings of a file's values; what it leaves out has its usual value."""
    return Config(servers=servers, **{k: settings[name] for k, name in FIELDS.items() if name in settings})


def workloads(settings: dict) -> dict:
    """A workload file's bank, patterns, percentages and numbers of queries, checked."""
    own = settings["workload_setting"]
    out = {"bank": settings["data_set_type"], "pattern": own["pattern"], "frequency": own["pattern_frequency"], "queries": own["num_query_per_workload"]}
    n = settings.get("num_workloads", len(out["queries"]))
    if not len(out["frequency"]) == len(out["queries"]) == n or any(len(x) != len(out["pattern"]) for x in out["frequency"]):
        raise ValueError("a workload needs a percentage for each pattern, and each workload a number of queries")
    return out
