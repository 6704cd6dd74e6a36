"""S-expressions: (node (predicate object) ...).

    ($a (:like ($b (:is :good))) (!:knows "bob") (:status optional $s))

$x is a variable and a tag of that name; :x and "x" are values; ! goes against the predicate; a predicate may itself be a constraint
whose nodes are the predicates. Optional constraints only add tags.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from quadloom.functions import terms as T
from quadloom.plans.path import Path

_TOKEN = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|(?P<str>"[^"]*")|(?P<word>[!$:]*[\w./:#<>-]+)|(?P<bang>!))')


class SexpError(ValueError):
    pass


def _tree(text: str):
    if text.count("(") != text.count(")"):
        raise SexpError("parentheses don't match")
    stack, at, text = [[]], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise SexpError(f"unexpected {text[at : at + 20]!r}")
        at = m.end()
        if m["open"]:
            stack.append([])
        elif m["close"]:
            if len(stack) < 2:
                raise SexpError("parentheses don't match")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(m[m.lastgroup])
    if len(stack) != 1 or len(stack[0]) != 1 or not isinstance(stack[0][0], list):
        raise SexpError("one expression is asked for")
    return stack[0][0]


def _value(word: str):
    return T.text_term(word[1:] if word.startswith(":") else word[1:-1] if word.startswith('"') else word)


def _node(path: Path, node) -> Path:
    """path, constrained to what a node expression says."""
    if isinstance(node, list):
        return _constrained(path, node)
    return path.tag(node) if node.startswith("$") else path.is_(_value(node))


def _constrained(path: Path, tree: list) -> Path:
    if not tree:
        raise SexpError("an empty expression has no node")
    path = _node(path, tree[0])
    for c in tree[1:]:
        if not isinstance(c, list):
            raise SexpError(f"a constraint is asked for, not {c!r}")
        c = list(c)
        back = isinstance(c[0], str) and c[0].startswith("!")
        if back:
            c[0] = c[0][1:]
            if not c[0]:
                c.pop(0)
        via, rest = c[0], c[1:]
        optional = bool(rest) and rest[0] == "optional"
        rest = rest[optional:]
        if len(rest) != 1:
            raise SexpError("a constraint is a predicate and an object")
        tags, predicates = (), ()
        if isinstance(via, list):
            predicates = (_constrained(Path(), via),)
        elif via.startswith("$"):
            tags = (via,)
        else:
            predicates = (_value(via),)
        sub = Path().in_(*predicates, tags=tags) if back else Path().out(*predicates, tags=tags)
        sub = _node(sub, rest[0])
        path = path.optional(sub) if optional else path.has_path(sub)
    return path


def parse(text: str) -> Path | None:
    """An unbound path; None for (), which matches nothing."""
    tree = _tree(text)
    return _constrained(Path(), tree) if tree else None


def frame(store, text: str) -> DataFrame:
    """id and a column per variable, dollar sign included."""
    path = parse(text)
    if path is None:
        return store.quads.select("s").where("false").withColumnRenamed("s", "id")
    return path.on(store).to_df()


def execute(store, text: str, limit: int = -1) -> list[dict]:
    df = frame(store, text)
    return [{k: T.parse(v) for k, v in r.asDict().items() if v is not None} for r in (df if limit < 0 else df.limit(limit)).toLocalIterator()]
