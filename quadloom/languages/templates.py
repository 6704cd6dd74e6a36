"""JSON templates: query by example.

    [{"id": null, "<status>": "cool_person", "!<follows>": [{"id": null}]}]

null asks for one value if there is any, [] for all; constants and objects constrain. !p goes against the predicate, @x:p tells two
uses of a predicate apart. Where several objects stand behind a field that isn't a list, the last by key is shown.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from quadloom.functions import terms as T
from quadloom.languages.objects import Field, level


class TemplateError(ValueError):
    pass


def _constant(v):
    if isinstance(v, bool):
        return T.key(v)
    if isinstance(v, (int, float)):
        return T.key(int(v) if float(v).is_integer() else v)
    return T.key(T.text_term(v))


def _field(name: str, v) -> Field:
    via = name
    if via.startswith("@") and ":" in via:
        via = via.partition(":")[2]
    reverse = via.startswith("!")
    f = Field(name, T.key(T.text_term(via.lstrip("!"))), reverse)
    if isinstance(v, list):
        if len(v) > 1:
            raise TemplateError("a list in a template has one element at most")
        f.repeated = True
        v = v[0] if v else None
    if v is None:
        f.optional = True
    elif isinstance(v, dict):
        f.fields, f.filters = _fields(f, v), True
    else:
        f.only = (_constant(v),)
    return f


def _fields(holder: Field, template: dict) -> list[Field]:
    out = []
    for name, v in template.items():
        if name == "id":
            holder_ids = v[0] if isinstance(v, list) and v else v
            if isinstance(holder_ids, dict):
                raise TemplateError("id is a value")
            if holder_ids is not None and holder_ids != []:
                holder.ids = (_constant(holder_ids),)
            out.append(Field("id"))
        else:
            out.append(_field(name, v))
    return out


def parse(query) -> Field:
    """The tree of a template (text, or parsed JSON)."""
    q = json.loads(query) if isinstance(query, (str, bytes)) else query
    if isinstance(q, list):
        if len(q) != 1:
            raise TemplateError("a list in a template has one element")
        q = q[0]
    if not isinstance(q, dict):
        raise TemplateError("a template is an object")
    root = Field("")
    root.fields = _fields(root, q)
    return root


def frame(store, query, limit: int = -1) -> DataFrame:
    """The plan: id, and f0, f1 ... in the order of the template's keys."""
    root = parse(query)
    root.limit = limit
    return level(store, root, None)


def _text(key: str) -> str:
    term = T.parse(key)
    return str(term).lower() if isinstance(term, bool) else str(term) if isinstance(term, (str, int, float)) else key


def _object(f: Field, row) -> dict:
    out = {}
    for k, x in enumerate(f.fields):
        got = row[f"f{k}"] or []
        values = [_object(x, r) for r in got] if x.fields is not None else [_text(v) for v in got]
        out[x.name] = values if x.repeated else values[-1] if values else None
    return out


def execute(store, query, limit: int = -1) -> list[dict]:
    """One object per node, ordered by node; all values as text."""
    root = parse(query)
    root.limit = limit
    return [_object(root, r) for r in level(store, root, None).orderBy("id").toLocalIterator()]
