"""Paths: an immutable stack of steps, lowered to one Catalyst plan.

The state while lowering is a bag of rows (id, tags ...). Until a step needs rows, "all nodes" and fixed nodes stay symbolic, so
that V().out(p) is a filtered scan and V(x).out(p) a filtered scan with s = x pushed down; nothing is joined with the node dictionary
needlessly. Sub-paths run forward with the row they start from in a hidden column, never reversed over all nodes.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions import filters as FF
from quadloom.functions import terms as T
from quadloom.sources import tables

MAX_DEPTH = 50
#: Recursion up to this depth is one plan; deeper is a loop over levels kept in the shared folder.
UNROLLED = 6
#: Column of the numbers of nodes of one class.
NUMBER = "_n"
#: Column of the number of paths that a row stands for, and the steps that leave it right.
PATHS = "_paths"
_COUNTABLE = {"is", "filter", "out", "in", "has"}


@dataclass(frozen=True)
class State:
    """kind: all (every node), fixed (keys), or rows (df with id and tag columns).

    family: the class of all nodes of df, if a column NUMBER says which of it each is. Joins then compare numbers instead of keys.
    """

    kind: str
    keys: tuple[str, ...] = ()
    df: DataFrame | None = None
    tags: dict[str, str] = field(default_factory=dict)  # tag -> column
    labels: tuple[str, ...] | None = None
    label_tags: tuple[str, ...] = ()
    at_tag: dict[str, tuple] = field(default_factory=dict)  # label context where a tag was set
    hidden: tuple[str, ...] = ()
    family: str | None = None

    @property
    def numbered(self) -> str | None:
        return self.family if self.df is not None and NUMBER in self.df.columns else None


class Path:
    def __init__(self, store=None, steps: tuple = ()):
        self.store, self.steps = store, steps

    def _add(self, name: str, *args) -> Path:
        return Path(self.store, (*self.steps, (name, args)))

    # Starting and composing

    def start(self, *nodes) -> Path:
        return self._add("is", tuple(map(T.key, nodes))) if nodes else self

    @staticmethod
    def morphism() -> Path:
        return Path()

    def on(self, store) -> Path:
        return Path(store, self.steps)

    def reverse(self) -> Path:
        return Path(self.store, tuple(_reversed(s) for s in reversed(self.steps)))

    def follow(self, path: Path) -> Path:
        return self._add("follow", path)

    def follow_reverse(self, path: Path) -> Path:
        return self._add("follow", path.reverse())

    def follow_recursive(self, via, depth: int = 0, depth_tags: tuple = ()) -> Path:
        """via: predicates or a path; depth -1 is without bound, 0 is 50."""
        path = via if isinstance(via, Path) else Path().out(via)
        return self._add("recursive", path, MAX_DEPTH if depth == 0 else depth, tuple(depth_tags))

    # Filters

    def is_(self, *nodes) -> Path:
        return self._add("is", tuple(map(T.key, nodes))) if nodes else self

    def filters(self, *fs) -> Path:
        return self._add("filter", fs) if fs else self

    def filter(self, op: str, value) -> Path:
        return self.filters(FF.Compare(op, value))

    def regex(self, pattern: str) -> Path:
        return self.filters(FF.Regex(pattern))

    def regex_with_refs(self, pattern: str) -> Path:
        return self.filters(FF.Regex(pattern, True))

    def like(self, pattern: str) -> Path:
        return self.filters(FF.Like(pattern))

    # Traversals; via: None or () for any predicate, terms, or one path

    def out(self, *via, tags=()) -> Path:
        return self._add("out", _via(via), tuple(tags))

    def in_(self, *via, tags=()) -> Path:
        return self._add("in", _via(via), tuple(tags))

    def both(self, *via, tags=()) -> Path:
        return self._add("both", _via(via), tuple(tags))

    def has(self, via, *nodes) -> Path:
        return self._add("has", _via((via,)), tuple(map(T.key, nodes)), False, ())

    def has_reverse(self, via, *nodes) -> Path:
        return self._add("has", _via((via,)), tuple(map(T.key, nodes)), True, ())

    def has_filter(self, via, reverse: bool, *fs) -> Path:
        return self._add("has", _via((via,)), (), reverse, fs)

    def save(self, via, tag: str) -> Path:
        return self._add("save", _via((via,)), tag, False, False)

    def save_reverse(self, via, tag: str) -> Path:
        return self._add("save", _via((via,)), tag, True, False)

    def save_optional(self, via, tag: str) -> Path:
        return self._add("save", _via((via,)), tag, False, True)

    def save_optional_reverse(self, via, tag: str) -> Path:
        return self._add("save", _via((via,)), tag, True, True)

    def labels(self) -> Path:
        return self._add("labels")

    def in_predicates(self) -> Path:
        return self._add("predicates", True)

    def out_predicates(self) -> Path:
        return self._add("predicates", False)

    def save_predicates(self, reverse: bool, tag: str) -> Path:
        return self._add("save_predicates", reverse, tag)

    def label_context(self, *labels, tags=()) -> Path:
        """Traversals after it use quads of these labels only (terms, or one path that gives them); without any, of all."""
        return self._add("label_context", _via(labels), tuple(tags))

    # Sets

    def and_(self, path: Path) -> Path:
        return self._add("and", path)

    def or_(self, path: Path) -> Path:
        return self._add("or", path)

    def except_(self, path: Path) -> Path:
        return self._add("except", path)

    def unique(self) -> Path:
        return self._add("unique")

    def optional(self, path: Path) -> Path:
        return self._add("optional", path)

    def has_path(self, path: Path) -> Path:
        return self._add("has_path", path)

    # Tags, order, pages

    def tag(self, *tags: str) -> Path:
        return self._add("tag", tags)

    def back(self, tag: str) -> Path:
        return self._add("back", tag)

    def order(self) -> Path:
        return self._add("order")

    def skip(self, n: int) -> Path:
        return self._add("skip", n) if n > 0 else self

    def limit(self, n: int) -> Path:
        return self._add("limit", n) if n > 0 else self

    def count(self) -> Path:
        return self._add("count")

    # Results

    def state(self) -> tuple[State, Lowering]:
        if self.store is None:
            raise ValueError("a morphism has no store; use on(store)")
        low = Lowering(self.store)
        return low.run(self.steps, State("all")), low

    def to_df(self, tags: bool = True) -> DataFrame:
        """id and a column per tag: canonical keys, one row per path."""
        state, low = self.state()
        state = low.rows(state)
        return state.df.select("id", *(F.col(c).alias(t) for t, c in state.tags.items() if tags and t != "id"))

    def ids(self) -> DataFrame:
        return self.to_df(False)

    def counted(self) -> DataFrame:
        """id and n: each end node once, with the number of paths that end there. Paths are added up node by node after every step, not
        listed, where the steps allow it."""
        if self.store is None:
            raise ValueError("a morphism has no store; use on(store)")
        if not self.steps or any(name not in _COUNTABLE or name in ("out", "in") and args[1] for name, args in self.steps):
            return self.ids().groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        low, state = Lowering(self.store), State("all")
        for step in self.steps:
            state = low.run((step,), state)
            if step[0] in ("out", "in", "has"):
                state = low.added_up(state)
        return low.added_up(low.rows(state)).df.select("id", F.col(PATHS).alias("n"))

    def to_list(self, limit: int = -1) -> list:
        """Terms of the end nodes, on the driver."""
        df = self.ids() if limit < 0 else self.ids().limit(limit)
        return [T.parse(r["id"]) for r in df.toLocalIterator()]

    def first(self):
        row = self.ids().first()
        return None if row is None else T.parse(row["id"])

    def tag_list(self, limit: int = -1) -> list[dict]:
        df = self.to_df() if limit < 0 else self.to_df().limit(limit)
        return [{k: T.parse(v) for k, v in r.asDict().items() if v is not None} for r in df.toLocalIterator()]

    def size(self) -> int:
        return self.ids().count()

    def morphism_steps(self) -> tuple:
        return self.steps


def _via(via):
    """None for any predicate, a Path, or keys."""
    via = tuple(x for v in via for x in (v if isinstance(v, (list, tuple, set)) else (v,)) if x is not None)
    if any(isinstance(v, Path) for v in via):
        if len(via) > 1:
            raise ValueError("a path can't be mixed with other predicates")
        return via[0]
    return tuple(map(T.key, via)) or None


def _by(a: State, b: State) -> str:
    """The column that tells the nodes of both apart."""
    return NUMBER if a.numbered and a.numbered == b.numbered else "id"


def _reversed(step):
    name, args = step
    if name in ("out", "in"):
        return ("in" if name == "out" else "out", args)
    if name == "follow":
        return ("follow", (args[0].reverse(),))
    if name in ("labels", "predicates", "save_predicates", "count", "order", "skip", "limit", "recursive"):
        raise ValueError(f"{name} has no reverse")
    return step


class Lowering:
    def __init__(self, store):
        self.store, self.quads, self.spark, self.n = store, store.quads, store.spark, 0

    def name(self) -> str:
        self.n += 1
        return f"_c{self.n}"

    def run(self, steps, state: State) -> State:
        for k, (name, args) in enumerate(steps):
            if name == "back" and args[0] not in state.tags and not state.hidden:
                # no such tag: the path so far, the other way round
                state = self.run(Path(None, tuple(steps[:k])).reverse().steps, State("all"))
            else:
                state = getattr(self, "do_" + name)(state, *args)
        return state

    def sub(self, path: Path, state: State | None = None) -> State:
        """A sub-path of its own, with the label context it starts with."""
        low = self if path.store in (None, self.store) else Lowering(path.store)
        out = low.run(path.steps, state or State("all"))
        self.n = max(self.n, low.n)
        return out

    def rows(self, state: State) -> State:
        if state.kind == "rows":
            return state
        if state.kind == "all":
            df = self.store.ids()
        else:
            wanted = self.spark.createDataFrame([(k,) for k in state.keys], "id string")
            df = wanted.join(self.store.existing(state.keys), "id", "left_semi") if state.keys else wanted
        return replace(state, kind="rows", df=df.select("id", *(F.col("id").alias(c) for c in state.tags.values())), keys=())

    def columns(self, state: State) -> list[str]:
        return [*dict.fromkeys(state.tags.values()), *state.hidden]

    def added_up(self, state: State) -> State:
        """One row a node, with the number of its rows so far in a hidden column; for states without tags."""
        by, n = _by(state, state), F.sum(PATHS) if PATHS in state.hidden else F.count(F.lit(1))
        ids = [tables.node(state.family, NUMBER).alias("id"), NUMBER] if by == NUMBER else ["id"]
        return replace(state, df=state.df.groupBy(by).agg(n.alias(PATHS)).select(*ids, PATHS), hidden=(PATHS,))

    # Scans

    def edges(self, state: State, via, wanted: dict, context: bool, at: str | None = None) -> tuple[DataFrame, dict[str, str], bool]:
        """Quads that a traversal may use, classes of their nodes by direction, and whether rows' numbers can be joined with direction `at`."""
        wanted, family = dict(wanted), at and state.numbered
        if via is not None and not isinstance(via, Path):
            wanted["p"] = via
        if context and state.labels is not None:
            wanted["l"] = state.labels
        q, known, meets = None, {}, False
        if self.store.cells:
            parts = tables.restricted(self.store.cells, wanted)
            near = [p for p in parts if not p.side(at).apart(family)] if family else parts
            meets = bool(family and near) and tables.classes(near).get(at) == family
            parts = near if meets else parts
            if parts:
                known = tables.classes(parts)
                q = tables.united(parts, known)
                for d, keys in wanted.items():
                    q = q.where(F.col(d).isin(*keys))
        if q is None:
            q = self.store.scan(**wanted)
        if isinstance(via, Path):
            allowed = self.rows(self.sub(via)).df.select(F.col("id").alias("p")).distinct()
            q = q.join(allowed, "p", "left_semi")
        return q, known, meets

    def hop(self, state: State, via, reverse: bool, keep: bool, extra: dict[str, str], only: Column | None = None, optional: bool = False, context: bool = True, among: tuple[str, ...] = ()) -> State:
        """Join with quads. keep: stay at id. extra: column -> quad column to keep under that name. only: a condition on the quad (in s, p, o, l). among: keys that the other end must be of."""
        start, goal = ("o", "s") if reverse else ("s", "o")
        end = start if keep else goal
        alone = state.kind != "rows" and not optional and len(set(state.keys)) == len(state.keys)
        wanted = ({goal: among} if among else {}) | ({start: state.keys} if alone and state.kind == "fixed" else {})
        state = state if alone else self.rows(state)
        q, known, meets = self.edges(state, via, wanted, context, None if alone else start)
        label_tags = {self.name(): t for t in state.label_tags} if context else {}
        extra = extra | dict.fromkeys(label_tags, "l")
        if only is not None:
            q = q.where(only)
        tags = dict(state.tags) | {t: c for c, t in label_tags.items()}
        if alone:
            held = [F.col(start).alias(c) for c in dict.fromkeys(state.tags.values())]
            numbers = [F.col(f"{end}_n").alias(NUMBER)] if end in known else []
            df = q.select(F.col(end).alias("id"), *numbers, *held, *(F.col(x).alias(c) for c, x in extra.items()))
            return replace(state, kind="rows", df=df, keys=(), tags=tags, family=known.get(end))
        goes = not keep and goal in known and not optional  # the key is made of the number after the join
        side = q.select(
            (F.col(f"{start}_n") if meets else F.col(start)).alias("_at"), *([] if keep else [F.col(f"{goal}_n" if goes else goal).alias("_to")]),
            *(F.col(x).alias(c) for c, x in extra.items()),
        )
        df = state.df.join(side, state.df[NUMBER if meets else "id"] == side["_at"], "left" if optional else "inner")
        if goes:
            ids, family = [tables.node(known[goal], "_to").alias("id"), F.col("_to").alias(NUMBER)], known[goal]
        elif keep:
            family = state.numbered
            ids = [F.col("id"), F.col(NUMBER)] if family else [F.col("id")]
        else:
            ids, family = [F.col("_to").alias("id")], None
        return replace(state, df=df.select(*ids, *self.columns(state), *extra), tags=tags, family=family)

    # Steps

    def do_is(self, state, keys):
        if state.kind == "all":
            return replace(state, kind="fixed", keys=keys)
        if state.kind == "fixed":
            return replace(state, keys=tuple(k for k in state.keys if k in keys))
        return replace(state, df=state.df.where(F.col("id").isin(*keys)))

    def do_filter(self, state, fs):
        state = self.rows(state)
        df = state.df
        for f in fs:
            df = df.where(f.on(F.col("id")))
        return replace(state, df=df)

    def do_tag(self, state, tags):
        if state.kind == "rows":
            c = self.name()
            state = replace(state, df=state.df.withColumn(c, F.col("id")))
        else:  # every tag so far is the node itself
            c = next(iter(state.tags.values()), None) or self.name()
        return replace(state, tags=state.tags | dict.fromkeys(tags, c), at_tag=state.at_tag | dict.fromkeys(tags, (state.labels, state.label_tags)))

    def _traverse(self, state, via, tags, reverse):
        extra = {self.name(): "p"} if tags else {}
        out = self.hop(state, via, reverse, False, extra)
        return replace(out, tags=out.tags | {t: c for c in extra for t in tags})

    def do_out(self, state, via, tags):
        return self._traverse(state, via, tags, False)

    def do_in(self, state, via, tags):
        return self._traverse(state, via, tags, True)

    def do_both(self, state, via, tags):
        return self.union(self._traverse(state, via, tags, True), self._traverse(state, via, tags, False))

    def do_has(self, state, via, keys, reverse, fs):
        goal, only = F.col("s" if reverse else "o"), None
        for f in fs:
            only = f.on(goal) if only is None else only & f.on(goal)
        return self.hop(state, via, reverse, True, {}, only, among=keys)

    def do_save(self, state, via, tag, reverse, optional):
        c = self.name()
        out = self.hop(state, via, reverse, True, {c: "s" if reverse else "o"}, optional=optional)
        return replace(out, tags=out.tags | {tag: c})

    def do_labels(self, state):
        state = self.rows(state)
        ids = state.df.select("id").distinct()
        q = self.quads.where("l IS NOT NULL").select(F.explode(F.array("s", "o")).alias("id"), "l").distinct()
        return State("rows", df=q.join(ids, "id", "left_semi").select(F.col("l").alias("id")).distinct())

    def do_predicates(self, state, reverse):
        at = F.col("o" if reverse else "s")
        if state.kind == "all":
            return State("rows", df=self.quads.select(F.col("p").alias("id")).distinct())
        if state.kind == "fixed":
            return State("rows", df=self.store.scan(**{"o" if reverse else "s": state.keys}).select(F.col("p").alias("id")).distinct())
        edges = self.quads.select(at.alias("id"), "p").distinct()
        return State("rows", df=edges.join(state.df.select("id").distinct(), "id", "left_semi").select(F.col("p").alias("id")).distinct())

    def do_save_predicates(self, state, reverse, tag):
        c = self.name()
        out = self.hop(state, None, reverse, True, {c: "p"}, context=False)
        return replace(out, tags=out.tags | {tag: c})

    def do_label_context(self, state, labels, tags):
        if isinstance(labels, Path):
            # bounded by the caller: labels name graphs, and a context is a set of them
            labels = tuple(r["id"] for r in self.rows(self.sub(labels)).df.select("id").distinct().collect())
        return replace(state, labels=labels, label_tags=tags)

    def do_and(self, state, path):
        other = self.sub(path)
        if other.kind == "all" and not other.tags:
            return state
        if state.kind == "all" and not state.tags:
            return replace(other, labels=state.labels, label_tags=state.label_tags)
        if other.kind == "fixed" and not other.tags and len(set(other.keys)) == len(other.keys):
            return self.do_is(state, other.keys)
        state, other = self.rows(state), self.rows(other)
        mine = {t: c for t, c in state.tags.items() if t not in other.tags}  # a tag set on both sides is the other's
        by = _by(state, other)
        side = other.df.select(F.col(by).alias("_at"), *dict.fromkeys(other.tags.values()))
        numbers = [NUMBER] if state.numbered else []
        df = state.df.join(side, state.df[by] == side["_at"]).select("id", *numbers, *dict.fromkeys([*mine.values(), *state.hidden, *other.tags.values()]))
        return replace(state, df=df, tags=mine | other.tags)

    def union(self, a: State, b: State) -> State:
        a, b = self.rows(a), self.rows(b)
        names = {t: self.name() for t in dict.fromkeys([*a.tags, *b.tags])}
        cast = lambda s: s.df.select("id", *(F.col(s.tags[t]).alias(c) if t in s.tags else F.lit(None).cast("string").alias(c) for t, c in names.items()), *(h if h in s.df.columns else F.lit(None).cast("string").alias(h) for h in a.hidden))
        return replace(a, df=cast(a).unionByName(cast(b)), tags=names)

    def do_or(self, state, path):
        return self.union(state, self.sub(path))

    def do_except(self, state, path):
        other = self.sub(path)
        if other.kind == "all":
            state = self.rows(state)
            return replace(state, df=state.df.where(F.lit(False)))
        if other.kind == "fixed":
            state = self.rows(state)
            return replace(state, df=state.df.where(~F.col("id").isin(*other.keys)) if other.keys else state.df)
        state = self.rows(state)
        by = _by(state, other)
        return replace(state, df=state.df.join(other.df.select(by).distinct(), by, "left_anti").select(state.df.columns))

    def do_unique(self, state):
        if state.kind == "all":
            return state
        if state.kind == "fixed":
            return replace(state, keys=tuple(dict.fromkeys(state.keys)))
        cols = self.columns(state)
        by = _by(state, state)
        ids = [tables.node(state.family, NUMBER).alias("id"), NUMBER] if by == NUMBER else ["id"]
        if not cols:
            return replace(state, df=state.df.select(by).distinct().select(*ids))
        first = state.df.groupBy(by).agg(F.min(F.struct(*cols)).alias("_first"))
        return replace(state, df=first.select(*ids, *(F.col(f"_first.{c}").alias(c) for c in cols)))

    def _sub_rows(self, state: State, path: Path) -> tuple[State, str]:
        """The sub-path run forward from each row, with the row's node in a hidden column."""
        at = self.name()
        inner = State("rows", df=state.df.select("id").distinct().withColumn(at, F.col("id")), hidden=(at,))
        return self.rows(self.sub(path, inner)), at

    def do_follow(self, state, path):
        inner = self.sub(path, replace(state, labels=None, label_tags=()))
        return replace(inner, labels=state.labels, label_tags=state.label_tags)

    def do_has_path(self, state, path):
        state = self.rows(state)
        inner, at = self._sub_rows(state, path)
        mine = {t: c for t, c in state.tags.items() if t not in inner.tags}
        side = inner.df.select(F.col(at).alias("_at"), *dict.fromkeys(inner.tags.values()))
        df = state.df.join(side, state.df["id"] == side["_at"]).select("id", *dict.fromkeys([*mine.values(), *state.hidden, *inner.tags.values()]))
        return replace(state, df=df, tags=mine | inner.tags)

    def do_optional(self, state, path):
        state = self.rows(state)
        inner, at = self._sub_rows(state, path)
        mine = {t: c for t, c in state.tags.items() if t not in inner.tags}
        side = inner.df.select(F.col(at).alias("_at"), *dict.fromkeys(inner.tags.values()))
        df = state.df.join(side, state.df["id"] == side["_at"], "left").select("id", *dict.fromkeys([*mine.values(), *state.hidden, *inner.tags.values()]))
        return replace(state, df=df, tags=mine | inner.tags)

    def do_back(self, state, tag):
        if not tag or tag not in state.tags:
            raise ValueError(f"no tag {tag!r} on this path to go back to")
        state = self.rows(state)
        labels, label_tags = state.at_tag.get(tag, (None, ()))
        return replace(state, df=state.df.drop(NUMBER).withColumn("id", F.col(state.tags[tag])).where("id IS NOT NULL"), labels=labels, label_tags=label_tags)

    def do_order(self, state):
        state = self.rows(state)
        return replace(state, df=state.df.orderBy("id", *self.columns(state)))

    def do_skip(self, state, n):
        state = self.rows(state)
        return replace(state, df=state.df.offset(n))

    def do_limit(self, state, n):
        state = self.rows(state)
        return replace(state, df=state.df.limit(n))

    def do_count(self, state):
        if state.kind == "fixed":
            state = self.rows(state)
        df = self.store.ids() if state.kind == "all" else state.df
        return State("rows", df=df.agg(T.int_key(F.count("*")).alias("id")))

    def do_recursive(self, state, path, depth, depth_tags):
        from quadloom.operators.recursion import followed

        state = self.rows(state)
        tagged = self.name()
        starts = state.df.select("id").distinct()

        def step(frontier: DataFrame) -> tuple[DataFrame, dict[str, str]]:
            """(base, id, inner tags) reached from (base, id) rows."""
            base = self.name()
            inner = self.rows(self.sub(path, State("rows", df=frontier.select("id", F.col("base").alias(base)), hidden=(base,))))
            return inner.df.select(F.col(base).alias("base"), "id", *(F.col(c).alias(f"tag{k}") for k, c in enumerate(inner.tags.values()))), inner.tags

        reached, inner_tags = followed(starts, step, depth, UNROLLED)
        names = {t: self.name() for t in inner_tags}
        reached = reached.select("base", F.col("id").alias("_to"), T.int_key(F.col("depth")).alias(tagged), *(F.col(f"tag{k}").alias(c) for k, c in enumerate(names.values())))
        mine = {t: c for t, c in state.tags.items() if t not in names and t not in depth_tags}
        keep = [*dict.fromkeys(mine.values()), *state.hidden]
        df = reached.join(state.df.select(F.col("id").alias("base"), *keep), "base") if keep else reached.join(state.df.select(F.col("id").alias("base")).distinct(), "base", "left_semi")
        df = df.select(F.col("_to").alias("id"), *keep, tagged, *names.values())
        return replace(state, df=df, tags=mine | names | dict.fromkeys(depth_tags, tagged))
