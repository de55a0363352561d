"""Control flow graphs and dataflow per function: reachability, components, dominators, a worklist solver.

Graphs are small, one per function, so that each is solved whole inside a grouped worker. All walks
are iterative: nesting and depth don't matter.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.python_checks import children

#: Rows of one record batch, about.
_ROWS = 50_000


@dataclass
class Graph:
    """Blocks 0 to n - 1, edges without repeats, entry 0."""

    n: int
    edges: set[tuple[int, int]]
    succ: list[list[int]] = field(init=False)
    pred: list[list[int]] = field(init=False)

    def __post_init__(self):
        self.succ, self.pred = ([[] for _ in range(self.n)] for _ in range(2))
        for a, b in sorted(self.edges):
            self.succ[a].append(b)
            self.pred[b].append(a)


def reachable(g: Graph, start: int = 0) -> set[int]:
    seen, todo = {start} if g.n else set(), deque([start] if g.n else [])
    while todo:
        for b in g.succ[todo.popleft()]:
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def pruned(g: Graph) -> tuple[Graph, list[int]]:
    """The reachable part with compact numbers, and the old number of each block."""
    old = sorted(reachable(g))
    new = {b: i for i, b in enumerate(old)}
    return Graph(len(old), {(new[a], new[b]) for a, b in g.edges if a in new and b in new}), old


def finishing_order(g: Graph, start: int) -> list[int]:
    seen, out, todo = {start}, [], [(start, iter(g.succ[start]))]
    while todo:
        a, rest = todo[-1]
        for b in rest:
            if b not in seen:
                seen.add(b)
                todo.append((b, iter(g.succ[b])))
                break
        else:
            out.append(a)
            todo.pop()
    return out


def components(g: Graph) -> list[int]:
    """The least block of each block's strongly connected component."""
    done: set[int] = set()
    order: list[int] = []
    for s in range(g.n):
        if s not in done:
            fresh = [b for b in finishing_order(g, s) if b not in done]
            done.update(fresh)
            order += fresh
    label = [-1] * g.n
    for s in reversed(order):
        if label[s] >= 0:
            continue
        group, todo = [], [s]
        label[s] = s
        while todo:
            a = todo.pop()
            group.append(a)
            for b in g.pred[a]:
                if label[b] < 0:
                    label[b] = s
                    todo.append(b)
        least = min(group)
        for b in group:
            label[b] = least
    return label


def in_cycle(g: Graph) -> list[bool]:
    label = components(g)
    size = [0] * g.n
    for x in label:
        size[x] += 1
    return [size[label[b]] > 1 or (b, b) in g.edges for b in range(g.n)]


def dominators(g: Graph) -> list[int]:
    """Immediate dominators; the entry's is itself, unreachable blocks have -1."""
    if not g.n:
        return []
    order = finishing_order(g, 0)[::-1]
    rank = {b: i for i, b in enumerate(order)}
    idom = [-1] * g.n
    idom[0] = 0
    changed = True
    while changed:
        changed = False
        for b in order[1:]:
            new = -1
            for p in g.pred[b]:
                if p not in rank or idom[p] < 0:
                    continue
                if new < 0:
                    new = p
                    continue
                x, y = p, new
                while x != y:
                    while rank[x] > rank[y]:
                        x = idom[x]
                    while rank[y] > rank[x]:
                        y = idom[y]
                new = x
            if idom[b] != new:
                idom[b], changed = new, True
    return idom


def solve(g: Graph, transfer: Callable[[int, frozenset], frozenset], boundary: frozenset = frozenset(), forward: bool = True, union: bool = True) -> tuple[list, list]:
    """(in, out) facts of each block as the least fixpoint; unreachable blocks keep None.

    Neighbours without facts yet are skipped in the meet. Backward problems start at blocks without
    successors (or, where none is, at the last reachable one).
    """
    into, out = (g.pred, g.succ) if forward else (g.succ, g.pred)
    live = reachable(g)
    starts = [0] if forward and g.n else [b for b in live if not g.succ[b]] or ([max(live)] if live else [])
    before: list[frozenset | None] = [None] * g.n
    after: list[frozenset | None] = [None] * g.n
    todo = deque(starts)
    queued = set(starts)
    while todo:
        b = todo.popleft()
        queued.discard(b)
        known = [after[p] for p in into[b] if after[p] is not None]
        if b in starts:
            known.append(boundary)
        fact = known[0] if known else boundary
        for k in known[1:]:
            fact = fact | k if union else fact & k
        result = transfer(b, fact)
        before[b] = fact
        if result != after[b]:
            after[b] = result
            for s in out[b]:
                if s in live and s not in queued:
                    queued.add(s)
                    todo.append(s)
    return (before, after) if forward else (after, before)


def liveness(g: Graph, uses: list[set], defs: list[set]) -> tuple[list, list]:
    return solve(g, lambda b, f: frozenset(uses[b] | (f - defs[b])), forward=False)


def reaching(g: Graph, defs: list[set]) -> tuple[list, list]:
    """Definitions (variable, block) that reach the start and end of each block."""
    return solve(g, lambda b, f: frozenset({d for d in f if d[0] not in defs[b]} | {(v, b) for v in defs[b]}))


def taint(g: Graph, steps: list[list[tuple[str, str, tuple[str, ...]]]]) -> tuple[list, list]:
    """Tainted variables with their origins: steps are (source|assign|clean, target, read variables)."""

    def run(b: int, fact: frozenset) -> frozenset:
        now = set(fact)
        for kind, target, read in steps[b]:
            origins = {o for v, o in now if v in read}
            now = {x for x in now if x[0] != target}
            if kind == "source":
                now.add((target, b))
            elif kind == "assign":
                now |= {(target, o) for o in origins}
        return frozenset(now)

    return solve(g, run)


class Lowering:
    """Statements to a graph: lists of ("stmt", defs, uses), ("if", uses, then, else), ("loop", defs, uses, body, else),
    ("match", arms of (uses, captures, guard's uses or None, body, whether it always matches)), ("try", body, handlers,
    finally), ("return", uses), ("break",), ("continue",). Iterative by an explicit stack."""

    def __init__(self, body: list):
        self.defs: list[set] = []
        self.uses: list[set] = []
        self.kinds: list[str] = []
        self.edges: set[tuple[int, int]] = set()
        entry = self._block("entry")
        self.exit = self._block("exit")
        self._run(body, entry)
        self.graph = Graph(len(self.kinds), self.edges)

    def _block(self, kind: str, defs=(), uses=()) -> int:
        self.kinds.append(kind)
        self.defs.append(set(defs))
        self.uses.append(set(uses))
        return len(self.kinds) - 1

    def _link(self, ends: list[int], to: int) -> None:
        self.edges.update((e, to) for e in ends)

    def _run(self, body: list, entry: int) -> None:
        # generators keep the stack of open statements on the heap
        stack, result = [self._suite(body, [entry], None)], None
        while stack:
            try:
                stack.append(stack[-1].send(result))
                result = None
            except StopIteration as e:
                stack.pop()
                result = e.value
        self._link(result, self.exit)

    def _suite(self, body: list, ends: list[int], loop):
        for s in body:
            kind = s[0]
            if kind == "stmt":
                b = self._block(kind, s[1], s[2])
                self._link(ends, b)
                ends = [b]
            elif kind == "if":
                b = self._block(kind, (), s[1])
                self._link(ends, b)
                first = yield self._suite(s[2], [b], loop)
                second = yield self._suite(s[3], [b], loop)
                ends = first + second
            elif kind == "loop":
                b = self._block(kind, s[1], s[2])
                self._link(ends, b)
                breaks: list[int] = []
                back = yield self._suite(s[3], [b], (b, breaks))
                self._link(back, b)
                rest = yield self._suite(s[4], [b], loop)
                ends = rest + breaks
            elif kind == "match":
                # what a pattern captures is bound before its guard, and stays bound if that fails
                done = []
                for uses, captured, guard, body, always in s[1]:
                    b = self._block("case", (), uses)
                    self._link(ends, b)
                    inside, ends = [b], [] if always else [b]
                    for more in ([("bind", captured, ())] if captured else []) + ([("guard", (), guard)] if guard is not None else []):
                        b = self._block(*more)
                        self._link(inside, b)
                        inside = [b]
                    ends = ends + inside * (guard is not None)
                    done = done + (yield self._suite(body, inside, loop))
                ends = done + ends
            elif kind == "try":
                b = self._block(kind)
                self._link(ends, b)
                low = len(self.kinds)
                done = yield self._suite(s[1], [b], loop)
                throwing = [b, *range(low, len(self.kinds))]
                for h in s[2]:
                    done = done + (yield self._suite(h, list(throwing), loop))
                ends = yield self._suite(s[3], done or throwing, loop)
            else:
                b = self._block(kind, (), s[1] if len(s) > 1 else ())
                self._link(ends, b)
                if kind == "break" and loop:
                    loop[1].append(b)
                elif kind == "continue" and loop:
                    self.edges.add((b, loop[0]))
                else:
                    self.edges.add((b, self.exit))
                ends = []
        return ends


def _names(node) -> tuple[set[str], set[str]]:
    """The names that a node and what stands in it read, and those that it stores."""
    import ast

    loaded: set[str] = set()
    stored: set[str] = set()
    todo = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, ast.Name):
            if isinstance(n.ctx, ast.Load):
                loaded.add(n.id)
            elif isinstance(n.ctx, ast.Store):
                stored.add(n.id)
        else:
            todo += children(n)
    return loaded, stored


def _spec(body: list) -> list:
    """The statements of a Python suite for ``Lowering``."""
    import ast

    def names(node, ctx) -> set[str]:
        return _names(node)[ctx is ast.Store] if node is not None else set()

    load = lambda *xs: set().union(*(names(x, ast.Load) for x in xs if x is not None))
    out = []
    for s in body:
        if isinstance(s, ast.If):
            out.append(("if", load(s.test), _spec(s.body), _spec(s.orelse)))
        elif isinstance(s, (ast.For, ast.AsyncFor)):
            out.append(("loop", names(s.target, ast.Store), load(s.iter), _spec(s.body), _spec(s.orelse)))
        elif isinstance(s, ast.While):
            out.append(("loop", set(), load(s.test), _spec(s.body), _spec(s.orelse)))
        elif isinstance(s, ast.Match):
            arms = []
            for c in s.cases:
                inside = list(ast.walk(c.pattern))
                captured = {n.name for n in inside if isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name} | {n.rest for n in inside if isinstance(n, ast.MatchMapping) and n.rest}
                arms.append((load(c.pattern), captured, None if c.guard is None else load(c.guard), _spec(c.body), isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None))
            out += [("stmt", names(s.subject, ast.Store), load(s.subject), 0), ("match", arms)]
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            out.append(("stmt", set().union(*(names(i.optional_vars, ast.Store) for i in s.items)), load(*(i.context_expr for i in s.items))))
            out += _spec(s.body)
        elif isinstance(s, ast.Try):
            out.append(("try", _spec([*s.body, *s.orelse]), [_spec(h.body) for h in s.handlers], _spec(s.finalbody)))
        elif isinstance(s, (ast.Return, ast.Raise)):
            out.append(("return", names(s, ast.Load)))
        elif isinstance(s, ast.Break):
            out.append(("break",))
        elif isinstance(s, ast.Continue):
            out.append(("continue",))
        else:
            extra = names(s.target, ast.Store) if isinstance(s, ast.AugAssign) else set()
            loaded, stored = _names(s)
            out.append(("stmt", stored, loaded | extra, s.lineno))
    return out


def dead_stores(path: str, text: str | None) -> list[tuple[str, int, str]]:
    """(path, line, name) of values of local variables that nothing reads (rule S1854)."""
    import ast
    import symtable

    try:
        tree = ast.parse(text or "")
        tables = {}
        todo = [symtable.symtable(text or "", path, "exec")]
    except (SyntaxError, ValueError, RecursionError):
        return []
    while todo:
        t = todo.pop()
        todo.extend(t.get_children())
        tables[t.get_name(), t.get_lineno()] = t
    found = []
    todo = deque([tree])
    while todo:
        fn = todo.popleft()
        todo.extend(c for c in children(fn) if not isinstance(c, ast.expr))  # no function stands within an expression
        if not isinstance(fn, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        scope = tables.get((fn.name, fn.decorator_list[0].lineno if fn.decorator_list else fn.lineno)) or tables.get((fn.name, fn.lineno))
        if scope is None:
            continue
        inner = {s.get_name() for c in scope.get_children() for s in c.get_symbols()}
        own = {s.get_name() for s in scope.get_symbols() if s.is_assigned() and s.is_local() and s.is_referenced() and s.get_name() not in inner}
        # a function that stores no local variable needs no graph, and its graph no other variables
        if not own:
            continue
        spec = _spec(fn.body)
        low = Lowering(spec)
        _, out = liveness(low.graph, [u & own for u in low.uses], [d & own for d in low.defs])
        lines = _lines(spec)
        for b, line in zip((i for i, k in enumerate(low.kinds) if k == "stmt"), lines):
            if line and out[b] is not None:
                found += [(path, line, v) for v in sorted(low.defs[b] & own - out[b]) if not v.startswith("_")]
    return found


def _lines(spec: list) -> list[int]:
    """Lines of the plain statements in the order in which their blocks are made."""
    out, todo = [], [iter(spec)]
    while todo:
        for s in todo[-1]:
            if s[0] == "stmt":
                out.append(s[3] if len(s) > 3 else 0)
                continue
            if s[0] == "match":
                todo.append(iter([z for arm in s[1] for z in arm[3]]))
                break
            parts = [x for x in s[1:] if isinstance(x, list)]
            flat = [y for p in parts for y in (p if s[0] != "try" or not p or not isinstance(p[0], list) else [z for q in p for z in q])]
            todo.append(iter(flat))
            break
        else:
            todo.pop()
    return out


def dead_store_findings(files: DataFrame) -> DataFrame:
    """(path, line, name) over files (path, text)."""

    def run(batches):
        for pdf in batches:
            rows = [r for p, t in zip(pdf["path"], pdf["text"]) for r in dead_stores(p, t)]
            yield pd.DataFrame(rows, columns=["path", "line", "name"])

    return files.select("path", "text").mapInPandas(run, "path string, line int, name string")


def graph_facts(edges: DataFrame) -> DataFrame:
    """fn_id, block, reachable, component, in_cycle, idom from edges (fn_id, src, dst); one small graph per group.

    Blocks are numbered densely inside, so that ids may be as large as they like; the entry, 0, is
    always there. A component goes by its least block; the entry and what it doesn't reach have no idom.
    """

    def facts(edges: list[tuple[int, int]]):
        ids = [0, *sorted({b for e in edges for b in e} - {0})]
        new = {b: i for i, b in enumerate(ids)}
        g = Graph(len(ids), {(new[a], new[b]) for a, b in edges})
        live, label, idom = reachable(g), components(g), dominators(g)
        least: dict[int, int] = {}
        for b in range(g.n):
            least[label[b]] = min(least.get(label[b], ids[b]), ids[b])
        return ids, [b in live for b in range(g.n)], [least[c] for c in label], in_cycle(g), [ids[idom[b]] if b and b in live else None for b in range(g.n)]

    types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]

    def run(batches):
        columns: list[list] = [[] for _ in types]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["fn_id", "block", "reachable", "component", "in_cycle", "idom"])

        for b in batches:
            for fn, src, dst in zip(*b.columns):
                found = facts(list(zip(src.as_py(), dst.as_py())))
                columns[0] += [fn.as_py()] * len(found[0])
                for c, more in zip(columns[1:], found):
                    c += more
                if len(columns[0]) >= _ROWS:
                    yield batch()
                    columns = [[] for _ in types]
        if columns[0]:
            yield batch()

    few = edges.select("fn_id", F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null")
    # many small graphs share a batch
    graphs = few.groupBy("fn_id").agg(F.collect_set(F.struct("src", "dst")).alias("e")).select("fn_id", F.col("e.src").alias("src"), F.col("e.dst").alias("dst"))
    return graphs.mapInArrow(run, "fn_id string, block long, reachable boolean, component long, in_cycle boolean, idom long")
