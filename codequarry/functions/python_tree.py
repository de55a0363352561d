"""The syntax tree of Python sources as rows of plain columns, for plans that join nodes.

Nodes are numbered in preorder; ``pre`` to ``last`` are a node and all below it. Positions are lines from
1 and columns from 0. Files that don't parse give one row of kind ``ParseError``; null texts are empty.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .python_checks import child_fields

#: ``field`` and ``at`` say where a node stands in its parent; ``name`` is an identifier, a dotted name or a module;
#: ``other`` an alias's new name, a name's context or the dots before a module. ``scope`` is the inmost scope that sees the node's
#: names first, or gets the name that it binds; scopes have theirs and all around it in ``around``, from the module on (0,4,9).
TREE = "path string, pre int, last int, parent int, field string, at int, kind string, name string, other string, sl int, sc int, el int, ec int, scope int, around string"
_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), *[pa.int32()] * 5, pa.string()]
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
_SCOPES = (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, *_COMPREHENSIONS)
#: Kinds that have a name.
_TELLING = frozenset(k for k in vars(ast).values() if isinstance(k, type) and issubclass(k, ast.AST) and {"name", "names", "id", "attr", "arg", "module", "rest"} & set(k._fields))
_OPENING, _EVERYWHERE, _PASSED = frozenset(_SCOPES), frozenset((ast.Module, *_COMPREHENSIONS)), frozenset(k.__name__ for k in _COMPREHENSIONS)
#: Rows of one batch, about.
_ROWS = 50_000


def _named(n: ast.AST) -> tuple[str | None, str | None]:
    if isinstance(n, ast.Name):
        return n.id, type(n.ctx).__name__
    if isinstance(n, ast.Attribute):
        parts, below = [n.attr], n.value
        while isinstance(below, ast.Attribute):
            parts.append(below.attr)
            below = below.value
        return (".".join([below.id, *reversed(parts)]), type(n.ctx).__name__) if isinstance(below, ast.Name) else (None, None)
    if isinstance(n, ast.alias):
        return n.name, n.asname
    if isinstance(n, (ast.arg, ast.keyword)):
        return n.arg, None
    if isinstance(n, ast.ImportFrom):
        return n.module, "." * n.level
    if isinstance(n, (ast.Global, ast.Nonlocal)):
        return ",".join(n.names), None
    if isinstance(n, ast.MatchMapping):
        return n.rest, None
    name = getattr(n, "name", None)  # functions, classes, handlers, captures; a type alias has a node
    return name if isinstance(name, str) else None, None


def tree_rows(path: str, text: str | None) -> list[list]:
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        line = getattr(e, "lineno", 0) or 0
        return [[path, 0, 0, -1, "", 0, "ParseError", None, None, line, 0, line, 0, 0, None]]
    rows: list[list] = []
    todo: list[tuple] = [(tree, -1, "", 0, 0)]
    around: dict[int, tuple[int, ...]] = {}
    while todo:
        n, parent, field, at, scope = todo.pop()
        me, kind = len(rows), type(n)
        name, other = (n.id, type(n.ctx).__name__) if kind is ast.Name else _named(n) if kind in _TELLING else (None, None)
        inner = inside = scope
        if kind in _OPENING:
            around[me] = (*around.get(scope, ()), me)
            # defaults, decorators and annotations belong to what is around, and so does a comprehension's first source
            inner = me if kind in _EVERYWHERE else scope
            inside = me
        spot = (n.lineno, n.col_offset, n.end_lineno or 0, n.end_col_offset or 0) if kind._attributes else (0, 0, 0, 0)
        rows.append([path, me, me, parent, field, at, kind.__name__, name, other, *spot, scope, ",".join(map(str, around[me])) if kind in _OPENING else None])
        if kind is ast.arg and rows[parent][6] == "arguments":
            rows[me][13] = rows[parent][3]
        fields = child_fields(kind)
        if not fields:
            continue
        children = []
        for f in fields:
            v = getattr(n, f, None)
            to = inside if f == "body" else inner
            if isinstance(v, list):
                children += [(c, me, f, i, to) for i, c in enumerate(v) if isinstance(c, ast.AST)]
            elif isinstance(v, ast.AST):
                if f == "iter" and kind is ast.comprehension and at == 0:
                    to = rows[parent][13]
                elif f == "target" and kind is ast.NamedExpr:
                    to = next(x for x in reversed(around[scope]) if rows[x][6] not in _PASSED)
                children.append((v, me, f, 0, to))
        children.reverse()
        todo += children
    for r in reversed(rows):
        if r[3] >= 0:
            up = rows[r[3]]
            up[2] = max(up[2], r[2])
    return rows


def tree(files: DataFrame) -> DataFrame:
    """The nodes of files (path, text)."""
    names = [c.split()[0] for c in TREE.split(", ")]

    def run(batches):
        rows: list[list] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=names)

        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += tree_rows(path, text)
                if len(rows) >= _ROWS:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()

    return files.select("path", "text").mapInArrow(run, TREE)


#: A file's nodes by columns, in preorder: how many are below a node, how far above its parent stands, how many lines it goes on.
_PACKED = [("below", pa.int32()), ("up", pa.int32()), *((c, t) for c, t in zip("field at kind name other sl sc".split(), _TYPES[4:11])), ("more", pa.int32()), ("ec", pa.int32()), ("out", pa.int32()), ("around", pa.string())]


def placed_tree(files: DataFrame, n: int) -> DataFrame:
    """The nodes of files, as of ``tree``, with each file in one of ``n`` partitions by its path. Files travel as one row each with a
    list (of strings: a text of lines) for each column, which takes a fraction of what their nodes would."""
    types = {pa.string(): "string", pa.int32(): "array<int>"}

    def run(batches):
        for b in batches:
            for path, text in zip(b.column(0), b.column(1)):
                r = list(zip(*tree_rows(path.as_py(), text.as_py())))
                pre, last, parent, sl, el, scope = r[1], r[2], r[3], r[9], r[11], r[13]
                columns = [[x - y for x, y in zip(last, pre)], [x - y for x, y in zip(pre, parent)], *r[4:11], [x - y for x, y in zip(el, sl)], r[12], [x - y for x, y in zip(pre, scope)], r[14]]
                # no name holds a line's end or a zero byte
                packed = [pa.array(["\n".join("\0" if x is None else x for x in c)]) if t == pa.string() else pa.array([c], pa.list_(t)) for c, (_, t) in zip(columns, _PACKED)]
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()], pa.string()), *packed], names=["path", *(c for c, _ in _PACKED)])

    whole = files.select("path", "text").mapInArrow(run, "path string, " + ", ".join(f"{c} {types[t]}" for c, t in _PACKED)).repartition(n, "path")
    lists = whole.select("path", *(F.split(c, "\n", -1).alias(c) if t == pa.string() else c for c, t in _PACKED))
    nodes = lists.select("path", F.posexplode(F.arrays_zip(*(c for c, _ in _PACKED))).alias("pre", "n"))
    own = {"last": F.col("pre") + F.col("n.below"), "parent": F.col("pre") - F.col("n.up"), "el": F.col("n.sl") + F.col("n.more"), "scope": F.col("pre") - F.col("n.out"), **{c: F.nullif(F.col(f"n.{c}"), F.lit("\0")) for c in ("name", "other", "around")}}
    return nodes.select(*(F.col(c) if c in ("path", "pre") else own.get(c, F.col(f"n.{c}")).alias(c) for c in (x.split()[0] for x in TREE.split(", "))))
