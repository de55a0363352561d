"""What is wrong with a regular expression, by the standard library's own parser."""

from __future__ import annotations

import re
import warnings
from re import _parser as parser

#: Limit of the complexity rule, and characters that a class may hold alone without a warning. Fixed values.
COMPLEXITY, ALONE = 20, frozenset(".*+?()[]{}|^$\\ ")
_REPEATS = ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT")


def _parts(op: str, arg) -> list:
    """The sequences inside a node."""
    if op == "BRANCH":
        return list(arg[1])
    if op in _REPEATS:
        return [arg[2]]
    if op == "SUBPATTERN":
        return [arg[3]]
    if op in ("ASSERT", "ASSERT_NOT"):
        return [arg[1]]
    if op == "ATOMIC_GROUP":
        return [arg]
    if op == "GROUPREF_EXISTS":
        return [x for x in arg[1:] if x is not None]
    return []


def _sequences(tree):
    """Every sequence of nodes with its depth."""
    todo = [(tree, 0)]
    while todo:
        seq, depth = todo.pop()
        yield seq, depth
        for op, arg in seq:
            todo += [(p, depth + 1) for p in _parts(str(op), arg)]


def _classes(pattern: str):
    """The bodies of character classes as they stand, escapes skipped."""
    at, inside, start = 0, False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 2
            continue
        if not inside and c == "[":
            inside, start = True, at + 1
            at += pattern.startswith("^", at + 1)
            at += pattern.startswith("]", at + 1)
        elif inside and c == "]":
            yield pattern[start:at]
            inside = False
        at += 1


def _members(body: str) -> list[tuple[int, int]]:
    """The ranges of a class without escapes."""
    body, out, i = body.removeprefix("^"), [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            out.append((ord(body[i]), ord(body[i + 2])))
            i += 3
        else:
            out.append((ord(body[i]), ord(body[i])))
            i += 1
    return out


def _complexity(tree) -> int:
    """One for each repeat, alternation and lookaround, and one more for each level around it."""
    return sum(1 + depth for seq, depth in _sequences(tree) for op, _ in seq if str(op) in (*_REPEATS, "BRANCH", "ASSERT", "ASSERT_NOT"))


def regex_rules(pattern: str) -> set[str]:
    """Keys of the rules that a Python pattern breaks; S5856 alone if it isn't valid."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return {"S5856"}
    found = set()
    top = list(tree)
    for seq, _ in _sequences(tree):
        ops = [(str(op), arg) for op, arg in seq]
        for i, (op, arg) in enumerate(ops):
            if op in _REPEATS:
                low, high, body = arg
                if high is parser.MAXREPEAT and body.getwidth()[0] == 0:
                    found.add("S5842")
                if low == high and low in (0, 1):
                    found.add("S6396")
                if op == "MIN_REPEAT" and seq is tree and i == len(ops) - 1:
                    found.add("S6019")
            elif op == "BRANCH":
                if any(not len(b) for b in arg[1]):
                    found.add("S6323")
                starts = [len(b) > 0 and str(b[0][0]) == "AT" and str(b[0][1]) in ("AT_BEGINNING", "AT_BEGINNING_STRING") for b in arg[1]]
                ends = [len(b) > 0 and str(b[-1][0]) == "AT" and str(b[-1][1]) == "AT_END" for b in arg[1]]
                if len(top) == 1 and seq is tree and (starts[0] and not any(starts[1:]) or ends[-1] and not any(ends[:-1])):
                    found.add("S5850")
            elif op == "SUBPATTERN" and not len(arg[3]) or op == "ATOMIC_GROUP" and not len(arg):
                found.add("S6331")
            elif op == "LITERAL" and arg == 32 and i + 1 < len(ops) and ops[i + 1] == ("LITERAL", 32):
                found.add("S6326")
            elif op == "AT" and not tree.state.flags & re.MULTILINE:
                after = any(o in ("LITERAL", "NOT_LITERAL", "IN", "ANY") for o, _ in ops[i + 1 :])
                before = any(o in ("LITERAL", "NOT_LITERAL", "IN", "ANY") for o, _ in ops[:i])
                if str(arg) == "AT_END" and after or str(arg) == "AT_BEGINNING" and before:
                    found.add("S5996")
    for body in _classes(pattern):
        if "\\" in body:
            continue
        members = _members(body)
        if any(a[0] <= b[1] and b[0] <= a[1] for i, a in enumerate(members) for b in members[:i]):
            found.add("S5869")
        if len(body) == 1 and body not in ALONE:
            found.add("S6397")
        if body in ("0-9", "^0-9"):
            found.add("S6353")
    if re.search(r"(?<!\\)\{(?:0,1|0,|1,)\}", pattern):
        found.add("S6353")
    if _complexity(tree) > COMPLEXITY:
        found.add("S5843")
    return found


def needed(pattern: str) -> str:
    """A text that every match, with what it looks at around it, holds; empty if none is found.

    Java's forms that Python's parser doesn't know are read as something wider.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = parser.parse(re.sub(r"\\p\{[^{}]*\}", r"\\w", pattern.replace(r"\z", r"\Z")))
    except (re.error, RecursionError, OverflowError):
        return ""
    if tree.state.flags & re.IGNORECASE:
        return ""
    best, run, todo = "", "", [iter(tree)]
    while todo:
        step = next(todo[-1], None)
        if step is None:
            todo.pop()
            run = run if len(todo) == 0 else ""
            continue
        op, arg = str(step[0]), step[1]
        if op == "LITERAL":
            run += chr(arg)
            best = max(best, run, key=len)
            continue
        run = ""
        if op == "SUBPATTERN" and not (arg[1] & re.IGNORECASE) or op == "ASSERT":
            todo.append(iter(arg[3] if op == "SUBPATTERN" else arg[1]))
        elif op in _REPEATS and arg[0] > 0:
            todo.append(iter(arg[2]))
    return best
