"""Fixes are chosen from the columns of a batch: the same ones as by comparing every pair of edits, without an object for each value."""

import random
import time

import pyarrow as pa

from codequarry.plans import reports

EDITS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("replacement", pa.string())]))
FOUND = pa.list_(pa.struct([("rule_key", pa.string()), ("edits", EDITS)]))


def _batch(files):
    found = [[{"rule_key": k, "edits": e and [dict(zip(("start", "stop", "replacement"), x)) for x in e]} for k, e in fixes] for fixes in files]
    return pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(files))]), pa.array(found, FOUND)], names=["path", "found"])


def _slow(fixes):
    clash = lambda a, b: a[0] == b[0] or a[0] < b[1] and b[0] < a[1]
    tried = sorted((min(e)[0], k or "", sorted(e)) for k, e in ([k, [(a, b, r or "") for a, b, r in e or ()]] for k, e in fixes) if e)
    kept, taken = [], 0
    for _, _, edits in tried:
        if not any(clash(x, y) for i, x in enumerate(edits) for y in edits[:i] + kept):
            kept, taken = sorted(kept + edits), taken + 1
    return kept, taken, len(fixes) - taken


def _files(rng, n, most):
    edit = lambda: (a := rng.randrange(60), a + rng.randrange(6), rng.choice(["x", "y", "", None]))
    return [[(rng.choice(["S1", "S2", None]), rng.choice([None, [edit() for _ in range(rng.randrange(4))]])) for _ in range(rng.randrange(most))] for _ in range(n)]


def test_chosen_fixes_equal_those_of_every_pair():
    files = _files(random.Random(5), 400, 12)
    whole = _batch(files)
    for start, batch in ((0, whole), (7, whole.slice(7, 90)), (0, whole.slice(0, 0))):
        (out,) = reports._chosen([batch])
        got = [([tuple(e.values()) for e in r["edits"]], r["fixes"], r["conflicts"]) for r in out.to_pylist()]
        assert got == [_slow(f) for f in files[start : start + batch.num_rows]] and out.schema.field("edits").type == EDITS


def test_choosing_takes_less_time_than_objects_of_all_values():
    batch = _batch(_files(random.Random(6), 5000, 10))
    took = []
    for work in (lambda: list(reports._chosen([batch])), lambda: batch.column(1).to_pylist()):
        work()
        took.append(min(_timed(work) for _ in range(3)))
    assert took[0] < took[1]


def _timed(work):
    began = time.process_time()
    work()
    return time.process_time() - began
