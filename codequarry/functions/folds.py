"""SQL text of folds over arrays within a row."""

from __future__ import annotations


def running(items: str, kind: str, zero: str, step: str, merge: str, out: str, acc: str = "bigint") -> str:
    """SQL: an array of ``out`` for each ``x`` of the array ``items`` (a column), where ``acc`` is the fold of what stands before x.

    ``step`` folds x into acc and ``merge`` two folds ``acc`` and ``b``; ``kind`` and ``acc`` are the types
    of the array and of a fold. Items go in blocks of the square root of their number, so that no
    long array is copied for each of them.
    """
    width = f"cast(ceil(sqrt(size({items}))) as int)"
    blocks = f"transform(sequence(0, cast(ceil(size({items}) / {width}) as int) - 1), i -> slice({items}, i * {width} + 1, {width}))"
    sums = f"transform(blocks, block -> aggregate(block, {zero}, (acc, x) -> {step}))"
    before = f"aggregate({sums}, named_struct('acc', {zero}, 'out', cast(array() as array<{acc}>)), (s, b) -> named_struct('acc', transform(array(s.acc), acc -> {merge})[0], 'out', concat(s.out, array(s.acc))), s -> s.out)"
    inner = f"""aggregate(block, named_struct('acc', first, 'out', cast(array() as {kind})), (s, x) -> named_struct(
        'acc', transform(array(s.acc), acc -> {step})[0], 'out', concat(s.out, transform(array(s.acc), acc -> {out}))), s -> s.out)"""
    found = f"transform(array({blocks}), blocks -> flatten(zip_with(blocks, {before}, (block, first) -> {inner})))[0]"
    return f"if(size({items}) = 0, cast(array() as {kind}), {found})"
