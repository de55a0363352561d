"""Files and lines of two snapshots that go together: fuzzy pairs of files, alignment of lines.

Both rest on longest common subsequences of lines. Pairs of files are only compared if they can
matter: if one of them could be the other's best.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import durable

#: Lines that at most so many files of a side hold make the first round of comparisons.
RARE = 8


def common_lines(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    if len(b) < len(a):
        a, b = b, a
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row = (1 << len(a)) - 1  # bit-parallel: a zero bit is a line of ``a`` that ends a longer chain
    full = row
    for x in b:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _key(line):
    """A line, or the SHA-256 of a longer one: 44 characters, as no line that stands for itself has."""
    return F.when(F.octet_length(line) < 44, line).otherwise(F.base64(F.unhex(F.sha2(line, 256))))


def _kept(current: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (mine, path, digest, kept) as numbers of the lines that both sides have, and these (line, held): no other line can count.

    Lines that more files hold have larger numbers. Texts end here; what follows moves numbers.
    """
    side = lambda d, mine: d.select(F.lit(mine).alias("mine"), "path", "digest", F.transform("lines", _key).alias("keys"))
    both = durable(side(current, True).unionByName(side(reference, False)).withColumn("file", F.monotonically_increasing_id()))
    a, b = F.count_if("mine"), F.count_if(~F.col("mine"))
    held = both.select("mine", F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(a.alias("a"), b.alias("b")).where("a > 0 and b > 0")
    lines = durable(held.select("key", (F.col("a") + F.col("b")).alias("held")).orderBy("held").select("key", "held", F.monotonically_increasing_id().alias("line")))
    rows = both.select("file", F.posexplode("keys").alias("at", "key")).join(lines.select("key", "line"), "key")
    kept = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("r"))
    files = both.select("file", "mine", "path", "digest").join(kept, "file").select("mine", "path", "digest", F.col("r.line").alias("kept"))
    return files, lines.select("line", "held")


def _classes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of a side whose kept lines are equal score alike: (class, mine, digest, kept, n) with one row a class, and (class, path).

    Files whose whole content the other side has are classes of their own content, since equal files aren't compared.
    """
    twins = files.groupBy("digest").agg(F.min("mine").alias("low"), F.max("mine").alias("high")).where("low <> high").select("digest", F.lit(True).alias("twin"))
    named = files.join(twins, "digest", "left").withColumn("digest", F.when(F.col("twin"), F.col("digest"))).drop("twin")
    same = F.concat_ws(",", F.col("mine").cast("string"), F.coalesce("digest", F.lit("")), F.col("kept").cast("array<string>"))
    named = durable(named.withColumn("same", F.unhex(F.sha2(same, 256))))
    one = named.groupBy("same").agg(*(F.first(c).alias(c) for c in ("mine", "digest", "kept")), F.count("*").alias("n"))
    one = durable(one.withColumn("class", F.monotonically_increasing_id()))
    return one.drop("same"), durable(named.select("same", "path").join(one.select("same", "class"), "same").select("class", "path"))


def _scored(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """c, r, score of pairs of classes with different content, and how many files each stands for (2 at most)."""

    def score(batches):
        import pyarrow as pa

        for b in batches:
            n = [common_lines(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), b.column(4), b.column(5)], names=["c", "r", "score", "cs", "rs"])

    side = lambda mine, *names: classes.where(F.col("mine") == mine).select(*(F.col(x).alias(y) for x, y in zip(("class", "digest", "kept", "n"), names)))
    both = pairs.join(side(True, "c", "d", "x", "cs"), "c").join(side(False, "r", "e", "y", "rs"), "r")
    different = F.col("d").isNull() | F.col("e").isNull() | (F.col("d") != F.col("e"))
    few = lambda n: F.least(F.col(n), F.lit(2)).cast("int").alias(n)
    # comparing costs far more than the few bytes of a pair suggest
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.where(different).select("c", "r", "x", "y", few("cs"), few("rs")).repartition(n, "c", "r").mapInArrow(score, "c long, r long, score int, cs int, rs int").where("score > 0")


def _places(classes: DataFrame) -> DataFrame:
    """mine, class, line, after and the other columns: the different lines of each class, rare ones first, and how many lines come from each on."""
    rows = classes.withColumn("kept", F.sort_array("kept")).select("*", F.posexplode("kept").alias("i", "line"))
    return rows.where("i = 0 or kept[i - 1] <> line").withColumn("after", F.size("kept") - F.col("i")).drop("kept", "i", "digest", "n")


def _needed(known: DataFrame) -> DataFrame:
    """class, need: the score that a pair needs to matter to a class: its best one, or more where two files have that already."""

    def side(name: str, others: str) -> DataFrame:
        scores = known.groupBy(F.col(name).alias("class"), "score").agg(F.sum(others).alias("files"))
        return scores.groupBy("class").agg(F.max(F.struct("score", "files")).alias("best"))

    return side("c", "rs").union(side("r", "cs")).select("class", (F.col("best.score") + F.when(F.col("best.files") > 1, 1).otherwise(0)).alias("need"))


def fuzzy_candidates(current: DataFrame, reference: DataFrame, rare: int = RARE) -> DataFrame:
    """path, reference_path, score of files (path, digest, lines): the longest common subsequence of lines.

    All pairs that can tell a file's best counterpart are there: every file's best one, a second one where it is tied,
    and for each reference's best likewise; pairs of equal content aren't. Files are compared by classes of those with
    equal lines, as far as the other side has them. Pairs that share a line of few files are compared first, then a class
    with two others that hold one of its frequent lines and the most lines after it. To reach the best score so far, or
    to exceed it where two files have it, a pair has to share one of the class's rarest lines, and both need as many
    lines from the first common one on. That finds every pair that may matter, however many files hold a line.
    """
    # written, not only kept: the plans of what follows stay small, and lost executors cost little
    files, lines = _kept(current, reference)
    classes, members = _classes(files)
    often = lines.where(F.col("held") > 2 * rare).agg(F.min("line")).first()[0]
    few = F.lit(True) if often is None else F.col("line") < often
    of = lambda mine: F.collect_list(F.when(F.col("mine") == mine, F.col("class")))
    met = _places(classes).where(few).groupBy("line").agg(of(True).alias("cs"), of(False).alias("rs"))
    scored = durable(_scored(met.select(F.explode("cs").alias("c"), "rs").select("c", F.explode("rs").alias("r")).distinct(), classes))

    def more(others: DataFrame) -> DataFrame:
        # without the lines from here on there are too few left to reach the score that is needed
        own = _places(classes.join(_needed(scored), "class", "left").withColumn("need", F.coalesce("need", F.lit(1)))).where(~few & (F.col("after") >= F.col("need")))
        other = others.select((~F.col("mine")).alias("mine"), "line", F.col("class").alias("other"), F.col("after").alias("left"))
        pairs = own.join(other, ["mine", "line"]).where("left >= need").select(F.when(F.col("mine"), F.col("class")).otherwise(F.col("other")).alias("c"), F.when(F.col("mine"), F.col("other")).otherwise(F.col("class")).alias("r"))
        return durable(scored.union(_scored(pairs.distinct().join(scored, ["c", "r"], "left_anti"), classes)))

    if often is not None:
        every = _places(classes).where(~few)
        longest = Window.partitionBy("line", "mine").orderBy(F.desc("after"), "class")
        scored = more(every.withColumn("nth", F.row_number().over(longest)).where("nth <= 2"))
        scored = more(every)
    top = lambda one, other: F.row_number().over(Window.partitionBy(one).orderBy(F.desc("score"), other))
    mine, theirs = (scored.withColumn("place", top(*x)).where("place <= 2").select("c", "r", "score") for x in (("c", "r"), ("r", "c")))
    kept = durable(mine.union(theirs).distinct())
    two = members.withColumn("nth", F.row_number().over(Window.partitionBy("class").orderBy("path"))).where("nth <= 2")
    named = lambda d, key, name: d.select(F.col("class").alias(key), F.col("path").alias(name))
    wide = kept.join(named(members, "c", "path"), "c").join(named(two, "r", "reference_path"), "r")
    tall = kept.join(named(two, "c", "path"), "c").join(named(members, "r", "reference_path"), "r")
    return wide.select("path", "reference_path", "score").union(tall.select("path", "reference_path", "score")).distinct()


def fuzzy_pairs(candidates: DataFrame) -> DataFrame:
    """path, reference_path, pairing of the best candidates.

    A current file takes its only best reference if that reference's own best score is untied; a
    tie on either side, or a reference that an earlier path took, is ambiguous.
    """
    mine, theirs = Window.partitionBy("path"), Window.partitionBy("reference_path")
    c = candidates.withColumns({"best": F.max("score").over(mine), "top": F.max("score").over(theirs)})
    c = c.withColumns({"ties": F.count_if(F.col("score") == F.col("best")).over(mine), "rivals": F.count_if(F.col("score") == F.col("top")).over(theirs)}).where("score = best")
    one = c.groupBy("path").agg(F.min("reference_path").alias("reference_path"), F.bool_or((F.col("ties") > 1) | (F.col("rivals") > 1)).alias("tied"))
    clear = F.when(~F.col("tied"), F.col("reference_path"))
    first = F.min(F.when(~F.col("tied"), F.col("path"))).over(Window.partitionBy(clear))
    out = one.withColumn("taken", clear.isNotNull() & (first == F.col("path")))
    return out.select("path", F.when(F.col("taken"), F.col("reference_path")).alias("reference_path"), F.when(F.col("taken"), "fuzzy").otherwise("ambiguous").alias("pairing"))


# ---------------------------------------------------------------- alignment of lines

#: Rows between those that are kept while ranks run down a table.
_KEPT = 256
#: Pairs of equal lines, for each line of both sides, that are always taken one by one; how many there may be at all;
#: how many places of a band take as long as one of them.
_PAIRS_A_LINE, _PAIRS, _PLACES = 16, 1 << 24, 60


def _by_pairs(a, b):
    """Which lines of ``a`` some longest chain leaves out, and whether there are several chains, from the pairs of equal lines.

    Each pair gets the lengths of the longest chains up to it and from it on, by piles of their last and first lines. A chain
    that leaves a line out goes from a pair before it to one of the next rank behind it. Pairs of one rank run from low left to
    high right, so that the last one of the next rank that stands further right than a pair is the furthest that it leads to.
    """
    import bisect

    import numpy as np

    order = np.argsort(b, kind="stable")
    first, end = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = end - first
    i = np.repeat(np.arange(len(a)), n)
    # of a line's pairs the last comes first, so that none follows another
    j = order[np.repeat(end, n) - 1 - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))]

    def lengths(places: list[int]):
        piles: list[int] = []
        out = np.zeros(len(places), dtype=np.int64)
        for at, x in enumerate(places):
            pile = bisect.bisect_left(piles, x)
            if pile == len(piles):
                piles.append(x)
            else:
                piles[pile] = x
            out[at] = pile + 1
        return out

    rank, rest = lengths(j.tolist()), lengths((-j[::-1]).tolist())[::-1]
    longest = int(rank.max())
    on = rank + rest - 1 == longest
    i, j, rank = i[on], j[on], rank[on]
    size = len(b) + 1
    key = rank * size + (len(b) - j)
    by = np.argsort(key, kind="stable")
    i, j, rank, key = i[by], j[by], rank[by], key[by]
    inner = rank < longest
    furthest = i[np.searchsorted(key, (rank[inner] + 1) * size + (len(b) - j[inner])) - 1]
    low = np.concatenate([[0], i[inner] + 1, [i[rank == longest].min() + 1]])
    high = np.concatenate([[i[rank == 1].max()], furthest, [len(a)]])
    steps = np.zeros(len(a) + 1, dtype=np.int64)
    np.add.at(steps, low, 1)
    np.add.at(steps, high, -1)
    return np.cumsum(steps[:-1]) > 0, len(rank) > longest


def _ranks(a, b, low: int, width: int, first: int = 0, row=None):
    """Rows of chain lengths: for each i from ``first`` on the longest chains of a[:i] and b[:j], for j - i from ``low`` on.

    ``row`` is the first one if it isn't 0. Places outside of the table have -1.
    """
    import numpy as np

    at = np.arange(width) + low
    padded = np.concatenate([np.full(1, -1), b, np.full(1, -1)])
    if row is None:
        row = np.where((at >= 0) & (at <= len(b)), 0, -1).astype(np.int32)
    yield first, row
    for i in range(first + 1, len(a) + 1):
        j = at + i
        inside = (j >= 0) & (j <= len(b))
        # a step down is one place back in the band, a step with an equal pair keeps the place, a step right is the running maximum
        pair = (padded[np.clip(j, 0, len(b) + 1)] == a[i - 1]) & (row >= 0)
        row = np.maximum(np.where(pair, row + 1, -1), np.append(row[1:], -1))
        row = np.where(inside, np.maximum.accumulate(np.where(inside, row, -1)), -1).astype(np.int32)
        yield i, row


def aligned(current: list, reference: list) -> tuple[list[int], bool]:
    """Lines of ``current`` (from 1) that aren't in every longest common subsequence, and whether several of these exist.

    A line can be left out if somewhere the chains that end before it and those that start after it make up the longest
    length. A pair of equal lines with f lines of a chain up to it and g from it on lies on a longest chain if f + g - 1 is
    that length; there is just one longest chain if each rank f has one such pair. Lines that the other side lacks are left
    out first; as many steps aside as the rest needs bound the band in which pairs are looked for, and lengths from
    the end are kept for every 256th line and made again between. Where the pairs of equal lines are fewer than the
    band's places, they alone are looked at.
    """
    import numpy as np

    ids: dict = {}
    x = np.array([ids.setdefault(v, len(ids)) for v in current], dtype=np.int64)
    y = np.array([ids.setdefault(v, len(ids)) for v in reference], dtype=np.int64)
    place = np.flatnonzero(np.isin(x, y))
    a, b = x[place], y[np.isin(y, x)]
    if not len(a):
        return list(range(1, len(current) + 1)), False
    n, m = len(a), len(b)
    equal_pairs = int((np.bincount(a, minlength=len(ids)) * np.bincount(b, minlength=len(ids))).sum())
    few = equal_pairs <= _PAIRS_A_LINE * (n + m)
    if not few:
        longest = common_lines(a.tolist(), b.tolist())
        low, width = -(n - longest), (n - longest) + (m - longest) + 1
        few = equal_pairs <= _PAIRS and _PLACES * equal_pairs < n * width
    if few:
        free, several = _by_pairs(a, b)
        return (np.setdiff1d(np.arange(len(current)), place[~free]) + 1).tolist(), several
    # from the end both are read backwards: place d of the band is place width - 1 - d there
    back_low = -(m - longest) + (m - n)
    kept = {i: row for i, row in _ranks(a[::-1], b[::-1], back_low, width) if i % _KEPT == 0}
    free, count = np.zeros(n, dtype=bool), np.zeros(longest + 1, dtype=np.int64)
    at = np.arange(width) + low
    padded = np.concatenate([np.full(1, -1), b, np.full(1, -1)])
    block: dict[int, np.ndarray] = {}
    before = None
    for i, row in _ranks(a, b, low, width):
        if i:
            rest = n - i  # lines after this one
            if rest not in block:
                start = rest // _KEPT * _KEPT
                block = dict(itertools.islice(_ranks(a[::-1], b[::-1], back_low, width, start, kept[start]), _KEPT))
            after = block[rest][::-1]
            j = at + i
            equal = (padded[np.clip(j, 0, m + 1)] == a[i - 1]) & (j >= 1) & (j <= m) & (before >= 0)
            on = before[equal & (before + 1 + after == longest)]
            np.add.at(count, on + 1, 1)
            # the same place of the other side is one further on in the row before
            free[i - 1] = ((before[1:] >= 0) & (after[:-1] >= 0) & (before[1:] + after[:-1] == longest)).any()
        before = row
    new = np.setdiff1d(np.arange(len(current)), place[~free]) + 1
    return new.tolist(), bool((count[1:] > 1).any())


def aligned_lines(pairs: DataFrame) -> DataFrame:
    """path, new_lines, status (complete or uncertain) of paired files (path, lines, reference_lines)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [aligned(x.as_py() or [], y.as_py() or []) for x, y in zip(batch.column(1), batch.column(2))]  # one file's lines at a time
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array(["uncertain" if f[1] else "complete" for f in found], pa.string())], names=["path", "new_lines", "status"])

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.select("path", "lines", "reference_lines").repartition(n, "path").mapInArrow(run, "path string, new_lines array<int>, status string")
