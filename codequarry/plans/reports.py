"""Report documents from findings: native JSON, generic issues, GitLab code quality, SARIF, text, and fixes.

A document's rows are built per file or rule family; only the final document of one project is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import length_prefixed_sha256, utf16_units

#: Severities of the catalog in the reports' terms. Fixed values.
GITLAB_SEVERITY = {"BLOCKER": "blocker", "CRITICAL": "critical", "MAJOR": "major", "MINOR": "minor", "INFO": "info"}
SARIF_LEVEL = {"BLOCKER": "error", "CRITICAL": "error", "MAJOR": "warning", "MINOR": "note", "INFO": "note"}


def _mapped(column: str, table: dict[str, str], rest: str) -> Column:
    out = F.lit(rest)
    for k, v in table.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def uri(path: Column) -> Column:
    """A relative path with percent-encoded segments."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")


def native(findings: DataFrame, files: DataFrame) -> DataFrame:
    """One versioned JSON document per file: path, language, measures, sorted issues."""
    issue = F.struct("sl", "sc", "el", "ec", "rule_key", "message")
    per_file = findings.groupBy("path").agg(F.array_sort(F.collect_list(issue)).alias("issues"))
    both = files.join(per_file, "path", "left").withColumn("issues", F.coalesce("issues", F.array().cast("array<struct<sl:int,sc:int,el:int,ec:int,rule_key:string,message:string>>")))
    return both.select("path", F.to_json(F.struct(F.lit(1).alias("schema_version"), "path", "language", F.struct("lines", "code_lines", "comment_lines").alias("metrics"), "issues")).alias("document"))


def generic_issues(findings: DataFrame) -> DataFrame:
    """Rows of the generic issue import: columns are 0-based UTF-16 offsets, findings on a whole file have no range.

    ``findings`` has ``source``, the lines of the range.
    """
    offset = lambda c, n: utf16_units(F.substring(F.substring_index("source", "\n", n), F.lit(1), F.col(c)))
    span = F.struct(F.col("sl").alias("startLine"), F.col("el").alias("endLine"), offset("sc", 1).alias("startColumn"), offset("ec", -1).alias("endColumn"))
    return findings.select(F.col("rule_key").alias("ruleId"), "path", "message", F.when(F.col("sl") > 0, span).alias("textRange"))


def generic_rules(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """The rules block of the generic issue import: id, name, severity and type of each rule that has a finding."""
    return catalog.join(findings.select("rule_key").distinct(), "rule_key", "left_semi").select(F.col("rule_key").alias("id"), "name", "severity", "type")


def gitlab(findings: DataFrame) -> DataFrame:
    """Code quality entries: fingerprint over length-prefixed fields, severity, relative URI, first line."""
    spot = F.format_string("%d:%d-%d:%d", "sl", "sc", "el", "ec")
    return findings.select(
        F.col("message").alias("description"),
        F.col("rule_key").alias("check_name"),
        length_prefixed_sha256(F.lit("v2"), F.col("path"), F.col("rule_key"), F.col("message"), spot).alias("fingerprint"),
        _mapped("severity", GITLAB_SEVERITY, "info").alias("severity"),
        F.struct(uri(F.col("path")).alias("path"), F.struct(F.greatest("sl", F.lit(1)).alias("begin")).alias("lines")).alias("location"),
    )


def sarif(findings: DataFrame) -> DataFrame:
    """family, path, results: the results of a SARIF 2.1.0 run as a JSON array per rule family and file, so that no row grows with the project."""
    region = F.struct(F.col("sl").alias("startLine"), (F.col("sc") + 1).alias("startColumn"), F.col("el").alias("endLine"), (F.col("ec") + 1).alias("endColumn"))
    place = F.struct(F.struct(F.struct(uri(F.col("path")).alias("uri")).alias("artifactLocation"), F.when(F.col("sl") > 0, region).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_key").alias("ruleId"), _mapped("severity", SARIF_LEVEL, "note").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    rows = findings.groupBy("family", "path").agg(F.array_sort(F.collect_list(F.struct("sl", "sc", "el", "ec", "rule_key", "message", result.alias("result")))).alias("r"))
    return rows.select("family", "path", F.to_json("r.result").alias("results"))


def sarif_tools(findings: DataFrame) -> DataFrame:
    """family, tool: the driver of each family's run with its rules, as JSON."""
    keys = findings.select("family", "rule_key").distinct().groupBy("family").agg(F.array_sort(F.collect_set("rule_key")).alias("keys"))
    driver = F.struct(F.concat(F.lit("codequarry-"), F.col("family")).alias("name"), F.transform("keys", lambda k: F.struct(k.alias("id"))).alias("rules"))
    return keys.select("family", F.to_json(F.struct(driver.alias("driver"))).alias("tool"))


def text_lines(findings: DataFrame) -> DataFrame:
    """path, sl, row of the text report."""
    return findings.select("path", "sl", F.format_string("%s:%d:%d: %s %s", "path", "sl", "sc", "rule_key", "message").alias("row"))


EDITS = "array<struct<start:int,stop:int,replacement:string>>"


def _chosen(batches):
    """Batches of path, edits, fixes, conflicts from those of path and its fixes (rule_key, edits)."""
    import bisect

    import pyarrow as pa

    def plain(column, null=None):
        column = column if null is None else column.fill_null(null)
        # to_pylist makes a scalar of each value, which takes far longer
        return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()

    for b in batches:
        found = b.column(1)
        ends, keys, edits = plain(found.offsets), plain(found.values.field("rule_key"), ""), found.values.field("edits")
        of, e = plain(edits.offsets), edits.values
        every = list(zip(plain(e.field("start")), plain(e.field("stop")), plain(e.field("replacement"), "")))
        out: list[tuple] = []
        stops, fixes, conflicts = [0], [], []
        for low, high in zip(ends, ends[1:]):
            tried = []
            for f in range(low, high):
                own = every[of[f] : of[f + 1]]
                if len(own) > 1:
                    own.sort()
                if own:
                    tried.append((own[0][0], keys[f], own))
            tried.sort()
            kept: list[tuple] = []
            taken = 0
            for _, _, own in tried:
                clash = len(own) > 1 and any(b[0] < a[1] or b[0] == a[0] for a, b in zip(own, own[1:]))
                # behind all that are taken nothing overlaps
                behind = not kept or own[0][0] > kept[-1][0] and own[0][0] >= kept[-1][1]
                if not clash and not behind:
                    for e in own:
                        at = bisect.bisect_left(kept, e)
                        if any(n[0] == e[0] or n[0] < e[1] and e[0] < n[1] for n in kept[max(0, at - 1) : at + 1]):
                            clash = True
                            break
                if not clash:
                    taken += 1
                    for e in own:
                        if behind:
                            kept.append(e)
                        else:
                            bisect.insort(kept, e)
            out += kept
            stops.append(len(out))
            fixes.append(taken)
            conflicts.append(high - low - taken)
        columns = list(zip(*out)) if out else ([], [], [])
        flat = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.string()))], names=["start", "stop", "replacement"])
        taken_edits = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([b.column(0), taken_edits, pa.array(fixes, pa.int64()), pa.array(conflicts, pa.int64())], names=["path", "edits", "fixes", "conflicts"])


def chosen_fixes(fixes: DataFrame) -> DataFrame:
    """path, edits, fixes, conflicts: per file the edits of the fixes that are taken, in order, and how many are taken and not.

    ``fixes`` has path, rule_key and ``edits`` (start and stop as character offsets, end exclusive, replacement), any
    number of them. Fixes are tried by their first edit, then by rule key, and taken whole or not at all: a fix goes if any
    of its edits overlaps one that is taken, or another of its own, or if it has none. Insertions at one point conflict, and
    one at the start of a replacement; touching ends don't. A file's fixes are tried one after the other in one row.
    """
    few = fixes.groupBy("path").agg(F.collect_list(F.struct("rule_key", F.col("edits").cast(EDITS).alias("edits"))).alias("found"))
    return few.mapInArrow(_chosen, f"path string, edits {EDITS}, fixes long, conflicts long")


def chosen_edits(fixes: DataFrame) -> DataFrame:
    """path, edits, conflicts: as ``chosen_fixes``, of fixes of one edit each (path, start, stop, replacement, perhaps rule_key)."""
    key = F.col("rule_key") if "rule_key" in fixes.columns else F.lit("")
    one = fixes.select("path", key.alias("rule_key"), F.array(F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "replacement")).alias("edits"))
    return chosen_fixes(one).select("path", "edits", "conflicts")


def applied(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path, text, fixed: all edits of a file or, if one is out of bounds, none (``fixed`` is null).

    Edits are in order and don't overlap, as ``chosen_edits`` gives them.
    """
    return files.select("path", "text").join(edits.select("path", "edits"), "path", "left").select("path", "text", edited().alias("fixed"))


def edited() -> Column:
    """What the ``edits`` of a row make of its ``text``, as of ``applied``."""
    pieces = "transform(edits, (x, i) -> concat(substring(text, if(i = 0, 0, edits[i - 1].stop) + 1, x.start - if(i = 0, 0, edits[i - 1].stop)), x.replacement))"
    whole = f"concat(array_join({pieces}, ''), substring(text, element_at(edits, -1).stop + 1))"
    good = F.expr("forall(edits, x -> x.start >= 0 and x.start <= x.stop and x.stop <= length(text))")
    return F.when(F.col("edits").isNull() | (F.size("edits") == 0), F.col("text")).when(good, F.expr(whole))


def selected_fixes(fixes: DataFrame, wanted: list[str]) -> DataFrame:
    """Fixes of the rules that are wanted by key or by a prefix of it; all where none is named."""
    if not wanted:
        return fixes
    keep = F.lit(False)
    for w in wanted:
        keep = keep | F.col("rule_key").startswith(w)
    return fixes.where(keep)


def unified_diff(files: DataFrame, context: int = 3) -> DataFrame:
    """path, diff of the files (path, before, after) that differ: one hunk between the common first and last lines."""
    f = files.where(~F.col("before").eqNullSafe(F.col("after"))).withColumns({"a": F.split("before", "\n", -1), "b": F.split("after", "\n", -1)})
    same = "aggregate({seq}, 0, (n, i) -> if(n = i and {test}, n + 1, n))"
    short = "least(size(a), size(b))"
    f = f.withColumn("head", F.expr(same.format(seq=f"sequence(0, {short} - 1)", test="a[i] = b[i]")))
    tail = same.format(seq=f"if({short} > head, sequence(0, {short} - head - 1), cast(array() as array<int>))", test="a[size(a) - 1 - i] = b[size(b) - 1 - i]")
    f = f.withColumn("tail", F.expr(tail)).withColumn("lead", F.expr(f"least(head, {context})")).withColumn("trail", F.expr(f"least(tail, {context})"))
    cut = lambda x, start, n, mark: f"transform(slice({x}, {start}, {n}), l -> concat('{mark}', l))"
    rows = ", ".join([cut("a", "head - lead + 1", "lead", " "), cut("a", "head + 1", "size(a) - head - tail", "-"), cut("b", "head + 1", "size(b) - head - tail", "+"), cut("a", "size(a) - tail + 1", "trail", " ")])
    span = lambda x: f"concat(head - lead + 1, ',', size({x}) - head - tail + lead + trail)"
    title = f"concat('--- a/', path, '\n+++ b/', path, '\n@@ -', {span('a')}, ' +', {span('b')}, ' @@\n')"
    return f.select("path", F.expr(f"concat({title}, array_join(concat({rows}), '\n'))").alias("diff"))


def fix_outcome(before: DataFrame, after: DataFrame, targeted: DataFrame) -> DataFrame:
    """rule_key, resolved (min of before - after and targeted), regressed (more than before)."""
    count = lambda d, n: d.groupBy("rule_key").agg(F.count("*").alias(n))
    j = count(before, "b").join(count(after, "a"), "rule_key", "full").join(count(targeted, "t"), "rule_key", "left").na.fill(0, ["a", "b", "t"])
    return j.select("rule_key", F.greatest(F.least(F.col("b") - F.col("a"), F.col("t")), F.lit(0)).alias("resolved"), (F.col("a") > F.col("b")).alias("regressed"))
