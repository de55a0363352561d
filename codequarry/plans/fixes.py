"""Fixes of findings as text edits: planned, freed of conflicts, applied and checked by running the rules again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folds import running
from ..operators import lexical_rules
from ..operators.fixpoint import durable
from . import reports

#: Rule, languages, what it looks like in the finding's text, and what it becomes; keys and forms that need no choice.
BUILDERS = (
    ("S1116", "javascript typescript csharp rust", r"^;[ \t]*;$", ";"),
    ("S1656", "javascript typescript csharp go rust", r"^.*$", ""),
    ("S2092", "javascript typescript", r"\bfalse$", "true"),
    ("S2092", "csharp", r"\bfalse$", "true"),
    ("S3330", "javascript typescript", r"\bfalse$", "true"),
    ("S3330", "csharp", r"\bfalse$", "true"),
    ("S4830", "javascript typescript", r"\bfalse$", "true"),
    ("S1125", "javascript typescript csharp go", r"^[ ]*==?=[ ]*true$", ""),
    ("S5542", "csharp", r"\bECB$", "CBC"),
    ("S4423", "csharp", r"\.(?:Ssl2|Ssl3|Tls|Tls11)$", ".Tls12"),
    ("G301", "go", r"^(0[oO]?).*$", "$1750"),
    ("G302", "go", r"^(0[oO]?).*$", "$1600"),
    ("G306", "go", r"^(0[oO]?).*$", "$1600"),
    ("G403", "go", r"^.*$", "2048"),
    ("no-async-promise-executor", "javascript typescript", r"^async$", ""),
    ("S1309", "python", r"[ \t]*#.*$", ""),
    ("S1291", "javascript typescript", r"^//.*$", ""),
)

def fixable() -> list[str]:
    return sorted({b[0] for b in BUILDERS})


def planned(files: DataFrame, findings: DataFrame) -> DataFrame:
    """path, rule_key, start, stop, replacement of the findings that have a fix, in characters of the file.

    ``files`` has path, language, text; findings lie on one line of it. Files join with their own
    findings, so that no text meets those of another.
    """
    one = findings.where((F.col("sl") == F.col("el")) & (F.col("sl") > 0)).select("path", "rule_key", "sl", "sc", "ec")
    grouped = one.groupBy("path").agg(F.collect_list(F.struct("rule_key", "sl", "sc", "ec")).alias("hits"))
    f = files.join(grouped, "path").withColumn("lines", F.split("text", "\n", -1))
    f = f.withColumn("sizes", F.expr("transform(lines, l -> length(l) + 1)"))
    f = f.withColumn("begin", F.expr(running("sizes", "array<int>", "0", "acc + x", "acc + b", "array(acc)[0]", "int")))
    h = f.select("path", "language", "lines", "begin", F.explode("hits").alias("h")).select("path", "language", "h.rule_key", (F.col("begin")[F.col("h.sl") - 1] + F.col("h.sc")).alias("start"), F.expr("substring(lines[h.sl - 1], h.sc + 1, h.ec - h.sc)").alias("old"))
    new = F.lit(None).cast("string")
    for key, languages, pattern, replacement in BUILDERS:
        fits = (F.col("rule_key") == key) & F.col("language").isin(*languages.split()) & F.col("old").rlike(pattern)
        new = F.when(fits, F.regexp_replace("old", pattern, replacement)).otherwise(new)
    return h.withColumn("replacement", new).where("replacement is not null").select("path", "rule_key", "start", (F.col("start") + F.length("old")).cast("int").alias("stop"), "replacement")


def fixed(files: DataFrame, findings: DataFrame, wanted: tuple[str, ...] = ()) -> DataFrame:
    """path, language, text (fixed), edits, conflicts of the files with fixes of the wanted rules."""
    chosen = reports.chosen_edits(reports.selected_fixes(planned(files, findings), list(wanted)))
    return files.select("path", "language", "text").join(chosen, "path").select("path", "language", reports.edited().alias("text"), F.size("edits").alias("edits"), "conflicts")


def replanned(files: DataFrame, wanted: tuple[str, ...] = ()) -> DataFrame:
    """path, language, text, edits, rounds of files that get fixes: fixed, analysed and fixed again until nothing is left to fix.

    Only files that a round has changed go on, so that what was in conflict, or comes out by a fix, gets its turn. Fixes that
    bring each other back are an error after as many rounds as there were findings.
    """
    todo = files.select("path", "language", "text").withColumns({"edits": F.lit(0), "rounds": F.lit(0)})
    done, most = None, None
    while True:
        found = lexical_rules.lexical_findings(todo.select("path", "language", "text"))
        out = fixed(todo.select("path", "language", "text"), found, wanted).select("path", F.col("text").alias("now"), F.col("edits").alias("more"))
        both = durable(todo.join(out, "path", "left"))
        ended = both.where("now is null and rounds > 0").select("path", "language", "text", "edits", "rounds")
        done = ended if done is None else done.unionByName(ended)
        todo = both.where("now is not null").select("path", "language", F.col("now").alias("text"), (F.col("edits") + F.col("more")).alias("edits"), (F.col("rounds") + 1).alias("rounds"))
        if todo.isEmpty():
            return done
        most = most or found.count()
        if todo.agg(F.max("rounds")).first()[0] > most:
            raise ValueError("fixes bring each other back")


def verified(files: DataFrame, wanted: tuple[str, ...] = ()) -> DataFrame:
    """path, accepted, before, after, edits: a file's fixes are accepted if its findings became fewer and no rule has more than before."""
    # written once each: counts, plans and the second analysis read them
    before = durable(lexical_rules.lexical_findings(files).drop("message"))
    out = durable(fixed(files, before, wanted))
    after = lexical_rules.lexical_findings(out.select("path", "language", "text"))
    count = lambda d, n: d.groupBy("path", "rule_key").agg(F.count("*").alias(n))
    both = count(before, "b").join(count(after, "a"), ["path", "rule_key"], "full").na.fill(0, ["a", "b"])
    per_file = both.groupBy("path").agg(F.sum("b").alias("before"), F.sum("a").alias("after"), F.bool_or(F.col("a") > F.col("b")).alias("worse"))
    return out.join(per_file, "path").select("path", ((F.col("after") < F.col("before")) & ~F.col("worse")).alias("accepted"), "before", "after", "edits")
