"""Line facts, size measures, completeness, and rules that look at lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines_of

#: Limits of the line rules. Fixed values.
LINE_LENGTH, FILE_LINES = 120, 1000


def line_table(files: DataFrame) -> DataFrame:
    """path, language, line_no (from 1), line of the files (path, language, text)."""
    return files.select("path", "language", F.posexplode(lines_of(F.col("text"), F.col("language"))).alias("at", "line")).select("path", "language", (F.col("at") + 1).alias("line_no"), "line")


#: Languages with comments after #, and with comments of markup; all others have those of C. Fixed values.
HASH_LANGUAGES, MARKUP_LANGUAGES = ("python", "ruby"), ("html",)


def _counts(opening: str, closing: str, single: str) -> str:
    """SQL: (inside, code, comment) after a fold over a file's lines.

    A line with any code is a code line; a block comment opens only where no code stands before it,
    and what follows its end counts again.
    """
    regex = lambda x: x.replace("*", "[*]")
    text = r"regexp_replace(x, '^\\s+|\\s+$', '')"
    rest = "t"
    if opening:
        body = f"if(acc.inside, if(instr(t, '{closing}') > 0, ltrim(substring(t, instr(t, '{closing}') + {len(closing)})), null), t)"
        rest = f"regexp_replace({body}, '^(?:{regex(opening)}.*?{regex(closing)}\\\\s*)+', '')"
    opens = f"startswith(r, '{opening}')" if opening else "false"
    marked = f"startswith(r, '{single}')" if single else "false"
    code = f"coalesce(r <> '' and not {opens} and not {marked}, false)"
    step = f"named_struct('inside', coalesce({opens}, true), 'code', acc.code + if({code}, 1L, 0L), 'comment', acc.comment + if({code}, 0L, 1L))"
    return f"aggregate(__lines, named_struct('inside', false, 'code', 0L, 'comment', 0L), (acc, x) -> transform(array({text}), t -> if(t = '', acc, transform(array({rest}), r -> {step})[0]))[0])"


def file_metrics(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, language, lines, code_lines, comment_lines and the ``keep`` columns of each file, without moving a line between tasks.

    Comment lines are those that hold nothing else; blank lines are neither.
    """
    counts = F.when(F.col("language").isin(*HASH_LANGUAGES), F.expr(_counts("", "", "#"))).when(F.col("language").isin(*MARKUP_LANGUAGES), F.expr(_counts("<!--", "-->", ""))).otherwise(F.expr(_counts("/*", "*/", "//")))
    out = files.withColumn("__lines", lines_of(F.col("text"), F.col("language"))).withColumn("__counts", counts)
    return out.select("path", "language", *keep, F.size("__lines").cast("long").alias("lines"), F.col("__counts.code").alias("code_lines"), F.col("__counts.comment").alias("comment_lines"))


def project_totals(inventory: DataFrame) -> DataFrame:
    """Totals per language of complete source files; ``complete`` is false if any source or test file failed, and
    totals stand for what could be measured."""
    measured = (F.col("class") == "source") & (F.col("status") == "complete")
    return inventory.groupBy("language").agg(
        F.count_if(measured).alias("files"),
        *(F.coalesce(F.sum(F.when(measured, F.col(c))), F.lit(0)).cast("long").alias(c) for c in ("lines", "code_lines", "comment_lines")),
        F.coalesce(F.bool_and(F.when(F.col("class").isin("source", "test"), F.col("status") == "complete")), F.lit(True)).alias("complete"),
    )


def line_findings(files: DataFrame, line_length: int = LINE_LENGTH, file_lines: int = FILE_LINES, details: bool = False, context: int = 2) -> DataFrame:
    """Findings of the rules on lines in one pass over each file's lines; only lines with a finding leave the file.

    S103 long lines, S105 tabs, S1131 closing white space, S1134 and S1135 task tags; per file
    S104 too many lines and S113 no final line break (empty files are exempt). With ``details`` come
    ``source``, the finding's line, and ``context``, its surroundings; both are empty for whole files.
    """

    def hits(line: Column) -> Column:
        size, kept = F.length(line), F.length(F.rtrim(line))
        none = F.lit(None).cast("struct<rule_key:string,sc:int,ec:int>")

        def hit(key: str, where: Column, start: Column, end: Column) -> Column:
            return F.when(where, F.struct(F.lit(key).alias("rule_key"), start.cast("int").alias("sc"), end.cast("int").alias("ec"))).otherwise(none)

        def tag(key: str, word: str) -> Column:
            found = F.regexp_instr(line, F.lit(rf"(?i)(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])"))
            return hit(key, found > 0, found - 1, found - 1 + len(word))

        tab = F.instr(line, "\t")
        return F.array_compact(F.array(hit("S103", size > line_length, F.lit(0), size), hit("S105", tab > 0, tab - 1, tab), hit("S1131", kept < size, kept, size), tag("S1134", "fixme"), tag("S1135", "todo")))

    f = files.select("path", F.coalesce("text", F.lit("")).alias("text"), lines_of(F.col("text"), F.col("language")).alias("lines"))
    rows = F.filter(F.transform("lines", lambda x, i: F.struct((i + 1).alias("sl"), x.alias("source"), hits(x).alias("hits"))), lambda r: F.size(r["hits"]) > 0)
    around = F.transform("rows", lambda r: F.struct(*(r[c].alias(c) for c in ("sl", "source", "hits")), F.array_join(F.slice("lines", F.greatest(r["sl"] - context, F.lit(1)), r["sl"] + context - F.greatest(r["sl"] - context, F.lit(1)) + 1), "\n").alias("context")))
    f = f.withColumn("rows", rows)
    # the outer forms keep the optimizer from filters that would work out the arrays anew
    found = f.select("path", F.explode_outer(around if details else F.col("rows")).alias("r")).where("r is not null").select("path", "r.*")
    more = ("source", "context") if details else ()
    on_lines = found.select("path", "sl", *more, F.explode("hits").alias("h")).select("path", "h.rule_key", "sl", "h.sc", F.col("sl").alias("el"), "h.ec", *more)
    whole = F.array(F.when(F.size("lines") > file_lines, F.lit("S104")), F.when((F.col("text") != "") & ~F.col("text").endswith("\n"), F.lit("S113")))
    zero, empty = F.lit(0), (F.lit("").alias(c) for c in more)
    on_files = f.select("path", F.explode(F.array_compact(whole)).alias("rule_key")).select("path", "rule_key", zero.alias("sl"), zero.alias("sc"), zero.alias("el"), zero.alias("ec"), *empty)
    return on_lines.unionByName(on_files)


def canonical_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", "sl", "sc", "el", "ec", "rule_key", *(c for c in ("message",) if c in findings.columns))


#: The classes of files in the order of reports. Fixed values.
CLASS_ORDER = ("source", "test", "generated", "vendor", "excluded")


def class_rank(column: str = "class") -> Column:
    return F.array_position(F.array(*map(F.lit, CLASS_ORDER)), F.col(column)).cast("int") - 1


def project_order(inventory: DataFrame) -> DataFrame:
    """Files by path, then by class."""
    return inventory.orderBy("path", class_rank())


def histogram(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_key").agg(F.count("*").alias("findings"), F.count_distinct("path").alias("files"))


def active(findings: DataFrame, rules: DataFrame, profile_rank: int) -> DataFrame:
    """Findings of rules whose least profile is included and that aren't retired hotspots; test files get no MAIN-only rules."""
    kept = rules.where((F.col("profile") <= profile_rank) & ~((F.col("status") == "DEPRECATED") & (F.col("rule_type") == "SECURITY_HOTSPOT"))).select("rule_key", "scope")
    return findings.join(kept, "rule_key").where((F.col("scope") != "MAIN") | (F.col("class") != "test")).drop("scope")


def deduplicated(findings: DataFrame, exempt: tuple[str, ...] = ("java",)) -> DataFrame:
    """Equal findings once, but as often as they come in the exempt languages."""
    some = findings.where(F.col("language").isin(*exempt))
    return findings.where(~F.col("language").isin(*exempt)).dropDuplicates().unionByName(some)


def repeated_words(files: DataFrame, least_length: int = 10, least: int = 3) -> DataFrame:
    """Literals repeated in a file (rule S1192): path, literal, n."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\n\r]+"), lambda w: F.length(w) >= least_length)
    return files.select("path", F.explode(words).alias("literal")).groupBy("path", "literal").agg(F.count("*").alias("n")).where(F.col("n") >= least)
