"""Scalar functions on lines, paths, columns and digests, all built in."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line breaks by language family: LF everywhere; CR and CRLF in the second group; U+2028 and U+2029 in the third.
CR_LANGUAGES, UNICODE_BREAK_LANGUAGES = ("javascript", "typescript", "java"), ("javascript", "typescript")


def lines_of(text: Column, language: Column) -> Column:
    """Array of a text's lines; a closing break leaves an empty last line, an empty text has one line."""
    body = F.coalesce(text, F.lit(""))
    wide = F.split(body, "\r\n|\n|\r|\u2028|\u2029", -1)
    middle = F.split(body, "\r\n|\n|\r", -1)
    return F.when(language.isin(*UNICODE_BREAK_LANGUAGES), wide).when(language.isin(*CR_LANGUAGES), middle).otherwise(F.split(body, "\n", -1))


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ** spans folders, * and ? stay inside one."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(pattern[i], re.escape(pattern[i])))
            i += 1
    return "^" + "".join(out) + "$"


def any_glob(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)


def normal_path(path: Column) -> Column:
    """Forward slashes, no empty or . segments, .. resolved; null where it leaves the root."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("out"))
    folded = F.aggregate(
        parts,
        start,
        lambda a, p: F.when(
            p == "..",
            F.struct((a["ok"] & (F.size(a["out"]) > 0)).alias("ok"), F.slice(a["out"], 1, F.greatest(F.size(a["out"]) - 1, F.lit(0))).alias("out")),
        ).otherwise(F.struct(a["ok"].alias("ok"), F.concat(a["out"], F.array(p)).alias("out"))),
    )
    return F.when(folded["ok"], F.array_join(folded["out"], "/"))


def utf16_units(text: Column) -> Column:
    """Length in UTF-16 code units, as report columns count."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def line_checksum(line: Column) -> Column:
    """MD5 of a line in base64 without padding."""
    return F.regexp_replace(F.base64(F.unhex(F.md5(line))), "=+$", "")


def length_prefixed_sha256(*fields: Column) -> Column:
    """SHA-256 over fields that each follow their length in bytes as eight big-endian bytes."""
    parts = []
    for f in fields:
        b = F.coalesce(f.cast("string"), F.lit("")).cast("binary")
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(b).cast("long")), 16, "0")), b]
    return F.sha2(F.concat(*parts), 256)


def tenth_percent(covered: Column, eligible: Column) -> Column:
    """Per cent with one decimal, halves up, from whole tenths; null without a denominator."""
    c, e = covered.cast("decimal(38,0)"), eligible.cast("decimal(38,0)")
    return F.when(eligible > 0, F.floor((c * 1000 + F.floor(e / 2)) / e).cast("double") / 10)


_RFC3339 = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[Tt ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$"


def rfc3339(text: Column) -> Column:
    """(text, epoch) of a date and time with an offset: whole seconds in UTC, and seconds since 1970; null for anything else."""
    good = text.rlike(_RFC3339)
    clean = F.upper(F.regexp_replace(F.regexp_replace(text, r"\.[0-9]+", ""), " ", "T"))
    offset = F.regexp_extract(clean, r"([+-])([0-9]{2}):([0-9]{2})$", 0)
    minutes = F.when(offset == "", 0).otherwise(F.concat(F.substring(offset, 1, 1), (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 5, 2).cast("int")).cast("string")).cast("int"))
    day = F.try_to_date(F.substring(clean, 1, 10), "yyyy-MM-dd")
    seconds = F.substring(clean, 12, 2).cast("long") * 3600 + F.substring(clean, 15, 2).cast("long") * 60 + F.substring(clean, 18, 2).cast("long")
    epoch = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + seconds - minutes * 60
    shown = F.date_format(F.timestamp_seconds(epoch).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(good & day.isNotNull(), F.struct(shown.alias("text"), epoch.alias("epoch")))
