"""Personal data: regular expressions propose, checksums confirm, context words adjust the score.

Only built-in SQL functions run here. Patterns have possessive repeats (same matches, no deep
recursion on long runs), and look-behinds that spare restarts inside a run that has failed.
A null or empty text has no spans. Spans of one start come in the order of the kinds; repeated rows
give repeated results; columns with the names used here are left alone. Work on a text grows with
its length and with its matches to the power of 1.5.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_name, running, whole_text


@dataclass(frozen=True)
class Kind:
    """name, regex, a substring that any match holds, SQL test of a match ``m``, score, context words."""

    name: str
    pattern: str
    needs: str
    test: str
    score: float
    context: str


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
#: From the right, every second digit counts twice, less nine above nine.
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + (
    case when (length({_DIGITS}) - i) % 2 = 0 then int(substring({_DIGITS}, i, 1))
    else int(substring({_DIGITS}, i, 1)) * 2 - if(int(substring({_DIGITS}, i, 1)) > 4, 9, 0) end)) % 10 = 0"""
_PLAIN = "replace(m, ' ', '')"
#: ISO 13616: the first four characters go last, letters count 10 to 35, the rest by 97 is 1.
_MOD97 = f"""aggregate(sequence(1, length({_PLAIN})), 0, (a, i) ->
    case when substring(concat(substring({_PLAIN}, 5), substring({_PLAIN}, 1, 4)), i, 1) between '0' and '9'
    then (a * 10 + int(substring(concat(substring({_PLAIN}, 5), substring({_PLAIN}, 1, 4)), i, 1))) % 97
    else (a * 100 + ascii(substring(concat(substring({_PLAIN}, 5), substring({_PLAIN}, 1, 4)), i, 1)) - 55) % 97 end) = 1"""

BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "true", 0.9, "mail|contact|write"),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        ".",
        "forall(split(m, '[.]'), p -> length(regexp_replace(p, '^0+', '')) <= 3 and int(concat('0', right(p, 3))) <= 255)",
        0.6,
        "ip|address|host|server|login",
    ),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", f"length({_DIGITS}) between 12 and 19 and {_LUHN}", 0.7, "card|visa|credit|payment|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", f"length({_DIGITS}) between 9 and 15", 0.6, "phone|tel|call|mobile|fax|whatsapp"),
)
#: What the method adds.
ADDED = (Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", f"length({_PLAIN}) between 15 and 34 and {_MOD97}", 0.8, "iban|bank|account|konto|cuenta"),)
#: Characters before a span and after it, up to the next match of its kind, in which context words count, and what they add.
BEFORE, AFTER, BONUS = 40, 20, 0.2
#: Fields in the order of sorting: by start, then kind as listed.
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,m:string,score:double>>"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _placed(found: str, text: str, kind: Kind, rank: int) -> str:
    """SQL: the accepted matches of ``found`` with code point spans, by the lengths of the gaps between."""
    gaps = f"split({text}, {_quoted(kind.pattern)}, -1)"
    pairs = f"""transform(array({gaps}), gaps -> zip_with(zip_with(slice(gaps, 1, size({found})), {found}, (g, m) -> named_struct('g', g, 'm', m)), slice(gaps, 2, size({found})),
        (x, after) -> named_struct('g', length(x.g), 'm', x.m, 'n', length(x.m), 'near', lower(concat(right(x.g, {BEFORE}), ' ', left(after, {AFTER}))) rlike '{kind.context}')))[0]"""
    span = f"named_struct('start', acc + x.g, 'rank', {rank}, 'end', acc + x.g + x.n, 'kind', '{kind.name}', 'm', x.m, 'score', least(1D, {kind.score}D + if(x.near, {BONUS}D, 0D)))"
    every = f"transform(array({pairs}), pairs -> {running('pairs', _SPAN, '0', 'acc + x.g + x.n', 'acc + b', span, 'int')})[0]"
    return f"if(size({found}) = 0, cast(array() as {_SPAN}), filter({every}, s -> exists(array(s.m), m -> {kind.test})))"


def pii_spans(df: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """All columns and ``spans``: array of (start, rank, end, kind, m, score) by start, then kind as listed.

    Matches whose test fails go and aren't tried again; kinds may overlap.
    """
    kinds = (*BASE, *ADDED)
    body = own_name(df, "__text")
    out = df.withColumn(body, whole_text(text))
    found = {k.name: own_name(df, f"__found_{k.name}") for k in kinds}
    may = {k.name: f"contains({body}, '{k.needs}')" if k.needs else f"{body} rlike '[0-9][ -]?[0-9]'" for k in kinds}
    out = out.withColumns({found[k.name]: F.expr(f"if({may[k.name]}, regexp_extract_all({body}, {_quoted(k.pattern)}, 0), cast(array() as array<string>))") for k in kinds})
    placed = {found[k.name] + "_at": F.expr(_placed(found[k.name], body, k, i)) for i, k in enumerate(kinds)}
    out = out.withColumns(placed)
    out = out.withColumn(spans, F.expr(f"array_sort(concat({', '.join(placed)}))"))
    return out.drop(body, *found.values(), *placed)


def _listed(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def pii_digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans, max_score per row."""
    out = pii_spans(df.select(F.col(key).alias("k"), F.col(text).alias("t")), "t", "s")
    base = f"filter(s, s -> s.rank < {len(BASE)})"
    return out.select(
        F.col("k").alias(key),
        *(F.expr(f"cast(size(filter(s, s -> s.kind = '{k.name}')) as long)").alias(f"n_{k.name}") for k in BASE),
        F.expr(f"sha2({_listed(base)}, 256)").alias("base_sha256"),
        F.expr(_listed("s")).alias("spans"),
        F.expr("coalesce(array_max(transform(s, s -> s.score)), 0D)").alias("max_score"),
    )


def redacted(text: Column | str, spans: str) -> Column:
    """The text with every span as its kind in brackets; overlapping spans share the first one's.

    The text is cut into pieces for blocks of spans first, then within each piece.
    """
    kind = "array<struct<start:int,end:int,kind:string,at:int>>"
    every = running(spans, kind, "0", "greatest(acc, x.end)", "greatest(acc, b)", "named_struct('start', x.start, 'end', x.end, 'kind', upper(x.kind), 'at', acc)", "int")
    width = "cast(ceil(sqrt(size(kept))) as int)"
    blocks = f"transform(sequence(0, cast(ceil(size(kept) / {width}) as int) - 1), i -> slice(kept, i * {width} + 1, {width}))"
    inner = f"""transform(array(named_struct('part', substring({text}, block[0].at + 1, element_at(block, -1).start - block[0].at), 'from', block[0].at)),
        p -> array_join(transform(block, s -> concat(substring(p.part, s.at - p.from + 1, s.start - s.at), '[', s.kind, ']')), ''))[0]"""
    whole = f"concat(array_join(transform({blocks}, block -> {inner}), ''), substring({text}, array_max({spans}.end) + 1))"
    return F.expr(f"if(size({spans}) = 0, {text}, transform(array(filter({every}, s -> s.start >= s.at)), kept -> {whole})[0])")
