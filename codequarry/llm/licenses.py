"""Licence scans: ordered signature rules behind a keyword prefilter, with containment suppression.

Only built-in SQL functions run here. A text goes through the rules whose keywords it holds; the
detections are swept in order of start, and one that lies inside another of equal or higher
priority goes; of two on the same words and of one priority the earlier rule's stays. A null or
empty text has no words, no places and no labels; work on a text grows with its length and its
matches, not with their square; repeated rows give repeated results; columns with the names used
here are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_name, running, whole_text

#: A character of a word and what separates words, before the lower-casing of A-Z.
_W = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_G = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases of the base and their labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def _words(phrase: str) -> str:
    return _G.join(phrase.split(" "))


_BASE = rf"(?i)(?<!{_W})(?:{'|'.join(_words(p) for p, _ in BASE_PHRASES)})(?!{_W})"

#: Signatures in order: keyword (a part of every text that matches) -> (priority, label, regular expression over lower-case
#: words that one space joins). Priority 4 is for licence texts and SPDX tags, 3 for notices, 2 for full names, 1 for hints.
#: The earlier of two signatures of one priority wins where both match the same words.
SIGNATURES = {
    "spdx": (
        (4, "mit", "spdx license identifier mit(?: 0)?"),
        (4, "apache-2.0", "spdx license identifier apache 2 0"),
        (4, "bsd-2-clause", "spdx license identifier bsd 2 clause(?: patent| views)?"),
        (4, "bsd-3-clause", "spdx license identifier bsd 3 clause(?: clear| lbnl)?"),
        (4, "0bsd", "spdx license identifier 0bsd"),
        (4, "agpl-3.0", "spdx license identifier agpl 3 0(?: only| or later)?"),
        (4, "lgpl-2.1", "spdx license identifier lgpl 2 1(?: only| or later)?"),
        (4, "lgpl-3.0", "spdx license identifier lgpl 3 0(?: only| or later)?"),
        (4, "gpl-2.0", "spdx license identifier gpl 2 0(?: only| or later)?"),
        (4, "gpl-3.0", "spdx license identifier gpl 3 0(?: only| or later)?"),
        (4, "mpl-2.0", "spdx license identifier mpl 2 0"),
        (4, "epl-2.0", "spdx license identifier epl 2 0"),
        (4, "isc", "spdx license identifier isc"),
        (4, "zlib", "spdx license identifier zlib"),
        (4, "unlicense", "spdx license identifier unlicense"),
        (4, "cc0-1.0", "spdx license identifier cc0 1 0"),
        (4, "cc-by-sa", "spdx license identifier cc by sa [1-4] [05]"),
        (4, "cc-by", "spdx license identifier cc by [1-4] [05]"),
        (4, "bsl-1.0", "spdx license identifier bsl 1 0"),
        (4, "eupl-1.2", "spdx license identifier eupl 1 2"),
        (1, "spdx", "spdx license identifier [^ ]+"),
    ),
    "hereby granted": (
        (4, "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
        (4, "bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
        (4, "ofl-1.1", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
        (4, "hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
        (4, "postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
        (4, "isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
        (3, "mit", "permission is hereby granted free of charge to any person obtaining a copy"),
        (1, "permission", "permission is hereby granted"),
    ),
    "the above copyright notice": (
        (4, "mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
        (4, "isc", "provided that the above copyright notice and this permission notice appear in all copies"),
        (3, "bsd", "redistributions of source code must retain the above copyright notice"),
        (3, "bsd", "redistributions in binary form must reproduce the above copyright notice"),
    ),
    "redistribution and use": (
        (4, "bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
        (3, "bsd", "redistribution and use in source and binary forms"),
    ),
    "endorse or promote": (
        (4, "bsd-3-clause", "neither the names? of .{1,80} may be used to endorse or promote products derived from this software"),
        (3, "bsd-3-clause", "may be used to endorse or promote products"),
    ),
    "advertising materials": ((4, "bsd-4-clause", "all advertising materials mentioning features or use of this software must display"),),
    "provided as is": (
        (4, "mit", "the software is provided as is without warranty of any kind express or implied"),
        (4, "zlib", "this software is provided as is without any express or implied warranty"),
        (4, "isc", "the software is provided as is and the author disclaims all warranties"),
        (1, "warranty", "(?:is |are )?provided as is"),
    ),
    "contributors as is": ((4, "bsd", "this software is provided by the copyright holders and contributors as is"),),
    "as is basis": ((3, "apache-2.0", "distributed on an as is basis without warranties or conditions of any kind"), (1, "warranty", "on an as is basis")),
    "misrepresented": (
        (4, "zlib", "the origin of this software must not be misrepresented"),
        (4, "zlib", "must not be misrepresented as being the original software"),
    ),
    "unencumbered": ((4, "unlicense", "this is free and unencumbered software released into the public domain"),),
    "beerware": ((4, "beerware", "the beerware licen[cs]e(?: revision 42)?"), (2, "beerware", "beerware")),
    "want to public": ((4, "wtfpl", "do what the (?:fuck|f [^ ]+) you want to public licen[cs]e"),),
    "wtfpl": ((2, "wtfpl", "wtfpl(?: version)?(?: 2)?"),),
    "unlicense": ((3, "unlicense", "(?:released|licensed|placed) under the unlicense"), (2, "unlicense", "(?:the )?unlicense")),
    "public domain": (
        (3, "public-domain", "(?:placed|released|dedicated|put) (?:in|into|to) the public domain"),
        (3, "cc0-1.0", "creative commons (?:zero|cc0)(?: 1 0)?(?: universal)? public domain dedication"),
        (3, "pddl-1.0", "public domain dedication and licen[cs]e"),
        (2, "public-domain", "(?:is|are) in the public domain"),
        (1, "public-domain", "public domain"),
    ),
    "apache": (
        (4, "apache-2.0", "licensed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e"),
        (4, "apache-2.0", "http www apache org licen[cs]es licen[cs]e 2 0"),
        (3, "apache-2.0", "licen[cs]ed (?:to you )?under (?:the )?(?:terms of the )?apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?"),
        (3, "apache-1.1", "licen[cs]ed under (?:the )?apache(?: software)? licen[cs]e(?: version)? 1 1"),
        (3, "apache-2.0", "(?:released|published|distributed|available|provided) under (?:the )?(?:terms of the )?apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?"),
        (2, "apache-2.0", "apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?"),
        (2, "apache-2.0", "apache 2(?: 0)?(?: licen[cs]e)?"),
        (2, "apache-1.1", "apache(?: software)? licen[cs]e(?: version)? 1 1"),
        (1, "apache", "apache licen[cs]e"),
    ),
    "mit license": (
        (3, "mit", "licen[cs]ed under (?:the )?(?:terms of the )?mit license"),
        (3, "mit", "(?:released|published|distributed|available|provided) under (?:the )?(?:terms of the )?mit license"),
        (3, "mit", "subject to the (?:terms of the )?mit license"),
        (2, "mit", "(?:the )?mit license(?: mit)?"),
    ),
    "mit licence": ((3, "mit", "under (?:the )?(?:terms of the )?mit licence"), (2, "mit", "mit licence")),
    "license mit": ((2, "mit", "license mit"),),
    "massachusetts institute": ((2, "mit", "massachusetts institute of technology licen[cs]e"), (1, "mit", "massachusetts institute of technology")),
    "bsd": (
        (3, "bsd-3-clause", "under (?:the |a )?(?:terms of the )?(?:3 clause|three clause|new|modified|revised) bsd licen[cs]e"),
        (3, "bsd-2-clause", "under (?:the |a )?(?:terms of the )?(?:2 clause|two clause|simplified) bsd licen[cs]e"),
        (3, "bsd", "under (?:the |a )?(?:terms of the )?bsd(?: style)? licen[cs]e"),
        (2, "bsd-3-clause", "bsd (?:3|three) clause(?: licen[cs]e)?"),
        (2, "bsd-2-clause", "bsd (?:2|two) clause(?: licen[cs]e)?"),
        (2, "bsd-3-clause", "(?:new|modified|revised|3 clause) bsd(?: licen[cs]e)?"),
        (2, "bsd-2-clause", "(?:simplified|2 clause|freebsd) bsd(?: licen[cs]e)?"),
        (2, "0bsd", "(?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)?"),
        (2, "bsd-2-clause", "freebsd licen[cs]e"),
        (2, "bsd", "bsd(?: style)? licen[cs]e"),
    ),
    "berkeley software": ((2, "bsd", "berkeley software distribution licen[cs]e"), (1, "bsd", "berkeley software distribution")),
    "affero": (
        (4, "agpl-3.0", "gnu affero general public licen[cs]e as published by the free software foundation"),
        (3, "agpl-3.0", "under (?:the )?(?:terms of the )?gnu affero general public licen[cs]e"),
        (2, "agpl-3.0", "gnu affero general public licen[cs]e(?: v| version)? ?3"),
        (2, "agpl", "affero general public licen[cs]e"),
    ),
    "agpl": ((3, "agpl-3.0", "under (?:the )?(?:terms of the )?(?:gnu )?agpl ?v?3"), (2, "agpl-3.0", "agpl ?v?3(?: 0)?(?: only| or later)?"), (1, "agpl", "agpl")),
    "lesser general public": (
        (4, "lgpl", "gnu lesser general public licen[cs]e as published by the free software foundation"),
        (3, "lgpl-2.1", "under (?:the )?(?:terms of the )?gnu lesser general public licen[cs]e(?: v| version) ?2 1"),
        (3, "lgpl-3.0", "under (?:the )?(?:terms of the )?gnu lesser general public licen[cs]e(?: v| version) ?3"),
        (2, "lgpl-2.1", "(?:gnu )?lesser general public licen[cs]e(?: v| version)? ?2 1"),
        (2, "lgpl-3.0", "(?:gnu )?lesser general public licen[cs]e(?: v| version)? ?3"),
        (2, "lgpl", "(?:gnu )?lesser general public licen[cs]e"),
    ),
    "library general public": ((2, "lgpl-2.0", "gnu library general public licen[cs]e(?: version)?(?: 2)?"),),
    "lgpl": ((2, "lgpl-2.1", "lgpl ?v?2 1(?: only| or later)?"), (2, "lgpl-3.0", "lgpl ?v?3(?: 0)?(?: only| or later)?"), (2, "lgpl", "gnu lgpl"), (1, "lgpl", "lgpl")),
    "general public license": (
        (4, "gpl-2.0", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
        (4, "gpl-3.0", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
        (4, "gpl", "gnu general public license as published by the free software foundation"),
        (4, "gpl", "you should have received a copy of the gnu general public license"),
        (3, "gpl-2.0", "under (?:the )?(?:terms of the )?gnu general public license(?: v| version) ?2"),
        (3, "gpl-3.0", "under (?:the )?(?:terms of the )?gnu general public license(?: v| version) ?3"),
        (3, "gpl", "under (?:the )?(?:terms of the )?gnu general public license"),
        (2, "gpl-2.0", "(?:gnu )?general public license(?: v| version)? ?2(?: 0)?"),
        (2, "gpl-3.0", "(?:gnu )?general public license(?: v| version)? ?3(?: 0)?"),
        (2, "gpl", "gnu general public license"),
    ),
    "gpl": (
        (3, "gpl-2.0", "under (?:the )?(?:terms of the )?(?:gnu )?gpl ?v?2(?: 0)?(?: only| or later)?"),
        (3, "gpl-3.0", "under (?:the )?(?:terms of the )?(?:gnu )?gpl ?v?3(?: 0)?(?: only| or later)?"),
        (3, "gpl", "(?:licen[cs]ed|released|published|distributed) under (?:the )?(?:gnu )?gpl"),
        (2, "gpl-2.0", "(?:gnu )?gpl ?v?2(?: 0)?(?: only| or later)?"),
        (2, "gpl-3.0", "(?:gnu )?gpl ?v?3(?: 0)?(?: only| or later)?"),
        (2, "gpl", "gnu gpl"),
    ),
    "free documentation": ((3, "fdl-1.3", "under the terms of the gnu free documentation licen[cs]e"), (2, "fdl-1.3", "gnu free documentation licen[cs]e(?: version)?(?: 1 [0-3])?")),
    "mozilla public": (
        (4, "mpl-2.0", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
        (3, "mpl-2.0", "(?:under|subject to) the (?:terms of the )?mozilla public licen[cs]e(?: v| version)? ?2(?: 0)?"),
        (2, "mpl-2.0", "mozilla public licen[cs]e(?: v| version)? ?2(?: 0)?"),
        (2, "mpl-1.1", "mozilla public licen[cs]e(?: v| version)? ?1 1"),
        (1, "mpl", "mozilla public licen[cs]e"),
    ),
    "mpl": ((2, "mpl-2.0", "mpl ?v?2(?: 0)?"), (2, "mpl-1.1", "mpl ?v?1 1")),
    "eclipse": (
        (3, "epl-2.0", "under the terms of the eclipse public licen[cs]e(?: v| version)? ?2 0"),
        (3, "epl-1.0", "under the terms of the eclipse public licen[cs]e(?: v| version)? ?1 0"),
        (2, "epl-2.0", "eclipse public licen[cs]e(?: v| version)? ?2(?: 0)?"),
        (2, "epl-1.0", "eclipse public licen[cs]e(?: v| version)? ?1(?: 0)?"),
        (2, "edl-1.0", "eclipse distribution licen[cs]e(?: v| version)?(?: 1 0)?"),
        (1, "epl", "eclipse public licen[cs]e"),
    ),
    "common development": ((2, "cddl-1.0", "common development and distribution licen[cs]e(?: version)?(?: 1 [01])?"),),
    "cddl": ((2, "cddl-1.0", "cddl(?: v)?(?: 1 [01])?"),),
    "creative commons": (
        (3, "cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?"),
        (3, "cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?"),
        (3, "cc-by-sa", "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?"),
        (3, "cc-by-nc", "creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?"),
        (3, "cc-by-nd", "creative commons attribution no ?deriv(?:s|atives)(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?"),
        (3, "cc-by", "creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?"),
        (2, "cc0-1.0", "creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?"),
        (1, "cc", "creative commons(?: licen[cs]e)?"),
    ),
    "cc by": (
        (2, "cc-by-nc-sa", "cc by nc sa(?: [1-4] [05])?"),
        (2, "cc-by-nc-nd", "cc by nc nd(?: [1-4] [05])?"),
        (2, "cc-by-sa", "cc by sa(?: [1-4] [05])?"),
        (2, "cc-by-nc", "cc by nc(?: [1-4] [05])?"),
        (2, "cc-by-nd", "cc by nd(?: [1-4] [05])?"),
        (2, "cc-by-4.0", "cc by 4 0"),
        (2, "cc-by-3.0", "cc by 3 0"),
    ),
    "cc0": ((2, "cc0-1.0", "cc0(?: 1 0)?(?: universal)?"),),
    "isc license": ((3, "isc", "under (?:the )?(?:terms of the )?isc license"), (2, "isc", "(?:the )?isc license")),
    "internet systems consortium": ((1, "isc", "internet systems consortium"),),
    "zlib": ((2, "zlib", "zlib(?: libpng)? licen[cs]e"),),
    "boost software": ((4, "bsl-1.0", "distributed under the boost software licen[cs]e version 1 0"), (2, "bsl-1.0", "boost software licen[cs]e(?: version)?(?: 1 0)?")),
    "business source": ((3, "busl-1.1", "(?:licen[cs]ed|released) under the business source licen[cs]e"), (2, "busl-1.1", "business source licen[cs]e(?: 1 1)?")),
    "artistic": ((3, "artistic-2.0", "under the (?:terms of the )?artistic licen[cs]e(?: 2 0)?"), (2, "artistic-2.0", "artistic licen[cs]e 2 0"), (2, "artistic-1.0", "(?:perl )?artistic licen[cs]e")),
    "open font": ((3, "ofl-1.1", "under the sil open font licen[cs]e(?: version 1 1)?"), (2, "ofl-1.1", "(?:sil )?open font licen[cs]e(?: version)?(?: 1 1)?")),
    "european union public": ((2, "eupl-1.2", "european union public licen[cs]e(?: v)?(?: 1 [12])?"),),
    "eupl": ((2, "eupl-1.2", "eupl(?: v)?(?: 1 [12])?"),),
    "open database": ((2, "odbl-1.0", "open database licen[cs]e(?: v)?(?: 1 0)?"),),
    "odbl": ((2, "odbl-1.0", "odbl(?: 1 0)?"),),
    "pddl": ((2, "pddl-1.0", "pddl(?: 1 0)?"),),
    "python software foundation": ((2, "psf-2.0", "python software foundation licen[cs]e(?: version)?(?: 2)?"),),
    "php license": ((2, "php-3.01", "php license(?: version)?(?: 3 01)?"),),
    "openssl": ((2, "openssl", "openssl licen[cs]e"), (1, "openssl", "developed by the openssl project")),
    "postgresql": ((2, "postgresql", "postgresql licen[cs]e"),),
    "ncsa": ((2, "ncsa", "(?:university of illinois )?ncsa open source licen[cs]e"),),
    "microsoft": (
        (2, "ms-pl", "microsoft public licen[cs]e"),
        (2, "ms-rl", "microsoft reciprocal licen[cs]e"),
        (3, "proprietary", "microsoft software licen[cs]e terms"),
    ),
    "server side public": ((3, "sspl-1.0", "(?:under|subject to) the (?:terms of the )?server side public licen[cs]e"), (2, "sspl-1.0", "server side public licen[cs]e(?: v)?(?: 1)?")),
    "elastic license": ((3, "elastic-2.0", "(?:under|subject to) the elastic license(?: 2 0)?"), (2, "elastic-2.0", "elastic license(?: v| version)?(?: 2(?: 0)?)?")),
    "openrail": ((2, "openrail", "(?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?"),),
    "vim license": ((2, "vim", "vim license"),),
    "upl": ((2, "upl-1.0", "universal permissive licen[cs]e(?: upl)? ?(?:v|version)? ?1 0 upl"), (2, "upl-1.0", "upl 1 0")),
    "universal permissive": ((2, "upl-1.0", "universal permissive licen[cs]e"),),
    "blue oak": ((2, "blueoak-1.0.0", "blue oak model licen[cs]e(?: 1 0 0)?"),),
    "academic free": ((2, "afl-3.0", "academic free licen[cs]e(?: v| version)? ?(?:3 0)?"),),
    "open software license": ((2, "osl-3.0", "open software license(?: v| version)? ?(?:3 0)?"),),
    "mulan": ((2, "mulanpsl-2.0", "mulan permissive software licen[cs]e(?: version 2)?"), (1, "mulanpsl-2.0", "mulan psl(?: v2)?")),
    "proprietary": (
        (3, "proprietary", "this (?:software|file|document|code) is (?:the )?(?:confidential and )?proprietary"),
        (2, "proprietary", "proprietary and confidential"),
        (2, "proprietary", "confidential and proprietary"),
        (1, "proprietary", "proprietary licen[cs]e"),
    ),
    "unauthorized": ((3, "proprietary", "unauthorized (?:copying|use|reproduction|distribution)(?: or distribution)? of this (?:file|software|document|work)"), (2, "proprietary", "unauthorized (?:copying|reproduction) is (?:strictly )?prohibited")),
    "may be reproduced": ((3, "proprietary", "no part of this (?:publication|work|document|book) may be reproduced"),),
    "copyright": ((1, "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]"), (1, "copyright", "copyright holders?")),
    "dual licensed": ((3, "dual", "dual licensed under"),),
    "terms and conditions": ((1, "terms", "terms and conditions for use reproduction and distribution"),),
}


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    priority: int
    pattern: str


def rules() -> list[Rule]:
    """The signatures in order."""
    return [Rule(label, key, n, pattern) for key, found in SIGNATURES.items() for n, label, pattern in found]


_HIT = "array<struct<start:int,stop:int,priority:int,rank:int,label:string>>"
_EDGES = "struct<e1:int,e2:int,e3:int,e4:int>"


#: The signatures with their places in the order.
_RANKED: dict[str, list[tuple[int, int, str, str]]] = {}
for _rank, (_key, _found) in enumerate((k, x) for k, found in SIGNATURES.items() for x in found):
    _RANKED.setdefault(_key, []).append((_rank, *_found))
#: Words that stand for a keyword which is part of longer ones; any other keyword goes by its longest word.
_FORMS = {"bsd": ("bsd", "0bsd"), **{k: tuple(k + v + n for v in ("", "v") for n in ("", "1", "2", "3") if n or not v) for k in ("gpl", "lgpl", "agpl", "mpl")}}
#: One of these is among the words of every text that a rule can match.
_GATE = sorted({w for k in SIGNATURES for w in _FORMS.get(k, (max(k.split(" "), key=lambda x: (len(x), x)),))})


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _count(text: str) -> str:
    """SQL: how many words; the separators cut, empty ends don't count."""
    return f"size(filter(split({text}, {_q(_G)}, -1), w -> w <> ''))"


def _walk(text: str, found: str, pattern: str, measure: str, kind: str, item: str) -> str:
    """SQL: places of the matches ``found``; positions ``acc`` are sums of ``measure`` over what stands before."""
    gaps = f"slice(split({text}, {pattern}, -1), 1, size({found}))"
    pairs = f"zip_with({gaps}, {found}, (g, m) -> named_struct('g', {measure.format('g')}, 'n', {measure.format('m')}, 'm', m))"
    return f"transform(array({pairs}), pairs -> {running('pairs', kind, '0', 'acc + x.g + x.n', 'acc + b', item, 'int')})[0]"


def license_scan(df: DataFrame, text: str = "text", prefix: str = "license_") -> DataFrame:
    """All columns and ``prefix`` + n_words, base (array of (word, label)), hits (kept detections over the
    text's words joined by single spaces: start, stop, priority, label)."""
    body, low, found, lower, words = (own_name(df, f"__{x}") for x in ("text", "low", "found", "lower", "words"))
    out = df.withColumn(body, whole_text(text))
    out = out.withColumn(lower, F.lower(body))
    may = " or ".join("(" + " and ".join(f"contains({lower}, '{w}')" for w in p.split(" ")) + ")" for p, _ in BASE_PHRASES)
    out = out.withColumn(found, F.expr(f"if({may}, regexp_extract_all({body}, {_q(_BASE)}, 0), cast(array() as array<string>))"))
    label = "case lower(left(x.m, 2)) " + " ".join(f"when '{p[:2]}' then '{label}'" for p, label in BASE_PHRASES) + " end"
    base = _walk(body, found, _q(_BASE), _count("{}"), "array<struct<word:int,label:string>>", f"named_struct('word', acc + x.g, 'label', {label})")
    # separators are ASCII, so that the lower-case text has the same words
    out = out.withColumn(words, F.expr(f"split({lower}, {_q(_G)}, -1)"))
    ends = f"int({words}[0] = '') + int(size({words}) > 1 and element_at({words}, -1) = '')"
    gate = f"arrays_overlap({words}, array({', '.join(map(_q, _GATE))}))"
    out = out.withColumns(
        {
            prefix + "n_words": F.expr(f"cast(size({words}) - ({ends}) as long)"),
            prefix + "base": F.expr(f"if(size({found}) = 0, cast(array() as array<struct<word:int,label:string>>), {base})"),
            low: F.expr(f"if({gate}, concat(' ', array_join(filter({words}, w -> w <> ''), ' '), ' '), '')"),
        }
    )
    groups = F.array(
        *(
            F.struct(F.lit(key).alias("keyword"), F.array(*(F.struct(F.lit(label).alias("label"), F.lit(n).alias("priority"), F.lit(rank).alias("rank"), F.lit(f"(?<= )(?:{p})(?= )").alias("pattern")) for rank, n, label, p in found_by)).alias("rules"))
            for key, found_by in _RANKED.items()
        )
    )
    chosen, raw = own_name(df, "__rules"), own_name(df, "__raw")
    out = out.withColumn(chosen, groups)
    hit = "named_struct('start', acc + x.g, 'stop', acc + x.g + x.n, 'priority', r.priority, 'rank', r.rank, 'label', r.label)"
    per_rule = _walk(low, f"regexp_extract_all({low}, r.pattern, 0)", "r.pattern", "length({})", _HIT, hit)
    per_group = f"flatten(transform(filter(k.rules, r -> {low} rlike r.pattern), r -> {per_rule}))"
    out = out.withColumn(raw, F.expr(f"if({low} = '', cast(array() as {_HIT}), flatten(transform(filter({chosen}, k -> contains({low}, k.keyword)), k -> {per_group})))"))
    order = ("a.start - b.start", "b.stop - a.stop", "b.priority - a.priority", "a.rank - b.rank")
    ordered = f"array_sort({raw}, (a, b) -> case " + " ".join(f"when {o} <> 0 then {o}" for o in order) + " else 0 end)"
    fields = [f"e{n}" for n in range(1, 5)]
    zero = f"named_struct({', '.join(f'{e!r}, -1' for e in fields)})"
    step = "named_struct(" + ", ".join(f"'e{n}', if(x.priority >= {n}, greatest(acc.e{n}, x.stop), acc.e{n})" for n in range(1, 5)) + ")"
    merge = "named_struct(" + ", ".join(f"'{e}', greatest(acc.{e}, b.{e})" for e in fields) + ")"
    inside = "case x.priority " + " ".join(f"when {n} then acc.e{n}" for n in range(1, 5)) + " end >= x.stop"
    seen = running("hits", "array<struct<hit:struct<start:int,stop:int,priority:int,rank:int,label:string>,inside:boolean>>", zero, step, merge, f"named_struct('hit', x, 'inside', {inside})", _EDGES)
    swept = f"transform(filter(transform(array({ordered}), hits -> {seen})[0], h -> not h.inside), h -> h.hit)"
    out = out.withColumn(prefix + "hits", F.expr(f"if(size({raw}) = 0, {raw}, {swept})"))
    return out.drop(body, low, lower, words, found, chosen, raw)


def license_digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is a quarter of the highest priority of a kept detection, one half at least where
    there is a base place.
    """
    out = license_scan(df.select(F.col(key).alias("k"), F.col(text).alias("t")), "t", "l_")
    return out.select(
        F.col("k").alias(key),
        F.col("l_n_words").alias("n_words"),
        F.expr("cast(size(l_base) as long)").alias("n_base"),
        F.expr("cast(array_min(l_base.word) as long)").alias("first_word"),
        F.expr("cast(array_max(l_base.word) as long)").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(l_base.label)), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(concat(l_base.label, l_hits.label))), ',')").alias("labels"),
        F.expr("greatest(coalesce(array_max(l_hits.priority), 0) / 4D, if(size(l_base) > 0, 0.5D, 0D))").alias("score"),
    )
