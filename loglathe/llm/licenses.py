"""Licence scans by sentences: a text's sentences are normalised, mapped to identifiers of known
licence sentences, and the sequence of identifiers is matched against ordered licence rules.

A sentence may run over several lines of a paragraph; it starts and ends with a line or sentence.
DataFrame functions only; everything happens within a row, so there is no shuffle and nothing for a
frequent licence to skew.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRANT = r"(?:this [a-z ]{1,40} is |it is |all [a-z ]{1,40} are )?(?:dual )?(?:released|licensed|distributed|published|available|provided|made available) under (?:the )?(?:terms of (?:the )?)?"
_LATER = r" or (?:at your option )?any later version"

#: Known licence sentences in the normal form of normal(), as patterns that a whole sentence has to
#: match, in order: the first that matches names the sentence (fixed values).
SENTENCES = (
    ("mit_grant", _GRANT + r"mit licen[cs]e"),
    ("mit_permission", r"permission is hereby granted free of charge to any person obtaining a copy of this .*"),
    ("mit_notice", r"the above copyright notice and this permission notice .*"),
    ("as_is", r"(?:the|this) software is provided (?:by .* )?as is .*"),
    ("no_liability", r"in no event shall .* be liable .*"),
    ("isc_permission", r"permission to use copy modify and or distribute this software for any purpose .*"),
    ("isc_grant", _GRANT + r"isc licen[cs]e"),
    ("bsd_terms", r"redistribution and use in source and binary forms .*"),
    ("bsd_source", r"(?:\d )?redistributions of source code must retain .*"),
    ("bsd_binary", r"(?:\d )?redistributions in binary form must reproduce .*"),
    ("bsd_names", r"(?:\d )?neither the name of .*"),
    ("bsd2_grant", _GRANT + r"(?:bsd 2 clause|simplified bsd) licen[cs]e"),
    ("bsd3_grant", _GRANT + r"(?:bsd 3 clause|new bsd|modified bsd) licen[cs]e"),
    ("apache2_grant", _GRANT + r"apache licen[cs]e version 2(?:\.0)?(?: the licen[cs]e)?"),
    ("apache2_compliance", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache2_copy", r"you may obtain a copy of the licen[cs]e at .*"),
    ("gpl2_later_grant", _GRANT + r"gnu general public licen[cs]e version 2(?:\.0)?" + _LATER),
    ("gpl2_grant", _GRANT + r"gnu general public licen[cs]e version 2(?:\.0)?"),
    ("gpl3_later_grant", _GRANT + r"gnu general public licen[cs]e version 3(?:\.0)?" + _LATER),
    ("gpl3_grant", _GRANT + r"gnu general public licen[cs]e version 3(?:\.0)?"),
    ("lgpl21_grant", _GRANT + r"gnu lesser general public licen[cs]e version 2\.1(?:" + _LATER + ")?"),
    ("lgpl3_grant", _GRANT + r"gnu lesser general public licen[cs]e version 3(?:\.0)?(?:" + _LATER + ")?"),
    ("agpl3_grant", _GRANT + r"gnu affero general public licen[cs]e version 3(?:\.0)?(?:" + _LATER + ")?"),
    ("mpl2_grant", r"(?:this source code form is subject to the terms of the|" + _GRANT + r") ?mozilla public licen[cs]e (?:v|version) ?2(?:\.0)?"),
    ("cc_by_nc_grant", _GRANT + r"(?:a )?(?:cc by nc|creative commons attribution noncommercial) (?:4\.0|licen[cs]e|4\.0 international licen[cs]e)"),
    ("cc_by_sa_grant", _GRANT + r"(?:a )?(?:cc by sa|creative commons attribution sharealike) (?:4\.0|licen[cs]e|4\.0 international licen[cs]e)"),
    ("cc_by_grant", _GRANT + r"(?:a )?(?:cc by|creative commons attribution) (?:4\.0|licen[cs]e|4\.0 international licen[cs]e)"),
    ("cc0_grant", r"(?:" + _GRANT + r"cc0.*|this is free and unencumbered work released into the public domain)"),
    ("unlicense_grant", r"this is free and unencumbered software released into the public domain"),
    ("all_rights", r"(?:copyright .* )?all rights reserved"),
)

#: Licences by sequences of sentences, in order: what a rule has matched is gone for later ones.  A
#: sentence in brackets may be missing.  Sentences of no known kind may stand between.
RULES = (
    ("BSD-3-Clause", "bsd_terms bsd_source bsd_binary bsd_names [as_is] [no_liability]"),
    ("BSD-2-Clause", "bsd_terms bsd_source bsd_binary [as_is] [no_liability]"),
    ("MIT", "[mit_grant] mit_permission mit_notice [as_is] [no_liability]"),
    ("ISC", "[isc_grant] isc_permission [as_is] [no_liability]"),
    ("Apache-2.0", "apache2_grant apache2_compliance [apache2_copy]"),
    ("MIT", "mit_grant"),
    ("ISC", "isc_grant"),
    ("BSD-2-Clause", "bsd2_grant"),
    ("BSD-3-Clause", "bsd3_grant"),
    ("Apache-2.0", "apache2_grant"),
    ("GPL-2.0-or-later", "gpl2_later_grant"),
    ("GPL-2.0-only", "gpl2_grant"),
    ("GPL-3.0-or-later", "gpl3_later_grant"),
    ("GPL-3.0-only", "gpl3_grant"),
    ("LGPL-2.1", "lgpl21_grant"),
    ("LGPL-3.0", "lgpl3_grant"),
    ("AGPL-3.0", "agpl3_grant"),
    ("MPL-2.0", "mpl2_grant"),
    ("CC-BY-NC-4.0", "cc_by_nc_grant"),
    ("CC-BY-SA-4.0", "cc_by_sa_grant"),
    ("CC-BY-4.0", "cc_by_grant"),
    ("CC0-1.0", "cc0_grant"),
    ("Unlicense", "unlicense_grant"),
    ("All-Rights-Reserved", "all_rights"),
)

#: Identifiers of SPDX expressions by the licence that they name (fixed values); ``+`` and ``-or-later`` are of
#: their own where the licence is told apart, and of the licence where it isn't.
SPDX = {
    "MIT": "mit", "ISC": "isc", "Apache-2.0": "apache-2.0", "Apache-1.1": "apache-1.1", "BSD-2-Clause": "bsd-2-clause", "BSD-3-Clause": "bsd-3-clause", "0BSD": "0bsd",
    "GPL-2.0-only": "gpl-2.0-only gpl-2.0", "GPL-2.0-or-later": "gpl-2.0-or-later gpl-2.0+", "GPL-3.0-only": "gpl-3.0-only gpl-3.0", "GPL-3.0-or-later": "gpl-3.0-or-later gpl-3.0+",
    "LGPL-2.0": "lgpl-2.0-only lgpl-2.0-or-later lgpl-2.0 lgpl-2.0+", "LGPL-2.1": "lgpl-2.1-only lgpl-2.1-or-later lgpl-2.1 lgpl-2.1+", "LGPL-3.0": "lgpl-3.0-only lgpl-3.0-or-later lgpl-3.0 lgpl-3.0+",
    "AGPL-3.0": "agpl-3.0-only agpl-3.0-or-later agpl-3.0 agpl-3.0+", "MPL-1.1": "mpl-1.1", "MPL-2.0": "mpl-2.0", "EPL-1.0": "epl-1.0", "EPL-2.0": "epl-2.0", "EUPL-1.2": "eupl-1.2", "CDDL-1.0": "cddl-1.0",
    "BSL-1.0": "bsl-1.0", "BUSL-1.1": "busl-1.1", "Zlib": "zlib", "Artistic-2.0": "artistic-2.0", "WTFPL": "wtfpl", "OFL-1.1": "ofl-1.1", "PostgreSQL": "postgresql", "Python-2.0": "python-2.0", "NCSA": "ncsa",
    "MS-PL": "ms-pl", "AFL-3.0": "afl-3.0", "OSL-3.0": "osl-3.0", "X11": "x11", "Unlicense": "unlicense", "CC0-1.0": "cc0-1.0", "CC-BY-4.0": "cc-by-4.0", "CC-BY-SA-4.0": "cc-by-sa-4.0", "CC-BY-NC-4.0": "cc-by-nc-4.0",
}
_SPDX_NAMES = {identifier: name for name, identifiers in SPDX.items() for identifier in identifiers.split()}
#: An SPDX expression after its tag, in lower case: identifiers joined by and, or, with, in brackets.
_SPDX_LINE = r"spdx-licen[cs]e-identifier:[\x20\x09]*((?:\([\x20\x09]*)*[a-z0-9.+\-]+(?:[\x20\x09]*\))*(?:[\x20\x09]+(?:and|or|with)[\x20\x09]+(?:\([\x20\x09]*)*[a-z0-9.+\-]+(?:[\x20\x09]*\))*)*)"
_SPDX_JOINTS = r"[()\x20\x09]+"

_FSF = r" as published by the free software foundation(?: inc)?"
_MODIFY = r"(?:[a-z0-9 ]{1,100} free software )?(?:you (?:can|may) )?redistribute (?:it|them|this [a-z ]{1,40}) and or modify (?:it|them|this [a-z ]{1,40}) under (?:the )?(?:terms of (?:the )?)?"
_OR_LATER = r" or (?:at your option )?(?:any later version|later(?: versions?)?)"


def _notice(family: str, version: str, later: bool) -> str:
    """The standard notice of a licence of the GPL family, in the orders of words that are in use."""
    numbered = rf"(?: either)? version {version}(?: of the licen[cs]e)?"
    end = _OR_LATER if later else "(?: only)?"
    return rf"(?:{_GRANT}|{_MODIFY})gnu {family} public licen[cs]e(?:{_FSF}{numbered}{end}|{numbered}{end}(?:{_FSF})?)"


#: Notices of the GPL family: tried before SENTENCES, which hold none of them but as plain grants.
NOTICES = tuple(
    (f"{key}_{'later_' if later else ''}notice", _notice(family, version, later))
    for key, family, version in (
        ("gpl2", "general", r"2(?:\.0)?"),
        ("gpl3", "general", r"3(?:\.0)?"),
        ("lgpl2", "(?:library|lesser) general", r"2(?:\.0)?"),
        ("lgpl21", "lesser general", r"2\.1"),
        ("lgpl3", "lesser general", r"3(?:\.0)?"),
        ("agpl3", "affero general", r"3(?:\.0)?"),
    )
    for later in (True, False)
)
NOTICE_RULES = (
    ("GPL-2.0-or-later", "gpl2_later_notice"),
    ("GPL-2.0-only", "gpl2_notice"),
    ("GPL-3.0-or-later", "gpl3_later_notice"),
    ("GPL-3.0-only", "gpl3_notice"),
    *((name, f"{key}_{kind}") for key, name in (("lgpl2", "LGPL-2.0"), ("lgpl21", "LGPL-2.1"), ("lgpl3", "LGPL-3.0"), ("agpl3", "AGPL-3.0")) for kind in ("later_notice", "notice")),
)

#: Every known sentence holds one of these; sentences without are not looked at further.
HINT = r"licen[cs]e|reserved|permission|redistribution|neither the name|in no event|as is|public domain|cc0|cc by|creative commons"
#: Ends of sentences in SQL, which goes by lines: line ends, and . ; ! ? before white space (a version number's dot is none).
_ENDS, _MARK = r"[.;!?]+(?:[\x20\x09-\x0D]+|$)|[\n\r]+", "\n"
#: What normal() makes a space: all but ASCII letters, digits, and dots between digits.
_NOISE = r"[^a-z0-9.]+"


def _pattern(rule: str) -> str:
    """A pattern over ``,id,,id,`` sequences."""
    return "".join(f"(?:,{x[1:-1]},)?" if x[0] == "[" else f",{x}," for x in rule.split())


#: Ends of sentences: . ; ! ? before white space, a colon at a line's end, and lines without letters or digits.
_BREAKS, _BREAK = r"[.;!?]+(?:[\x20\x09-\x0D]+|$)|:[\x20\x09]*\n|\n(?:[^\p{L}\p{N}\n]*\n)+", "\x01"
#: The semicolon of the GPL's notice before its version.
_NOTICE_SEMICOLON = r"(free[^a-z0-9]+software[^a-z0-9]+foundation(?:, *inc\.?)?) *;(?=[^a-z0-9]+(?:either[^a-z0-9]+)?version)"
#: Lines that an open text within a sentence may run over.
_LINES = 30


def _scanner() -> str:
    """A pattern that finds the known sentences in the lines of a sentence: each starts and ends with
    a line.  An open end stays within its line, and an open text within the sentence doesn't run
    over a line that is a whole sentence itself."""
    known = (*NOTICES, *SENTENCES)
    whole = "|".join(p for _, p in known if ".*" not in p)

    def over_lines(pattern: str) -> str:
        pattern = re.sub(r"\.\*(?= )", "\x02", pattern).replace(".*", "\x03").replace(" ", r"[ \n]")
        return pattern.replace("\x02", rf"[^\n]*?(?:\n(?!(?:{whole})(?:\n|$))[^\n]*?){{0,{_LINES}}}?").replace("\x03", r"[^\n]*")

    return r"(?:^|(?<=\n))(?:" + "|".join(over_lines(p) for _, p in known) + r")(?=\n|$)"


def sentences(text: Column) -> Column:
    """The normalised sentences of a text that hold a hint, in order: lower case, words separated by
    one space or line end, without punctuation."""
    lower = F.regexp_replace(F.regexp_replace(F.lower(text), "\x01", " "), r"\r\n?", "\n")
    parts = F.split(F.regexp_replace(F.regexp_replace(lower, _NOTICE_SEMICOLON, "$1,"), _BREAKS, _BREAK), _BREAK)
    plain = F.filter(parts, lambda s: F.regexp_like(s, F.lit("(?:" + HINT.replace(" ", r"[^a-z0-9]+") + ")")))
    plain = F.transform(plain, lambda s: F.regexp_replace(s, r"[^a-z0-9.\n]+", " "))
    return F.transform(plain, lambda s: F.regexp_replace(s, r"(?m)^ ?(?:\.+ ?)?|(?: ?\.+)? ?$", ""))


def identifiers(text: Column) -> Column:
    """``,id,,id,``: the known sentences of a text in order."""
    scanner = _scanner()

    def name(s: Column) -> Column:
        chain = F
        for key, pattern in (*NOTICES, *SENTENCES):
            chain = chain.when(F.regexp_like(s, F.lit(f"^(?:{pattern})$")), F.lit(f",{key},"))
        return chain.otherwise(F.lit(""))

    found = F.flatten(F.transform(sentences(text), lambda s: F.regexp_extract_all(s, F.lit(scanner), F.lit(0))))
    return F.array_join(F.transform(found, lambda s: name(F.translate(s, "\n", " "))), "")


def tagged(text: Column) -> Column:
    """The licences that a text's SPDX expressions name, each as often as they do; what follows ``with`` and
    identifiers that aren't known name none."""
    parts = F.flatten(F.transform(F.regexp_extract_all(F.lower(text), F.lit(_SPDX_LINE), F.lit(1)), lambda e: F.split(F.regexp_replace(e, "[.]+$", ""), _SPDX_JOINTS)))
    table = F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in _SPDX_NAMES.items())), F.lit("\n"), F.lit("\t"))
    return F.filter(F.transform(parts, lambda x: F.element_at(table, x)), lambda x: x.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, license, n): how often each document of docs (doc_id, text, ...) grants or states
    a licence, one row for each licence it has; each licence of an SPDX expression counts.

    Null and empty texts have none; repeated rows are scanned for themselves; a null doc_id stays
    null.  Columns other than doc_id and text are not read.
    """
    rest = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.regexp_like(F.lower("text"), F.lit("(?:" + HINT.replace(" ", r"[^a-z0-9]+") + ")")))
    rest = rest.select("doc_id", identifiers(F.col("text")).alias("rest"), tagged(F.col("text")).alias("tagged")).where("rest <> '' or size(tagged) > 0")
    rules = (*RULES, *NOTICE_RULES)
    names = list(dict.fromkeys((*(x for x, _ in rules), *SPDX)))
    by_tag = lambda x: F.size(F.filter("tagged", lambda y: y == x)) if x in SPDX else F.lit(0)
    for i, (_, rule) in enumerate(rules):
        rest = rest.withColumn(f"n{i}", F.regexp_count("rest", F.lit(_pattern(rule)))).withColumn("rest", F.regexp_replace("rest", _pattern(rule), ""))
    counts = F.array(*(F.struct(F.lit(x).alias("license"), sum((F.col(f"n{i}") for i, (y, _) in enumerate(rules) if y == x), by_tag(x)).cast("long").alias("n")) for x in names))
    return rest.select("doc_id", F.explode(F.filter(counts, lambda c: c["n"] > 0)).alias("found")).select("doc_id", "found.license", "found.n")


def scan_sql(table: str = "documents") -> str:
    """The scan in DuckDB's SQL, by single lines and without the GPL family's notices."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    hint = quote(HINT.replace(" ", "[^a-z0-9]+"))
    spdx = "case x " + " ".join(f"when '{k}' then '{v}'" for k, v in _SPDX_NAMES.items()) + " end"
    name = "case " + " ".join(f"when regexp_matches(s, {quote(f'^(?:{p})$')}) then ',{k},'" for k, p in SENTENCES) + " else '' end"
    steps = [f"""s as (select doc_id, list_transform(list_filter(string_split(regexp_replace(lower(text), {quote(_ENDS)}, chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, {hint})), lambda x: regexp_replace(trim(regexp_replace(x, {quote(_NOISE)}, ' ', 'g')), '^\\.+ ?| ?\\.+$', '', 'g')) as found,
      list_transform(flatten(list_transform(regexp_extract_all(lower(text), {quote(_SPDX_LINE)}, 1), lambda e: regexp_split_to_array(regexp_replace(e, '[.]+$', ''), {quote(_SPDX_JOINTS)}))), lambda x: {spdx}) as tagged from {table})"""]
    steps.append(f"r as (select doc_id, tagged, coalesce(array_to_string(list_transform(found, lambda s: {name}), ''), '') as r0 from s)")
    for i, (_, rule) in enumerate(RULES):
        p = quote(_pattern(rule))
        steps.append(f"r{i + 1} as (select *, len(regexp_extract_all(r{i}, {p})) as n{i}, regexp_replace(r{i}, {p}, '', 'g') as r{i + 1} from {'r' if i == 0 else f'r{i}'})")
    each = " union all ".join(f"select doc_id, '{x}' as license, ({' + '.join([f'n{i}' for i, (y, _) in enumerate(RULES) if y == x] + [f"coalesce(len(list_filter(tagged, lambda y: y = '{x}')), 0)"])})::bigint as n from r{len(RULES)}" for x in dict.fromkeys((*(x for x, _ in RULES), *SPDX)))
    return f"with {', '.join(steps)} select * from ({each}) where n > 0"
