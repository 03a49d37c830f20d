"""Operator 2: licence scans by sentence rules, in DataFrame functions only.

A text is normalised (ASCII letters lower-cased, everything but letters and
digits one blank, a line break or the end of a sentence), and the longest known
licence sentences are looked up in it. A sentence begins and ends at a sign
before a blank, an empty line or a line break, but may also run on over line
breaks: wrapped texts, with signs of comments before their lines or without,
have the sentences of unwrapped ones. Known are sentences of the licences' own
texts, their titles, SPDX tags, and namings: a lead ("this project is released
under the") and a name. The identifiers found, in order, are matched against
the rules, of which the first that occurs as a run of consecutive identifiers
names the licence. All rules that occur are listed too.

One narrow pass without shuffle over every text: no text is skipped by a clue.
Null and empty texts have no sentences. Null or repeated ids are rows like
others; very long texts are scanned whole; an empty table gives no row; other
columns are not read, whatever their names. The SQL beside the operator goes
another way: it cuts texts into pieces and looks up joined runs of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: sentences of public licences, normalised, with their identifiers
SENTENCES = {
    "mit_grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ),
    "mit_notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit_warranty": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "the software is provided as is without warranty of any kind express or implied",
    ),
    "mit_liability": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "apache2_use": ("you may not use this file except in compliance with the license",),
    "apache2_copy": ("you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    "apache2_law": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    ),
    "apache2_see": ("see the license for the specific language governing permissions and limitations under the license",),
    "apache2_asf": ("licensed to the apache software foundation asf under one or more contributor license agreements",),
    "apache2_name": ("the asf licenses this file to you under the apache license version 2 0 the license",),
    "apache2_title": ("apache license version 2 0 january 2004", "apache license version 2 0 january 2004 http www apache org licenses"),
    "bsd_grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd_source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd_binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd_names": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd_advertising": ("all advertising materials mentioning features or use of this software must display the following acknowledgement",),
    "bsd_warranty": ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "isc_grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "bsd0_grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "isc_warranty": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "gpl_free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",),
    "gpl3_later": ("either version 3 of the license or at your option any later version",),
    "gpl2_later": ("either version 2 of the license or at your option any later version",),
    "gnu_hope": ("but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "gnu_verbatim": ("everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",),
    "gpl3_title": ("gnu general public license version 3 29 june 2007",),
    "gpl2_title": ("gnu general public license version 2 june 1991",),
    "lgpl3_title": ("gnu lesser general public license version 3 29 june 2007",),
    "lgpl21_title": ("gnu lesser general public license version 2 1 february 1999",),
    "agpl3_title": ("gnu affero general public license version 3 19 november 2007",),
    "mpl2_form": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "mpl2_copy": ("if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    "mpl2_title": ("mozilla public license version 2 0",),
    "unlicense_domain": ("this is free and unencumbered software released into the public domain",),
    "unlicense_anyone": ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",),
    "bsl1_grant": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",),
    "zlib_warranty": ("this software is provided as is without any express or implied warranty",),
    "zlib_liability": ("in no event will the authors be held liable for any damages arising from the use of this software",),
    "zlib_grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "cc0_waiver": ("to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",),
    "wtfpl_copy": ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",),
    "epl2_grant": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",),
    "postgresql_grant": ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",),
}
#: Licences by identifier: SPDX name, and the names by which a naming calls them.
NAMES = {
    "mit": ("MIT", ("mit license", "mit licence", "mit", "expat license")),
    "apache2": ("Apache-2.0", ("apache license version 2 0", "apache license version 2 0 the license", "apache license 2 0", "apache 2 0 license", "apache 2 0", "apache license v2 0")),
    "gpl3": ("GPL-3.0-only", ("gnu general public license version 3", "gnu general public license v3", "gnu general public license v3 0", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gplv3", "gpl v3", "gpl 3 0")),
    "gpl2": ("GPL-2.0-only", ("gnu general public license version 2", "gnu general public license v2", "gnu general public license v2 0", "gnu gpl version 2", "gnu gpl v2", "gpl version 2", "gplv2", "gpl v2", "gpl 2 0")),
    "lgpl3": ("LGPL-3.0-only", ("gnu lesser general public license version 3", "gnu lesser general public license v3", "lgplv3", "lgpl v3", "lgpl 3 0")),
    "lgpl21": ("LGPL-2.1-only", ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "lgplv2 1", "lgpl v2 1", "lgpl 2 1")),
    "agpl3": ("AGPL-3.0-only", ("gnu affero general public license version 3", "gnu affero general public license v3", "agplv3", "agpl v3", "agpl 3 0")),
    "mpl2": ("MPL-2.0", ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0", "mpl 2 0")),
    "bsd3": ("BSD-3-Clause", ("bsd 3 clause license", "3 clause bsd license", "bsd 3 clause", "new bsd license", "modified bsd license")),
    "bsd2": ("BSD-2-Clause", ("bsd 2 clause license", "2 clause bsd license", "bsd 2 clause", "simplified bsd license")),
    "isc": ("ISC", ("isc license", "isc")),
    "unlicense": ("Unlicense", ("unlicense",)),
    "bsl1": ("BSL-1.0", ("boost software license version 1 0", "boost software license 1 0", "boost software license")),
    "zlib": ("Zlib", ("zlib license", "zlib")),
    "cc0": ("CC0-1.0", ("cc0 1 0", "cc0", "cc0 1 0 universal")),
    "wtfpl": ("WTFPL", ("wtfpl", "do what the fuck you want to public license")),
    "epl2": ("EPL-2.0", ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "epl 2 0")),
    "epl1": ("EPL-1.0", ("eclipse public license version 1 0", "eclipse public license 1 0", "eclipse public license v1 0", "epl 1 0")),
    "eupl12": ("EUPL-1.2", ("european union public licence version 1 2", "eupl 1 2", "eupl v 1 2")),
    "artistic2": ("Artistic-2.0", ("artistic license 2 0", "artistic license version 2 0")),
    "postgresql": ("PostgreSQL", ("postgresql license", "postgresql licence")),
    "ofl11": ("OFL-1.1", ("sil open font license version 1 1", "sil open font license 1 1", "ofl 1 1")),
}
#: Leads of a naming, as parts of which one each is taken.
LEAD = (
    ("", "this project is ", "this work is ", "this software is ", "this program is ", "this library is ", "this package is ", "this file is ", "this code is ", "the code is ", "the source code is ", "it is "),
    ("licensed ", "released ", "distributed ", "available ", "published "),
    ("under ", "under the ", "under the terms of ", "under the terms of the "),
)
TITLES = ("mit", "isc", "bsd3", "bsd2", "unlicense", "zlib")
#: Licence texts: identifiers that must follow one another, and the licence they show.
TEXTS = (
    ("MIT", ("mit_grant", "mit_notice", "mit_warranty")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("Apache-2.0", ("apache2_name", "apache2_use")),
    ("Apache-2.0", ("apache2_title",)),
    ("GPL-3.0-or-later", ("gpl3_text",)),
    ("GPL-2.0-or-later", ("gpl2_text",)),
    ("LGPL-3.0-or-later", ("lgpl3_text",)),
    ("LGPL-2.1-or-later", ("lgpl21_text",)),
    ("AGPL-3.0-or-later", ("agpl3_text",)),
    ("GPL-3.0-or-later", ("gpl_free", "gpl3_later")),
    ("GPL-2.0-or-later", ("gpl_free", "gpl2_later")),
    ("BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advertising")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_names")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_names")),
    ("GPL-3.0-only", ("gpl3_title",)),
    ("GPL-2.0-only", ("gpl2_title",)),
    ("LGPL-3.0-only", ("lgpl3_title",)),
    ("LGPL-2.1-only", ("lgpl21_title",)),
    ("AGPL-3.0-only", ("agpl3_title",)),
    ("MPL-2.0", ("mpl2_form",)),
    ("MPL-2.0", ("mpl2_title",)),
    ("Zlib", ("zlib_warranty", "zlib_liability", "zlib_grant")),
    ("BSL-1.0", ("bsl1_grant",)),
    ("ISC", ("isc_grant",)),
    ("0BSD", ("bsd0_grant",)),
    ("Unlicense", ("unlicense_domain",)),
    ("CC0-1.0", ("cc0_waiver",)),
    ("WTFPL", ("wtfpl_copy",)),
    ("EPL-2.0", ("epl2_grant",)),
    ("PostgreSQL", ("postgresql_grant",)),
    ("MIT", ("mit_grant",)),
    ("BSD-2-Clause", ("bsd_grant",)),
)
# end of fixed values
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _names() -> dict[str, tuple[str, tuple[str, ...]]]:
    """NAMES and the Creative Commons licences, made from their parts."""
    out = dict(NAMES)
    for parts in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        for version in ("4 0", "3 0"):
            long = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
            spelt = " ".join(long[p] for p in parts.split())
            names = (f"cc {parts} {version}", f"creative commons {spelt} {version} international license", f"creative commons {spelt} {version} license")
            out["cc" + parts.replace(" ", "") + version[0]] = (f"CC-{parts.replace(' ', '-').upper()}-{version.replace(' ', '.')}", names)
    return out


def _gnu() -> dict[str, str]:
    """The notice of the GNU licences for each of them, as whole sentences."""
    out = {}
    for thing in ("program", "library", "software", "file"):
        for name, versions in (("", ("2", "3")), ("lesser ", ("2 1", "3")), ("affero ", ("3",))):
            for v in versions:
                notice = f"this {thing} is free software you can redistribute it and or modify it under the terms of the gnu {name}general public license as published by the free software foundation either version {v} of the license or at your option any later version"
                out[notice] = {"": "gpl", "lesser ": "lgpl", "affero ": "agpl"}[name] + v.replace(" ", "") + "_text"
    for thing in ("program", "library"):
        for name in ("", "lesser ", "affero "):
            out[f"see the gnu {name}general public license for more details"] = "gnu_details"
            out[f"you should have received a copy of the gnu {name}general public license along with this {thing}"] = "gnu_received"
    return out


def known() -> dict[str, str]:
    """Identifier of each sentence. "under X" stands for a naming of X behind any lead."""
    out = {s: i for i, many in SENTENCES.items() for s in many} | _gnu()
    for key, (spdx, names) in _names().items():
        out |= {"under " + n: key + "_name" for n in names}
        out["spdx license identifier " + " ".join("".join(c if c.isalnum() else " " for c in spdx.lower()).split())] = key + "_name"
        if key in TITLES:
            out |= {lead + n: key + "_name" for n in names if " " in n or key == "unlicense" for lead in ("", "the ")}
    return out


def rules() -> list[tuple[int, str, tuple[str, ...]]]:
    """(number, licence, identifiers that must follow one another). The first that occurs decides: texts before namings."""
    both = [*TEXTS, *((spdx, (key + "_name",)) for key, (spdx, _) in _names().items())]
    return [(n + 1, licence, ids) for n, (licence, ids) in enumerate(both)]


def _either(tails: list[list[str]]) -> str:
    """A pattern of the word lists that shares their beginnings, longer ones first."""
    by: dict[str, list[list[str]]] = {}
    for t in tails:
        by.setdefault(t[0], []).append(t[1:])
    parts = []
    for word, rest in by.items():
        more = [r for r in rest if r]
        tail = f"[ \n]{_either(more)}" if more else ""
        parts.append(word + (f"(?:{tail})?" if tail and [] in rest else tail))
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def lead(blank: str) -> str:
    """A pattern of all leads."""
    return "".join(f"(?:{'|'.join(p.replace(' ', blank) for p in sorted(part, key=lambda p: (-len(p), p)))})" for part in LEAD)


def marked(low: Column) -> Column:
    """Words of a lower-cased text with one sign between two: a blank, a line feed where a sentence may end, a form feed where it must."""
    passes = (
        (r"[^a-z0-9.!?;\n]+", " "),
        (r"(?<![a-z0-9])v\.[ \n](?=[0-9])", "v "),  # "v. 2.0"
        (r"[.!?](?=[ \n])", "\f"),
        (r";(?=[ \n])", "\n "),
        (r"[.!?;]", " "),
        (r" +", " "),
        (r"\n[ \n]*\n", "\f"),  # an empty line, or one of signs only
        (r"[ \n]*\f[ \n\f]*", "\f"),
        (r" ?\n ?", "\n"),
    )
    out = F.concat(F.lit("\n"), low, F.lit("\n"))
    for pattern, by in passes:
        out = F.regexp_replace(out, pattern, by)
    return out


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    table = known()
    ids = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    named = _either([s.split()[1:] for s in table if s.startswith("under ")])
    other = _either([s.split() for s in table if not s.startswith("under ")])
    pattern = F.lit(rf"(?<=[\n\f])(?:{lead('[ ' + chr(10) + ']')}{named}|{other})(?=[\n\f])")
    found = F.regexp_extract_all(marked(F.translate(text, UPPER, LOWER)), pattern, F.lit(0))
    plain = F.transform(found, lambda s: F.regexp_replace(F.translate(s, "\n", " "), f"^{lead(' ')}", "under "))
    return F.filter(F.transform(plain, lambda s: F.try_element_at(ids, s)), lambda x: x.isNotNull())


def licences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_sentences, sequence, rule, licence, licences) of every row; rule is 0 and licence null where no rule occurs."""
    rows = docs.select(key, identifiers(F.coalesce(F.col(text), F.lit(""))).alias("_ids"))
    rows = rows.withColumn("_seq", F.concat(F.lit("|"), F.array_join("_ids", "|"), F.lit("|")))
    hits = F.filter(F.array(*[F.when(F.contains("_seq", F.lit("|" + "|".join(ids) + "|")), F.struct(F.lit(n).alias("n"), F.lit(name).alias("name"))) for n, name, ids in rules()]), lambda h: h.isNotNull())
    rows = rows.withColumn("_hits", F.when(F.size("_ids") > 0, hits).otherwise(F.array().cast("array<struct<n:int,name:string>>")))
    first = F.try_element_at("_hits", F.lit(1))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["name"]))), ",")
    return rows.select(key, F.size("_ids").cast("long").alias("n_sentences"), F.array_join("_ids", "|").alias("sequence"), F.coalesce(first["n"].cast("long"), F.lit(0)).alias("rule"), first["name"].alias("licence"), names.alias("licences"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in all documents."""
    return licences(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def _sql() -> str:
    """Pieces between any two signs or breaks, runs of pieces of one sentence, and the table of all sentences, leads written out."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    table = known()
    leads = [a + b + c for a in LEAD[0] for b in LEAD[1] for c in LEAD[2]]
    plain = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in table.items() if not s.startswith("under "))
    named = ", ".join(f"({quoted(s[6:])}, {quoted(i)})" for s, i in table.items() if s.startswith("under "))
    rule_rows = ", ".join(f"({n}, {quoted(name)}, {quoted('|' + '|'.join(ids) + '|')})" for n, name, ids in rules())
    most = max(len(s.split()) for s in table) + 12
    return f"""
WITH RECURSIVE known(s, id) AS (
  SELECT * FROM (VALUES {plain}) p(s, id) UNION
  SELECT l || s, id FROM (VALUES {named}) n(s, id), (SELECT unnest([{', '.join(map(quoted, leads))}]) AS l)),
rule(n, name, ids) AS (VALUES {rule_rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9.!?;\\n]+', ' ', 'g'), '(^|[^a-z0-9])v\\.[ \\n]([0-9])', '\\1v \\2', 'g') AS t FROM documents),
segs AS (SELECT r, string_split_regex(t, '[.!?]( |\\n|$)|\\n[ .!?;\\n]*\\n') AS x FROM d),
seg AS (SELECT r, generate_subscripts(x, 1) AS g, string_split_regex(unnest(x), '\\n|;( |$)') AS x FROM segs),
cut AS (SELECT r, g, generate_subscripts(x, 1) AS k, trim(regexp_replace(unnest(x), '[^a-z0-9]+', ' ', 'g')) AS s FROM seg),
piece AS (SELECT r, g, row_number() OVER (PARTITION BY r, g ORDER BY k) AS k, s, len(string_split(s, ' ')) AS n FROM cut WHERE s <> ''),
run(r, g, i, j, s, n) AS (
  SELECT r, g, k, k, s, n FROM piece UNION ALL
  SELECT u.r, u.g, u.i, p.k, u.s || ' ' || p.s, u.n + p.n FROM run u JOIN piece p ON p.r = u.r AND p.g = u.g AND p.k = u.j + 1 WHERE u.n + p.n <= {most}),
hit AS (SELECT r, g, i, max(j) AS j, arg_max(id, j) AS id FROM run JOIN known USING (s) GROUP BY r, g, i),
free AS (SELECT * FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.r = h.r AND o.g = h.g AND o.i < h.i AND h.i <= o.j)),
seq AS (SELECT r, string_agg(id, '|' ORDER BY g, i) AS q, count(*) AS n FROM free GROUP BY r),
won AS (SELECT r, min(rule.n) AS rule, arg_min(rule.name, rule.n) AS licence, string_agg(DISTINCT rule.name, ',' ORDER BY rule.name) AS licences FROM seq JOIN rule ON contains('|' || q || '|', rule.ids) GROUP BY r)
SELECT doc_id, CAST(coalesce(seq.n, 0) AS BIGINT) AS n_sentences, coalesce(q, '') AS sequence, CAST(coalesce(rule, 0) AS BIGINT) AS rule, licence, coalesce(licences, '') AS licences
FROM d LEFT JOIN seq USING (r) LEFT JOIN won USING (r)"""


ORACLE_SQL = {"op2_license_scan": _sql()}
