"""Licence scans by sentence rules, DataFrame functions only.

A text is cut at line ends and at sentence ends (. ! ? ; : before white space or the end) into pieces, which are
normalised to lower-case words of a-z and 0-9; signs that begin a line, as those of comments, don't count. A known
sentence is found where it equals a piece, or pieces that follow one another with nothing but single line ends between
them: lines may be wrapped anywhere. Of known sentences that begin together the longest counts, and none begins within
another that began before it. Known sentences have numbers; several wordings of a notice share one. The numbers found,
in order, are matched against the ordered RULES: a rule applies where its numbers follow one another, and takes them
from the rules after it. Other pieces may lie between, but more than GAP pieces (empty ones included) end a sequence.

Only texts in which something begins with the first three words of a known sentence are cut into pieces. There a piece's
first two words are looked up in a hash set, and only pieces that begin like a known sentence are compared.

Defined cases: null and empty texts have no sentences and no licence; a rule that applies several times is named once
and counted each time; texts of any length are read whole; repeated rows are scanned each; an empty table gives no rows;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces between two known sentences that still belong together.
GAP = 60
# Sentences of public licences, normalised as above.
SENTENCES = {
    "mit grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache header": "licensed under the apache license version 2 0 the license",
    "apache file": "you may not use this file except in compliance with the license",
    "apache copy": "you may obtain a copy of the license at",
    "apache place": "http www apache org licenses license 2 0",
    "apache warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache see": "see the license for the specific language governing permissions and limitations under the license",
    "apache title": "apache license version 2 0 january 2004",
    "apache grant": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "program free": "this program is free software",
    "library free": "this library is free software",
    "gpl3 or later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2 or later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl3 only": "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "gpl2 only": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl3 or later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21 or later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "agpl3 or later": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "either 3": "either version 3 of the license or at your option any later version",
    "either 2": "either version 2 of the license or at your option any later version",
    "either 2.1": "either version 2 1 of the license or at your option any later version",
    "gnu hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gnu hope library": "this library is distributed in the hope that it will be useful but without any warranty",
    "gnu implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl see": "see the gnu general public license for more details",
    "lgpl see": "see the gnu lesser general public license for more details",
    "agpl see": "see the gnu affero general public license for more details",
    "gpl copy": "you should have received a copy of the gnu general public license along with this program",
    "lgpl copy": "you should have received a copy of the gnu lesser general public license along with this library",
    "agpl copy": "you should have received a copy of the gnu affero general public license along with this program",
    "gnu verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "gpl3 title": "gnu general public license version 3 29 june 2007",
    "gpl2 title": "gnu general public license version 2 june 1991",
    "lgpl3 title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21 title": "gnu lesser general public license version 2 1 february 1999",
    "agpl3 title": "gnu affero general public license version 3 19 november 2007",
    "bsd grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "mpl form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl copy plain": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl title": "mozilla public license version 2 0",
    "isc grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "0bsd grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "cc0 deed": "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law",
    "cc0 title": "cc0 1 0 universal",
    "cc no law firm": "creative commons corporation is not a law firm and does not provide legal services",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "unlicense free": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "epl header": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl title": "eclipse public license v 2 0",
    "boost title": "boost software license version 1 0 august 17th 2003",
    "boost grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib warranty": "this software is provided as is without any express or implied warranty",
    "zlib grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib origin": "the origin of this software must not be misrepresented",
    "reserved": "all rights reserved",
}
# Names of licences as notices write them, with the licence and its kind.
NAMED = [
    ("mit license", "MIT", "permissive"),
    ("apache license version 2 0", "Apache-2.0", "permissive"),
    ("apache license 2 0", "Apache-2.0", "permissive"),
    ("bsd 2 clause license", "BSD-2-Clause", "permissive"),
    ("bsd 3 clause license", "BSD-3-Clause", "permissive"),
    ("isc license", "ISC", "permissive"),
    ("zlib license", "Zlib", "permissive"),
    ("boost software license version 1 0", "BSL-1.0", "permissive"),
    ("gnu general public license version 3", "GPL-3.0-only", "copyleft"),
    ("gnu general public license version 2", "GPL-2.0-only", "copyleft"),
    ("gnu lesser general public license version 3", "LGPL-3.0-only", "copyleft"),
    ("gnu lesser general public license version 2 1", "LGPL-2.1-only", "copyleft"),
    ("gnu affero general public license version 3", "AGPL-3.0-only", "copyleft"),
    ("mozilla public license version 2 0", "MPL-2.0", "copyleft"),
    ("eclipse public license 2 0", "EPL-2.0", "copyleft"),
    ("cc0 1 0 universal license", "CC0-1.0", "public-domain"),
    ("cc by 4 0", "CC-BY-4.0", "permissive"),
    ("cc by sa 4 0", "CC-BY-SA-4.0", "copyleft"),
    ("cc by nc 4 0", "CC-BY-NC-4.0", "noncommercial"),
    ("creative commons attribution 4 0 international license", "CC-BY-4.0", "permissive"),
    ("creative commons attribution sharealike 4 0 international license", "CC-BY-SA-4.0", "copyleft"),
    ("creative commons attribution noncommercial 4 0 international license", "CC-BY-NC-4.0", "noncommercial"),
]
SUBJECTS = "|this is|this file is|this work is|this code is|this program is|this software is|this project is|this library is|this package is|the code is|the source code is".split("|")
VERBS = "licensed|released|distributed|available|made available|published".split("|")
UNDER = "under |under the |under a |under the terms of the ".split("|")
# Licence, kind, and its sentences in order; earlier rules come first. Single notices come last.
RULES = [
    ("MIT", "permissive", ["mit grant", "mit notice", "mit warranty", "mit liability"]),
    ("BSD-3-Clause", "permissive", ["bsd grant", "bsd source", "bsd binary", "bsd names"]),
    ("BSD-2-Clause", "permissive", ["bsd grant", "bsd source", "bsd binary"]),
    ("Apache-2.0", "permissive", ["apache header", "apache file", "apache copy", "apache place", "apache warranty", "apache see"]),
    ("AGPL-3.0-or-later", "copyleft", ["program free", "agpl3 or later", "gnu hope", "gnu implied", "agpl see", "agpl copy"]),
    ("GPL-3.0-or-later", "copyleft", ["program free", "gpl3 or later", "gnu hope", "gnu implied", "gpl see", "gpl copy"]),
    ("GPL-2.0-or-later", "copyleft", ["program free", "gpl2 or later", "gnu hope", "gnu implied", "gpl see", "gpl copy"]),
    ("GPL-2.0-or-later", "copyleft", ["program free", "gpl terms", "either 2", "gnu hope", "gnu implied", "gpl see", "gpl copy"]),
    ("LGPL-2.1-or-later", "copyleft", ["library free", "lgpl terms", "either 2.1", "gnu hope library", "gnu implied", "lgpl see", "lgpl copy"]),
    ("LGPL-2.1-or-later", "copyleft", ["library free", "lgpl terms", "either 2.1"]),
    ("LGPL-2.1-or-later", "copyleft", ["library free", "lgpl21 or later"]),
    ("LGPL-3.0-or-later", "copyleft", ["library free", "lgpl3 or later"]),
    ("LGPL-3.0-or-later", "copyleft", ["program free", "lgpl3 or later"]),
    ("LGPL-3.0-or-later", "copyleft", ["library free", "lgpl terms", "either 3"]),
    ("AGPL-3.0-or-later", "copyleft", ["program free", "agpl3 or later"]),
    ("GPL-3.0-or-later", "copyleft", ["program free", "gpl3 or later"]),
    ("GPL-2.0-or-later", "copyleft", ["program free", "gpl2 or later"]),
    ("GPL-3.0-or-later", "copyleft", ["program free", "gpl terms", "either 3"]),
    ("GPL-2.0-or-later", "copyleft", ["program free", "gpl terms", "either 2"]),
    ("GPL-3.0-only", "copyleft", ["program free", "gpl3 only"]),
    ("GPL-2.0-only", "copyleft", ["program free", "gpl2 only"]),
    ("GPL-3.0-only", "copyleft", ["gpl3 title", "gnu verbatim"]),
    ("GPL-2.0-only", "copyleft", ["gpl2 title", "gnu verbatim"]),
    ("LGPL-3.0-only", "copyleft", ["lgpl3 title", "gnu verbatim"]),
    ("LGPL-2.1-only", "copyleft", ["lgpl21 title", "gnu verbatim"]),
    ("AGPL-3.0-only", "copyleft", ["agpl3 title", "gnu verbatim"]),
    ("MPL-2.0", "copyleft", ["mpl form", "mpl copy"]),
    ("MPL-2.0", "copyleft", ["mpl form", "mpl copy plain"]),
    ("ISC", "permissive", ["isc grant", "isc warranty", "isc liability"]),
    ("0BSD", "permissive", ["0bsd grant", "isc warranty", "isc liability"]),
    ("Unlicense", "public-domain", ["unlicense", "unlicense free"]),
    ("Zlib", "permissive", ["zlib warranty", "zlib grant", "zlib origin"]),
    ("Apache-2.0", "permissive", ["apache title", "apache grant"]),
    ("Apache-2.0", "permissive", ["apache header", "apache file"]),
    ("CC0-1.0", "public-domain", ["cc0 title", "cc no law firm"]),
    ("BSL-1.0", "permissive", ["boost title", "boost grant"]),
    ("MIT", "permissive", ["mit grant"]),
    ("ISC", "permissive", ["isc grant"]),
    ("Apache-2.0", "permissive", ["apache header"]),
    ("Apache-2.0", "permissive", ["apache title"]),
    ("MPL-2.0", "copyleft", ["mpl form"]),
    ("MPL-2.0", "copyleft", ["mpl title"]),
    ("EPL-2.0", "copyleft", ["epl header"]),
    ("EPL-2.0", "copyleft", ["epl title"]),
    ("BSL-1.0", "permissive", ["boost grant"]),
    ("CC0-1.0", "public-domain", ["cc0 deed"]),
    ("Unlicense", "public-domain", ["unlicense"]),
    *((name, kind, [f"notice {words}"]) for words, name, kind in NAMED),
    ("all-rights-reserved", "reserved", ["reserved"]),
]
#: The number of each sentence, from 1 in the order above.
NUMBERS = {key: i for i, key in enumerate([*SENTENCES, *(f"notice {words}" for words, _, _ in NAMED)], 1)}
#: Known sentences and their numbers; notices in every wording of a subject, a verb and an article.
LEXICON = {text: NUMBERS[key] for key, text in SENTENCES.items()}
for _words, _, _ in NAMED:
    for _subject in SUBJECTS:
        for _verb in VERBS:
            for _under in UNDER:
                LEXICON.setdefault(f"{_subject} {_verb} {_under}{_words}".strip(), NUMBERS[f"notice {_words}"])
LONGEST = max(map(len, LEXICON))
PIECES = LONGEST // 2 + 1  # no known sentence lies in more, as each holds a character and a gap


def _form(keys: list[str]) -> str:
    return "".join(f"<{NUMBERS[k]}>" for k in keys)


def _starts() -> dict[str, list[str]]:
    """Known sentences by their first two words, and by the first alone; longest first."""
    out: dict[str, list[str]] = {}
    for s in sorted(LEXICON, key=lambda s: (-len(s), s)):
        for n in (1, 2):
            out.setdefault(" ".join(s.split()[:n]), []).append(s)
    return out


def _openings() -> str:
    """A pattern of the first three words of every known sentence, where a piece may begin in a lower-case text."""
    tree: dict[str, dict] = {}
    for s in LEXICON:
        node = tree
        for word in s.split()[:3]:
            node = node.setdefault(word, {})

    def pattern(node: dict[str, dict]) -> str:
        return "(?:" + "|".join(w + (f"[^a-z0-9]+{pattern(inner)}" if inner else "") for w, inner in sorted(node.items())) + ")"

    return f"(?:^|[\n.!?;:])[^a-z0-9]*{pattern(tree)}"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentences (the known ones, as <number> in order, / where a gap ends a sequence), n_known, licenses and
    kinds (in rule order, joined by commas), n_matches."""
    def pieces(t: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(t, "\n[^a-z0-9\n]+", "\n"), "[.!?;:]+(?:[ \t\r\n]+|$)", "\n\n")
        return F.regexp_replace(t, "[^a-z0-9\n]+", " ")

    text = _once(F.lower(F.coalesce("text", F.lit(""))), lambda t: F.when(t.rlike(_openings()), pieces(t)).otherwise(""))
    starts = _starts()
    begin = "substring_index(x, ' ', 2)"
    like = ", ".join(f"'{s}'" for s in starts)
    known = "map(" + ", ".join(f"'{k}', array(" + ", ".join(f"struct('{s}' as s, {LEXICON[s]} as id)" for s in ss) + ")" for k, ss in starts.items()) + ")"
    fits = "c -> startswith(p, c.s) and (length(p) = length(c.s) or substr(r, length(c.s) + 1, 1) = '\\n')"
    one = "if(size(h) = 0, null, struct(i as i, i + size(split(substr(r, 1, length(h[0].s)), '\\n')) - 1 as j, h[0].id as id))"
    hit = _let(f"array_join(slice(l, i + 1, {PIECES}), '\\n')", "r", _let("translate(r, '\\n', ' ')", "p", _let(f"filter(element_at({known}, {begin}), {fits})", "h", one)))
    every = _let("if(__t = '', array(), transform(split(__t, '\\n'), x -> trim(x)))", "l", f"filter(transform(l, (x, i) -> if({begin} in ({like}), {hit}, null)), x -> x is not null)")
    alone = _let(every, "f", "filter(f, x -> not exists(f, y -> y.i < x.i and x.i <= y.j))")
    line = f"array_join(transform(f, (x, k) -> concat(if(x.i - get(f, k - 1).j > {GAP}, '/', ''), '<', x.id, '>')), '')"
    rules = "array(" + ", ".join(f"named_struct('form', '{_form(keys)}', 'name', '{a}', 'kind', '{k}')" for a, k, keys in RULES) + ")"
    times = "cast((length(a.s) - length(replace(a.s, r.form, ''))) / length(r.form) as bigint)"
    start = "named_struct('s', s, 'names', cast(array() as array<string>), 'kinds', cast(array() as array<string>), 'n', 0L)"
    step = (
        "(a, r) -> if(contains(a.s, r.form), named_struct('s', replace(a.s, r.form, '|'), 'names', concat(a.names, array(r.name)), 'kinds', concat(a.kinds, array(r.kind)),"
        f" 'n', a.n + {times}), a)"
    )
    matched = f"if(s = '', {start}, aggregate({rules}, {start}, {step}))"
    numbers = _let(alone, "f", f"struct({line} as s, cast(size(f) as bigint) as n)")
    held = docs.select("doc_id", text.alias("__t")).select("doc_id", F.expr(_let(numbers, "x", f"struct(x.s as sentences, x.n as n_known, {_let('x.s', 's', matched)} as m)")).alias("f"))
    joined = lambda c: F.array_join(F.array_distinct(c), ",")
    return held.select("doc_id", "f.sentences", "f.n_known", joined("f.m.names").alias("licenses"), joined("f.m.kinds").alias("kinds"), F.col("f.m.n").alias("n_matches"))


def oracle() -> str:
    """The same as SQL."""
    starts = "[" + ", ".join(f"'{s}'" for s in _starts()) + "]"
    known = "[" + ", ".join(f"{{'s': '{s}', 'id': {LEXICON[s]}}}" for s in sorted(LEXICON, key=lambda s: (-len(s), s))) + "]"
    steps, last = [], "s0"
    for i, (name, kind, keys) in enumerate(RULES):
        form = _form(keys)
        steps.append(
            f"r{i} AS (SELECT * EXCLUDE (s, names, kinds, n), replace(s, '{form}', '|') AS s, CASE WHEN contains(s, '{form}') THEN list_append(names, '{name}') ELSE names END AS names,"
            f" CASE WHEN contains(s, '{form}') THEN list_append(kinds, '{kind}') ELSE kinds END AS kinds, n + (length(s) - length(replace(s, '{form}', ''))) // {len(form)} AS n FROM {last})"
        )
        last = f"r{i}"
    once = lambda c: f"array_to_string(list_filter({c}, lambda x, i: list_position({c}, x) = i), ',')"
    return f"""
WITH t AS (SELECT row_number() OVER () AS d, doc_id, list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\\n[^a-z0-9\\n]+', chr(10), 'g'),
  '[.!?;:]+(?:[ \\t\\r\\n]+|$)', chr(10) || chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)), lambda x: trim(x)) AS l FROM documents),
p AS (SELECT d, l, unnest(range(1, len(l) + 1)) AS i FROM t),
b AS (SELECT d, i, array_to_string(l[i : i + {PIECES - 1}], chr(10)) AS r FROM p WHERE list_contains({starts}, array_to_string(string_split(l[i], ' ')[1:2], ' '))),
k AS (SELECT d, i, r, list_filter({known}, lambda c: starts_with(replace(r, chr(10), ' '), c.s) AND (length(r) = length(c.s) OR substr(r, length(c.s) + 1, 1) = chr(10)))[1] AS c FROM b),
h AS (SELECT d, i, i + len(string_split(substr(r, 1, length(c.s)), chr(10))) - 1 AS j, c.id AS id FROM k WHERE c IS NOT NULL),
a AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h y WHERE y.d = h.d AND y.i < h.i AND h.i <= y.j)),
g AS (SELECT d, i, id, i - lag(j) OVER (PARTITION BY d ORDER BY i) AS gap FROM a),
f AS (SELECT d, string_agg(CASE WHEN gap > {GAP} THEN '/' ELSE '' END || '<' || id || '>', '' ORDER BY i) AS s, count(*) AS n FROM g GROUP BY d),
s0 AS (SELECT doc_id, coalesce(f.s, '') AS sentences, CAST(coalesce(f.n, 0) AS BIGINT) AS n_known, coalesce(f.s, '') AS s, CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS kinds, CAST(0 AS BIGINT) AS n
  FROM t LEFT JOIN f USING (d)),
{", ".join(steps)}
SELECT doc_id, sentences, n_known, coalesce({once('names')}, '') AS licenses, coalesce({once('kinds')}, '') AS kinds, CAST(n AS BIGINT) AS n_matches FROM {last}"""
