"""Licence scan: ordered signature rules behind a keyword filter, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from inkgrade.llm.common import lower_ascii

#: A word: letters, digits and everything beyond ASCII, after A-Z became a-z.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrases whose places are counted, and their labels.
BASE_PHRASES: dict[str, str] = {
    "mit license": "mit", "apache license": "apache", "general public license": "gpl",
}

#: Licences by label, each with the names it goes by.
NAMES: dict[str, list[str]] = {
    "mit": ["mit", "expat", "x11"],
    "apache": ["apache", "apache software", "apache 2 0", "asl 2 0"],
    "gpl": ["gnu general public", "general public", "gnu gpl", "gpl", "gpl 2 0", "gpl 3 0", "gplv2", "gplv3"],
    "lgpl": ["gnu lesser general public", "lesser general public", "library general public", "gnu lgpl", "lgpl"],
    "agpl": ["gnu affero general public", "affero general public", "gnu agpl", "agpl"],
    "gfdl": ["gnu free documentation", "free documentation", "gfdl"],
    "bsd": ["bsd", "new bsd", "simplified bsd", "modified bsd", "bsd 2 clause", "bsd 3 clause", "2 clause bsd",
            "3 clause bsd"],
    "isc": ["isc"],
    "mpl": ["mozilla public", "mpl", "mpl 2 0"],
    "epl": ["eclipse public", "epl", "epl 2 0"],
    "cddl": ["common development and distribution", "cddl"],
    "cpl": ["common public", "cpl"],
    "eupl": ["european union public", "eupl"],
    "artistic": ["artistic", "perl artistic"],
    "boost": ["boost software", "boost", "bsl 1 0"],
    "zlib": ["zlib", "zlib libpng"],
    "python": ["python software foundation", "psf"],
    "php": ["php"],
    "postgresql": ["postgresql"],
    "unlicense": ["unlicense"],
    "wtfpl": ["wtfpl", "do what the fuck you want to public"],
    "ofl": ["sil open font", "open font", "ofl"],
    "ms-pl": ["microsoft public", "ms pl"],
    "odbl": ["open database", "odbl"],
    "cc0": ["cc0", "creative commons zero", "cc0 1 0 universal"],
    "cc-by": ["cc by", "creative commons attribution"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"],
    "cc-by-nd": ["cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs"],
    "cc-by-nc": ["cc by nc", "creative commons attribution noncommercial",
                 "creative commons attribution non commercial"],
    "cc-by-nc-sa": ["cc by nc sa", "creative commons attribution noncommercial sharealike"],
    "cc-by-nc-nd": ["cc by nc nd", "creative commons attribution noncommercial noderivatives"],
    "public-domain": ["public domain"],
    "proprietary": ["proprietary", "commercial", "all rights reserved"],
}

#: Wordings from the most to the least telling, with the words each needs; ``{}`` stands for a name. Texts are words
#: between single blanks. A licence that follows a copyright notice takes its "all rights reserved" along.
NOTICE = "( all rights reserved)?"
VERSION = "( version)?( v?[0-9]+( [0-9]+)?)?"
TERMS = " under( the)?( terms( and conditions)? of( the)?)?( either)?( the)? "
VERBS = " (released|distributed|redistributed|available|published|provided|offered|shared|covered|licen[sc]ing|usable)"
WORDINGS: list[tuple[int, str, str]] = [
    (4, " spdx license identifier ", " spdx license identifier {}( [0-9]+)*( only| or later)?(?= )"),
    (4, " spdx license identifier ", "(?<= spdx license identifier [a-z0-9]{{1,20}}" + "( [a-z0-9]{{1,20}})?" * 11
        + ") (or|and) {}( [0-9]+)*( only| or later)?(?= )"),
    (3, "licen", NOTICE + " (dual |sub)?licen[sc]ed" + TERMS + "{}( public)?( international)?( licen[sc]e)?" + VERSION
        + "(?= )"),
    (3, "licen", NOTICE + VERBS + TERMS + "{} licen[sc]e" + VERSION + "(?= )"),
    (2, "licen", " {} licen[sc]e" + VERSION + "(?= )"),
    (2, "licen", " licen[sc]e( is| identifier| type| name)?( the)? {}" + VERSION + "(?= )"),
]
#: Wording for the names that mean nothing but a licence.
ALONE = (3, " under ", NOTICE + VERBS + TERMS + "{}( [0-9]+)*(?= )")
#: Names that are also words of their own, and tell nothing without "license" behind them.
PLAIN_WORDS = {
    "apache", "apache software", "general public", "lesser general public", "library general public",
    "affero general public", "free documentation", "mit", "expat", "x11", "bsd", "isc", "mozilla public",
    "eclipse public", "common development and distribution", "common public", "european union public", "artistic",
    "perl artistic", "boost software", "boost", "python software foundation", "psf", "php", "postgresql", "open font",
    "microsoft public", "ms pl", "open database", "proprietary", "commercial", "all rights reserved", "zlib",
    "gnu general public", "gnu lesser general public", "gnu affero general public", "gnu free documentation",
    "epl", "cpl", "mpl", "ofl", "public domain", "sil open font", "do what the fuck you want to public",
}
#: Names after "license" as a field, where a plain word would start another sentence.
_FIELD = 5

#: Phrases of notices and licence texts, as words between single blanks, with label and priority. Where ``*`` stands,
#: up to twelve words of any kind may.
PHRASES: dict[str, list[tuple[int, str]]] = {
    "mit": [
        (4, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
        (3, "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
        (3, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
        (2, "except as contained in this notice the name * shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
        (3, "opensource org licenses mit"), (3, "mit style license"), (2, "mit licensed"), (2, "mit x11 license"),
    ],
    "apache": [
        (4, "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
        (4, "apache license version 2 0 january 2004"), (3, "www apache org licenses license 2 0"),
        (3, "apache org licenses"), (3, "opensource org licenses apache 2 0"),
        (3, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
        (3, "this product includes software developed by the apache software foundation"),
        (3, "the names apache and apache software foundation must not be used to endorse"), (2, "apache 2 0 licensed"),
        (2, "apache licensed"),
    ],
    "gpl": [
        (4, "you can redistribute it and or modify it under the terms of the gnu general public license"),
        (3, "see the gnu general public license for more details"),
        (3, "you should have received a copy of the gnu general public license"),
        (3, "the gnu general public license is a free copyleft license for software and other kinds of works"),
        (3, "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license"),
        (3, "gnu org licenses gpl"), (3, "gnu org copyleft gpl"), (3, "opensource org licenses gpl"),
        (2, "gpl licensed"), (2, "gpl compatible license"),
        (2, "this program comes with absolutely no warranty"),
        (2, "this is free software and you are welcome to redistribute it under certain conditions"),
    ],
    "lgpl": [
        (4, "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
        (4, "you can redistribute it and or modify it under the terms of the gnu library general public license"),
        (3, "see the gnu lesser general public license for more details"),
        (3, "see the gnu library general public license for more details"),
        (3, "you should have received a copy of the gnu lesser general public license"),
        (3, "you should have received a copy of the gnu library general public license"),
        (3, "this license the lesser general public license applies to some specially designated software packages"),
        (3, "gnu org licenses lgpl"), (3, "gnu org copyleft lesser"), (3, "opensource org licenses lgpl"),
        (2, "lgpl licensed"),
    ],
    "agpl": [
        (4, "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
        (3, "see the gnu affero general public license for more details"),
        (3, "you should have received a copy of the gnu affero general public license"),
        (3, "specifically designed to ensure cooperation with the community in the case of network server software"),
        (3, "gnu org licenses agpl"), (3, "opensource org licenses agpl"), (2, "agpl licensed"),
    ],
    "gfdl": [
        (4, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
        (3, "with no invariant sections no front cover texts and no back cover texts"),
        (3, "the purpose of this license is to make a manual textbook or other functional and useful document free"),
        (3, "gnu org licenses fdl"), (3, "gnu org copyleft fdl"), (3, "gnu org licenses gfdl"),
    ],
    "bsd": [
        (4, "redistribution and use in source and binary forms with or without modification are permitted"),
        (3, "redistributions of source code must retain the above copyright notice"),
        (3, "redistributions in binary form must reproduce the above copyright notice"),
        (3, "may be used to endorse or promote products derived from this software without specific prior written permission"),
        (3, "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
        (3, "this software is provided by the copyright holders and contributors as is"),
        (3, "this software is provided by the regents and contributors as is"),
        (3, "opensource org licenses bsd"), (3, "bsd style license"), (2, "bsd licensed"),
    ],
    "isc": [
        (4, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
        (4, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
        (3, "opensource org licenses isc"),
    ],
    "0bsd": [
        (4, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ],
    "mpl": [
        (4, "this source code form is subject to the terms of the mozilla public license"),
        (4, "the contents of this file are subject to the mozilla public license"),
        (3, "if a copy of the mpl was not distributed with this file you can obtain one at"),
        (3, "mozilla org mpl"), (3, "opensource org licenses mpl"),
    ],
    "epl": [
        (4, "the accompanying program is provided under the terms of this eclipse public license"),
        (4, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
        (3, "eclipse org legal epl"), (3, "opensource org licenses epl"), (3, "eclipse org org documents epl"),
    ],
    "edl": [(3, "eclipse distribution license"), (3, "eclipse org org documents edl")],
    "cddl": [
        (4, "the contents of this file are subject to the terms of the common development and distribution license"),
        (3, "opensource org licenses cddl"), (3, "when distributing covered code include this cddl header in each file"),
    ],
    "cpl": [
        (4, "the accompanying program is provided under the terms of this common public license"),
        (3, "opensource org licenses cpl"),
    ],
    "ipl": [(3, "ibm public license")],
    "eupl": [
        (4, "licensed under the eupl version"), (3, "joinup ec europa eu software page eupl"),
        (3, "this european union public licence the eupl applies to the work"), (3, "licence eupl"),
    ],
    "artistic": [
        (4, "you can redistribute it and or modify it under the same terms as perl itself"),
        (3, "under the same terms as perl itself"), (3, "the same terms as the perl 5 programming language"),
        (3, "the intent of this document is to state the conditions under which a package may be copied"),
        (3, "opensource org licenses artistic"), (3, "perlfoundation org artistic license"),
    ],
    "boost": [
        (4, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
        (3, "distributed under the boost software license"), (3, "boost org license 1 0"),
    ],
    "zlib": [
        (4, "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
        (3, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
        (3, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
        (3, "opensource org licenses zlib"),
    ],
    "libpng": [(3, "the png reference library is supplied as is")],
    "libtiff": [(3, "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee provided that * the names of sam leffler")],
    "hpnd": [
        (3, "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
        (3, "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ],
    "openssl": [
        (4, "this product includes software developed by the openssl project for use in the openssl toolkit"),
        (3, "this product includes cryptographic software written by eric young"), (3, "openssl license"),
    ],
    "curl": [(3, "curl license"), (3, "curl haxx se docs copyright")],
    "ncsa": [(3, "university of illinois ncsa open source license"), (3, "illinois open source license"), (3, "ncsa open source license")],
    "w3c": [(3, "w3c software notice and license"), (3, "w3c software and document notice and license"), (3, "w3c document license")],
    "python": [
        (4, "psf hereby grants licensee a nonexclusive royalty free world wide license"),
        (3, "this license agreement is between the python software foundation"), (3, "psf license agreement for python"),
        (3, "beopen python open source license agreement"), (3, "cnri open source license agreement"),
    ],
    "php": [(4, "this source file is subject to version * of the php license"), (3, "php net license"),
            (3, "this product includes php software freely available from")],
    "postgresql": [
        (4, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
        (3, "in no event shall the university of california be liable to any party"),
    ],
    "ruby": [(3, "you can redistribute it and or modify it under either the terms of the 2 clause bsdl"), (3, "ruby license"), (3, "ruby s license"),
             (3, "under the same terms as ruby")],
    "vim": [(3, "vim license"), (3, "there are no restrictions on distributing unmodified copies of vim")],
    "openldap": [(3, "openldap public license")],
    "sleepycat": [(3, "sleepycat license"), (3, "sleepycat public license")],
    "intel": [(3, "intel open source license"), (3, "intel simplified software license")],
    "json": [(3, "the software shall be used for good not evil")],
    "beerware": [(4, "beer ware license"), (4, "beerware license"),
                 (3, "if we meet some day and you think this stuff is worth it you can buy me a beer in return")],
    "unicode": [(3, "unicode inc license agreement"), (3, "unicode license agreement"), (3, "unicode org copyright html")],
    "icu": [(3, "icu license")],
    "upl": [(3, "universal permissive license")],
    "qpl": [(3, "q public license"), (3, "qt public license")],
    "ms-rl": [(3, "microsoft reciprocal license")],
    "ms-pl": [(3, "opensource org licenses ms pl")],
    "afl": [(3, "academic free license"), (3, "licensed under the academic free license")],
    "osl": [(3, "open software license")],
    "apsl": [(3, "apple public source license")],
    "npl": [(3, "netscape public license")],
    "cecill": [(4, "this software is governed by the cecill license"), (3, "cecill license"), (3, "cecill b license"),
               (3, "cecill c license"), (3, "licence cecill"), (3, "cecill info")],
    "bsl": [(3, "business source license"), (3, "mariadb com bsl11")],
    "sspl": [(4, "server side public license"), (3, "mongodb com licensing server side public license")],
    "elastic": [(3, "elastic license")],
    "unlicense": [
        (4, "this is free and unencumbered software released into the public domain"), (3, "unlicense org"),
        (3, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ],
    "wtfpl": [(4, "do what the fuck you want to public license"), (3, "you just do what the fuck you want to"),
              (3, "wtfpl net")],
    "ofl": [
        (4, "this font software is licensed under the sil open font license"), (3, "scripts sil org ofl"),
        (3, "reserved font name"), (3, "openfontlicense org"),
    ],
    "odbl": [(4, "this database is made available under the open database license"),
             (3, "opendatacommons org licenses odbl"), (2, "odbl licensed")],
    "odc-by": [(3, "opendatacommons org licenses by"), (3, "open data commons attribution license")],
    "pddl": [(3, "opendatacommons org licenses pddl"), (3, "public domain dedication and license"),
             (3, "public domain dedication and licence")],
    "ogl": [(3, "open government licence"), (3, "open government license")],
    "cc0": [
        (4, "to the extent possible under law * waived all copyright and related or neighboring rights"),
        (4, "creative commons cc0 1 0 universal"), (4, "cc0 1 0 universal public domain dedication"),
        (3, "creativecommons org publicdomain zero"), (3, "no rights reserved"), (2, "cc0 licensed"),
    ],
    "cc-by": [(3, "creativecommons org licenses by"), (2, "cc by licensed")],
    "cc-by-sa": [(3, "creativecommons org licenses by sa"), (2, "cc by sa licensed")],
    "cc-by-nd": [(3, "creativecommons org licenses by nd"), (2, "cc by nd licensed")],
    "cc-by-nc": [(3, "creativecommons org licenses by nc"), (2, "cc by nc licensed")],
    "cc-by-nc-sa": [(3, "creativecommons org licenses by nc sa"), (2, "cc by nc sa licensed")],
    "cc-by-nc-nd": [(3, "creativecommons org licenses by nc nd"), (2, "cc by nc nd licensed")],
    "public-domain": [
        (3, "released into the public domain"), (3, "placed in the public domain"), (3, "released to the public domain"),
        (3, "dedicated to the public domain"), (3, "is in the public domain"), (3, "are in the public domain"),
        (3, "this file is public domain"), (3, "this code is public domain"), (3, "this work is public domain"),
        (3, "this software is public domain"), (3, "the author disclaims copyright to this source code"),
        (3, "creativecommons org publicdomain mark"), (2, "public domain work"), (2, "public domain dedication"),
        (2, "united states government work"), (2, "not subject to copyright"), (1, "public domain"),
    ],
    "proprietary": [
        (3, "proprietary and confidential"), (3, "confidential and proprietary"), (3, "end user license agreement"),
        (3, "end user licence agreement"), (3, "unauthorized copying of this file via any medium is strictly prohibited"),
        (3, "may not be reproduced in any form without permission"),
        (3, "no part of this publication may be reproduced"), (3, "no part of this book may be reproduced"),
        (3, "no part of this document may be reproduced"), (3, "this software is proprietary"),
        (3, "unlicensed property of"), (3, "for internal use only do not distribute"),
        (2, "licensed not sold"), (2, "trade secret of"), (2, "trade secrets of"),
        (2, "used by permission all rights reserved"), (1, "all rights reserved"), (1, "alle rechte vorbehalten"),
        (1, "tous droits réservés"), (1, "todos los derechos reservados"), (1, "tutti i diritti riservati"),
    ],
}

#: label, keywords, priority, pattern: a rule is tried on the texts that hold all its keywords.
Rule = tuple[str, Sequence[str] | str, int, str]


def signature_rules(
    names: Mapping[str, Sequence[str]] = NAMES, phrases: Mapping[str, Sequence[tuple[int, str]]] = PHRASES,
) -> list[Rule]:
    """Every name in every wording it can stand in, then the phrases, in order."""
    rules: list[Rule] = [
        (label, (needed, f" {name} "), priority, wording.format(name))
        for i, (priority, needed, wording) in enumerate(WORDINGS) for label, known in names.items() for name in known
        if i != _FIELD or name not in PLAIN_WORDS
    ]
    priority, needed, wording = ALONE
    rules += [(label, (needed, f" {name} "), priority, wording.format(name))
              for label, known in names.items() for name in known if name not in PLAIN_WORDS]
    for label, known in phrases.items():
        for priority, phrase in known:
            parts = phrase.split(" * ")
            before = NOTICE if priority > 2 else ""
            rules.append((label, tuple(f" {part} " for part in parts), priority,
                          f"{before} {'( [^ ]+){0,12}? '.join(parts)}(?= )"))
    return rules


def _anchor(keyword: str) -> str:
    """The longest word, which a text with the keyword holds as it is, whatever stands between its words."""
    return max(keyword.split(), key=len)


def _worth_it(low: Column, phrases: Sequence[str], rules: Sequence[Rule]) -> Column:
    """Whether the lower-case text holds a longest word of every keyword of some rule, or that of a phrase."""
    needs: dict[str, set[str]] = {_anchor(p): set() for p in phrases}
    for _, (one, *more), _, _ in sorted(rules, key=lambda r: len(r[1])):
        at = _anchor(one)
        if not more:
            needs[at] = set()
        elif needs.get(at) != set():
            needs.setdefault(at, set()).add(_anchor(max(more, key=len)))
    alone = {a for a, more in needs.items() if not more}
    alone = {a for a in alone if not any(b != a and b in a for b in alone)}
    either = lambda words: reduce(Column.__or__, [low.contains(w) for w in sorted(words)])
    return reduce(Column.__or__, [
        either(alone), *[low.contains(a) & either(more) for a, more in needs.items() if more and a not in alone]
    ])


def _places(phrase: str) -> Column:
    """Word positions, from 0, where the phrase stands in ``norm``: one blank stands before every word."""
    blanks = "length(piece) - length(replace(piece, ' ', ''))"
    return F.expr(f"""
        aggregate(
          split(norm, ' {phrase}(?= )'),
          struct(0 as at, cast(array() as array<int>) as starts),
          (s, piece) -> struct(s.at + {blanks} + {len(phrase.split(" "))} as at,
                               array_append(s.starts, s.at + {blanks}) as starts),
          s -> slice(s.starts, 1, size(s.starts) - 1))""")


_FOUND = "array<struct<start:int, neg_stop:int, neg_priority:int, label:string>>"

# All places of the rules whose keywords are seen: the pieces between the matches and the matches, laid end to end.
# The one-element array makes the keywords a variable, so that they are looked for once a text and not once a rule.
_MATCHES = f"""
    flatten(transform(array(filter({{keywords}}, k -> contains(norm, k))), seen ->
      transform(filter({{rules}}, r -> forall(r.keywords, k -> array_contains(seen, k))), r ->
      aggregate(
        zip_with(split(norm, r.pattern), regexp_extract_all(norm, concat('(', r.pattern, ')'), 1),
                 (piece, hit) -> struct(length(piece) as piece, hit)),
        struct(0 as at, cast(array() as {_FOUND}) as found),
        (s, x) -> struct(
          s.at + coalesce(x.piece, 0) + coalesce(length(x.hit), 0) as at,
          if(x.hit is null, s.found, array_append(s.found, struct(
            s.at + x.piece as start, -(s.at + x.piece + length(x.hit)) as neg_stop,
            -r.priority as neg_priority, r.label as label))) as found),
        s -> s.found))))
"""

# In order of priority, then length, then start, then label: a detection stays if it overlaps none that stayed, so
# nothing is suppressed by one that is itself suppressed. In the end they stand in order of start.
_RESOLVED = f"""
    array_sort(aggregate(
      transform(array_sort(transform(found, d -> struct(
        d.neg_priority, d.start + d.neg_stop as neg_length, d.start, d.label, d))), x -> x.d),
      cast(array() as {_FOUND}),
      (kept, d) -> if(exists(kept, k -> d.start < -k.neg_stop and k.start < -d.neg_stop), kept, array_append(kept, d))))
"""


def scan_licenses(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    phrases: Mapping[str, str] = BASE_PHRASES, rules: Sequence[Rule] | None = None,
) -> DataFrame:
    """(doc_id, n_words, places, detections) of every text.

    ``places`` is a map from phrase to the word positions where its words stand consecutively. ``detections`` are
    (start, stop, priority, label) over the text's words joined by single blanks, one blank in front: rules apply
    where all their keywords occur. Detections are taken by priority, then length, then start, then label, and each
    suppresses what lies within it or overlaps it; ties leave the longer, then the earlier one.

    Only texts with the longest word of a phrase, or of every keyword of a rule, are looked at closely; no text that
    a rule or phrase fits lacks it. Very long texts are scanned whole. Null and empty texts have no words and no
    detections; repeated rows are scanned one by one; an empty table gives no rows; other columns are left out.
    """
    rules = signature_rules() if rules is None else rules
    rules = [(label, (k,) if isinstance(k, str) else tuple(k), priority, p) for label, k, priority, p in rules]
    strings = lambda x: "array({})".format(", ".join(f"'{k}'" for k in x))
    literal = ", ".join(
        f"struct('{label}' as label, {strings(k)} as keywords, {priority} as priority, '{p}' as pattern)"
        for label, k, priority, p in rules
    )
    keywords = strings(dict.fromkeys(k for r in rules for k in r[1]))
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("low", F.lower("text"))
    d = d.select(
        "doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"),
        F.when(_worth_it(F.col("low"), list(phrases), rules), F.concat(
            F.lit(" "), F.trim(F.regexp_replace(lower_ascii(F.col("text")), GAP, " ")), F.lit(" "))).alias("norm"),
    )
    places = F.create_map(*[x for p in phrases for x in (F.lit(p), _places(p))])
    matches = _MATCHES.format(keywords=keywords, rules=f"array({literal})")
    found = F.when(F.col("norm").isNotNull(), F.flatten(F.expr(matches)))
    return d.select(
        "doc_id", "n_words", F.when(F.col("norm").isNotNull(), places).alias("places"), found.alias("found")
    ).select("doc_id", "n_words", "places", F.transform(F.expr(_RESOLVED), lambda x: F.struct(
        x["start"].alias("start"), (-x["neg_stop"]).alias("stop"), (-x["neg_priority"]).alias("priority"), x["label"]
    )).alias("detections"))


def license_digest(scanned: DataFrame, *, phrases: Mapping[str, str] = BASE_PHRASES) -> DataFrame:
    """Counts, labels and a score per text. The score is 0 without a finding, else the strongest finding's weight:
    a counted phrase 0.5, a detection a quarter of its priority."""
    none = F.array().cast("array<int>")
    starts = F.flatten(F.array(*[F.coalesce(F.col("places")[p], none) for p in phrases]))
    base = F.array_compact(F.array(*[
        F.when(F.size(F.coalesce(F.col("places")[p], none)) > 0, label) for p, label in phrases.items()
    ]))
    empty = F.array().cast("array<string>")
    own = F.coalesce(F.transform("detections", lambda x: x["label"]), empty)
    weight = F.coalesce(F.array_max(F.transform("detections", lambda x: x["priority"] * 0.25)), F.lit(0.0))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        F.greatest(weight.cast("double"), F.when(F.size(starts) > 0, 0.5).otherwise(0.0)).alias("score"),
    )
