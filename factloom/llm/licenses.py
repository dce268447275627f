"""License scans: ordered signature rules with keyword prefilter, priority and interval containment.

A text is lower-cased (A-Z) and cut into words, runs of ASCII letters and digits and of anything
beyond ASCII. The rules are regular expressions over the words joined by single spaces: sentences of
license texts and notices (``SIGNATURES``, ``NOTICES``) and, from a table of license families, their
identifiers, names with versions and grants; see :func:`rules`. Each rule has keywords, and only rules whose keywords all occur among the text's words
are tried: one set intersection with the text's words skips nearly all of them.

Detections are intervals of words. They are taken by priority (references by identifier before
full names, full names before bare mentions), in a class longer ones first, of equal ones the first
label; a detection that lies inside one of a class above or of its own is suppressed. Base phrases are never suppressed: each place where a
phrase's words stand consecutively counts.

The score is the weight of the strongest detection left (an identifier line 1.0, a grant 0.9, a name
with version 0.8, a name 0.6, a bare mention 0.4), 0 without any.

Defined cases: null texts count as empty (no words, nulls for the places, empty labels, score 0);
repeated rows are reported alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Phrase and label.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: License families: label, identifier stem, name as words, versions.
FAMILIES = (
    ("gpl", "gpl", "gnu general public license", ("1 0", "2 0", "3 0", "2", "3")),
    ("lgpl", "lgpl", "gnu (?:lesser|library) general public license", ("2 0", "2 1", "3 0", "3")),
    ("agpl", "agpl", "gnu affero general public license", ("1 0", "3 0", "3")),
    ("gfdl", "gfdl", "gnu free documentation license", ("1 1", "1 2", "1 3")),
    ("apache", "apache", "apache (?:software )?license", ("1 0", "1 1", "2 0", "2")),
    ("mit", "mit", "mit license", ()),
    ("mit", "mit 0", "mit no attribution license", ()),
    ("bsd", "bsd", "bsd license", ()),
    ("bsd-2-clause", "bsd 2 clause", "(?:simplified bsd|freebsd|bsd 2 clause) license", ()),
    ("bsd-3-clause", "bsd 3 clause", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause) license", ()),
    ("bsd-4-clause", "bsd 4 clause", "(?:original bsd|bsd 4 clause) license", ()),
    ("mpl", "mpl", "mozilla public license", ("1 0", "1 1", "2 0")),
    ("epl", "epl", "eclipse public license", ("1 0", "2 0")),
    ("edl", "edl", "eclipse distribution license", ("1 0",)),
    ("cddl", "cddl", "common development and distribution license", ("1 0", "1 1")),
    ("cpl", "cpl", "common public license", ("1 0",)),
    ("artistic", "artistic", "artistic license", ("1 0", "2 0")),
    ("isc", "isc", "isc license", ()),
    ("zlib", "zlib", "zlib license", ()),
    ("boost", "bsl", "boost software license", ("1 0",)),
    ("unlicense", "unlicense", "the unlicense", ()),
    ("wtfpl", "wtfpl", "do what the fuck you want to public license", ("2",)),
    ("python", "psf", "python software foundation license", ("2", "2 0")),
    ("eupl", "eupl", "european union public li[cs]ence", ("1 0", "1 1", "1 2")),
    ("osl", "osl", "open software license", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "afl", "academic free license", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("ms-pl", "ms pl", "microsoft public license", ()),
    ("ms-rl", "ms rl", "microsoft reciprocal license", ()),
    ("ofl", "ofl", "(?:sil )?open font license", ("1 0", "1 1")),
    ("odbl", "odbl", "open database license", ("1 0",)),
    ("odc-by", "odc by", "open data commons attribution license", ("1 0",)),
    ("pddl", "pddl", "public domain dedication and license", ("1 0",)),
    ("cc0", "cc0", "cc0 public domain dedication", ("1 0",)),
    ("cc-by", "cc by", "creative commons attribution(?: license)?", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc by sa", "creative commons attribution share ?alike(?: license)?", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc by nd", "creative commons attribution no ?deriv(?:s|atives)(?: license)?", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc by nc", "creative commons attribution non ?commercial(?: license)?", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc by nc sa", "creative commons attribution non ?commercial share ?alike(?: license)?", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "cc by nc nd", "creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: license)?", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("postgresql", "postgresql", "postgresql license", ()),
    ("ruby", "ruby", "ruby license", ()),
    ("php", "php", "php license", ("3 0", "3 01")),
    ("openssl", "openssl", "openssl license", ()),
    ("ncsa", "ncsa", "university of illinois ncsa open source license", ()),
    ("upl", "upl", "universal permissive license", ("1 0",)),
    ("sspl", "sspl", "server side public license", ("1",)),
    ("busl", "busl", "business source license", ("1 0", "1 1")),
    ("elastic", "elastic", "elastic license", ("2 0",)),
    ("openrail", "openrail", "(?:responsible ai|openrail|open rail) license", ()),
    ("cecill", "cecill", "cecill license", ("1 0", "1 1", "2 0", "2 1")),
    ("ipl", "ipl", "ibm public license", ("1 0",)),
    ("qpl", "qpl", "q public license", ("1 0",)),
    ("lppl", "lppl", "latex project public license", ("1 0", "1 2", "1 3")),
    ("w3c", "w3c", "w3c software notice and license", ()),
    ("hippocratic", "hippocratic", "hippocratic license", ("2 1",)),
    ("blueoak", "blueoak", "blue oak model license", ("1 0 0",)),
    ("mulan-psl", "mulanpsl", "mulan (?:psl|permissive software license)", ("1 0", "2 0")),
    ("vim", "vim", "vim license", ()),
    ("sleepycat", "sleepycat", "sleepycat license", ()),
    ("json", "json", "json license", ()),
)

#: Phrases of grants and notices: label, pattern, keywords.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("permission", "hereby")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", ("permission", "distribute")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution", "binary")),
    ("bsd-3-clause", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse", ("endorse", "contributors")),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", ("advertising", "materials")),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file", ("apache", "licensed")),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", ("redistribute", "gnu")),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", ("redistribute", "gnu")),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license", ("redistribute", "affero")),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla", "subject")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("warranty", "liable")),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", ("permission", "organization")),
    ("public-domain", "(?:released|dedicated|placed|donated) (?:in|in to|into|to) the public domain", ("public", "domain")),
    ("proprietary", "all rights reserved", ("rights", "reserved")),
    ("proprietary", "(?:proprietary and confidential|confidential and proprietary)", ("proprietary", "confidential")),
    ("copyright", "copyright (?:c |© )?(?:19|20)[0-9]{2}", ("copyright",)),
    ("cc-by-sa", "cc by sa [1-4] [05]", ("cc", "sa")),
    ("cc-by-nc", "cc by nc [1-4] [05]", ("cc", "nc")),
    ("cc-by", "creativecommons org licenses by [1-4] [05]", ("creativecommons",)),
    ("cc-by-sa", "creativecommons org licenses by sa [1-4] [05]", ("creativecommons", "sa")),
    ("cc-by-nc", "creativecommons org licenses by nc [1-4] [05]", ("creativecommons", "nc")),
    ("cc-by-nd", "creativecommons org licenses by nd [1-4] [05]", ("creativecommons", "nd")),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa [1-4] [05]", ("creativecommons", "nc", "sa")),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd [1-4] [05]", ("creativecommons", "nc", "nd")),
    ("cc0", "creativecommons org publicdomain zero [1-4] [05]", ("creativecommons", "publicdomain")),
    ("apache", "apache org licenses license 2 0", ("apache", "org")),
    ("mit", "opensource org licenses mit", ("opensource", "mit")),
    ("gpl", "gnu org licenses(?: old licenses)? gpl", ("gnu", "gpl")),
)

#: Sentences of license texts, as their words; ``|`` and ``?`` as in patterns. Label and phrases.
SIGNATURES = (
    ("mit", (
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability",
    )),
    ("isc", (
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted",
        "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    )),
    ("bsd", (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer",
        "this software is provided by the (?:copyright holders and contributors|regents and contributors|author|authors) as is and any express or implied warranties",
        "or business interruption however caused and on any theory of liability",
    )),
    ("bsd-3-clause", ("may be used to endorse or promote products derived from this software without specific prior written permission",)),
    ("bsd-4-clause", ("this product includes software developed by", "acknowledg(?:e)?ment this product includes software developed")),
    ("apache", (
        "terms and conditions for use reproduction and distribution",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license",
        "such license applies only to those patent claims licensable by such contributor",
        "if the work includes a notice text file as part of its distribution",
        "this product includes software developed by the apache software foundation",
    )),
    ("gpl", (
        "this program is free software you can redistribute it and or modify it",
        "the gnu general public license is a free copyleft license for software and other kinds of works",
        "the licenses for most software are designed to take away your freedom to share and change it",
        "you should have received a copy of the gnu general public license along with this program",
        "either version [123] of the license or (?:at your option )?any later version",
        "when we speak of free software we are referring to freedom not price",
        "you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program",
        "this license gives no permission to license the work in any other way",
        "each time you convey a covered work the recipient automatically receives a license from the original licensors",
        "mere aggregation of another work not based on the program",
    )),
    ("lgpl", (
        "you should have received a copy of the gnu (?:lesser|library) general public license along with this library",
        "this library is free software you can redistribute it and or modify it",
        "a work that uses the library",
        "the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license",
        "combined work is a work produced by combining or linking an application with the library",
    )),
    ("agpl", (
        "you should have received a copy of the gnu affero general public license along with this program",
        "remote network interaction use with the gnu general public license",
        "must prominently offer all users interacting with it remotely through a computer network",
    )),
    ("gfdl", (
        "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",
        "with no invariant sections no front cover texts and no back cover texts",
    )),
    ("mpl", (
        "if a copy of the mpl was not distributed with this file you can obtain one at",
        "this source code form is incompatible with secondary licenses",
        "the contents of this file are subject to the mozilla public license",
        "each contributor hereby grants you a world wide royalty free non exclusive license",
    )),
    ("epl", (
        "the accompanying program is provided under the terms of this eclipse public license",
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
        "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement",
    )),
    ("cddl", ("the contents of this file are subject to the terms of the common development and distribution license", "you can obtain a copy of the license at usr src opensolaris license")),
    ("cpl", ("the accompanying program is provided under the terms of this common public license",)),
    ("artistic", (
        "the intent of this document is to state the conditions under which a package may be copied",
        "this license establishes the terms under which a given free software package may be copied modified distributed",
        "you may make and give away verbatim copies of the source form of the standard version",
    )),
    ("zlib", (
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
        "this notice may not be removed or altered from any source distribution",
    )),
    ("boost", (
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
        "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor",
        "distributed under the boost software license version 1 0",
    )),
    ("unlicense", (
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary",
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest",
        "for more information please refer to (?:http|https) unlicense org",
    )),
    ("wtfpl", ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", "you just do what the fuck you want to")),
    ("python", ("this license agreement is between the python software foundation psf and the individual or organization licensee", "psf hereby grants licensee a nonexclusive royalty free world wide license")),
    ("eupl", ("licensed under the eupl", "this european union public licence applies to the work")),
    ("osl", ("this open software license applies to any original work of authorship", "licensed under the open software license")),
    ("afl", ("this academic free license applies to any original work of authorship", "licensed under the academic free license")),
    ("ms-pl", ("this license governs use of the accompanying software if you use the software you accept this license",)),
    ("ofl", (
        "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects",
        "this font software is licensed under the sil open font license",
        "neither the font software nor any of its individual components in original or modified versions may be sold by itself",
    )),
    ("odbl", ("this database is made available under the open database license", "any rights in individual contents of the database are licensed under the database contents license")),
    ("odc-by", ("this database is made available under the open data commons attribution license",)),
    ("pddl", ("the open data commons public domain dedication license is a document intended to allow you to freely share modify and use this work",)),
    ("cc0", (
        "the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights",
        "to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights to",
        "no copyright and related rights the person who associated a work with this deed has dedicated the work to the public domain",
    )),
    ("cc-by", (
        "this work is licensed under a creative commons attribution [1-4] [05] (?:international|unported|generic) license",
        "you must give appropriate credit provide a link to the license and indicate if changes were made",
        "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution",
    )),
    ("cc-by-sa", (
        "this work is licensed under a creative commons attribution share ?alike",
        "if you remix transform or build upon the material you must distribute your contributions under the same license as the original",
        "text is available under the creative commons attribution share ?alike license",
    )),
    ("cc-by-nc", ("this work is licensed under a creative commons attribution non ?commercial [1-4] [05]", "you may not use the material for commercial purposes")),
    ("cc-by-nd", ("this work is licensed under a creative commons attribution no ?deriv(?:s|atives)", "if you remix transform or build upon the material you may not distribute the modified material")),
    ("cc-by-nc-sa", ("this work is licensed under a creative commons attribution non ?commercial share ?alike",)),
    ("cc-by-nc-nd", ("this work is licensed under a creative commons attribution non ?commercial no ?deriv(?:s|atives)",)),
    ("postgresql", ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",)),
    ("php", ("this product includes php software freely available from", "products derived from this software may not be called php nor may php appear in their name")),
    ("openssl", ("this product includes software developed by the openssl project", "products derived from this software may not be called openssl nor may openssl appear in their names")),
    ("ncsa", ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal with the software without restriction", "neither the names of .{1,80}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission university of illinois")),
    ("upl", ("subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data",)),
    ("sspl", ("if you make the functionality of the program or a modified version available to third parties as a service", "the server side public license")),
    ("busl", ("the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "change date change license")),
    ("elastic", ("you may not provide the software to third parties as a hosted or managed service", "the licensor grants you a non exclusive royalty free worldwide non sublicensable non transferable license")),
    ("openrail", ("use based restrictions as referenced in paragraph 5", "you agree not to use the model or derivatives of the model")),
    ("cecill", ("this software is governed by the cecill(?: [abc])? license", "this agreement is a free software license agreement that is the result of discussions between its authors")),
    ("ipl", ("the accompanying program is provided under the terms of this ibm public license",)),
    ("lppl", ("this work may be distributed and or modified under the conditions of the latex project public license", "this work has the lppl maintenance status")),
    ("w3c", ("this work is being provided by the copyright holders under the following license", "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply")),
    ("blueoak", ("this license gives everyone as much permission to work with this software as possible while protecting contributors from liability",)),
    ("mulan-psl", ("you can use this software according to the terms and conditions of the mulan psl",)),
    ("vim", ("there are no restrictions on distributing unmodified copies of vim except that they must include this license text",)),
    ("json", ("the software shall be used for good not evil",)),
    ("beerware", ("as long as you retain this notice you can do whatever you want with this stuff", "if we meet some day and you think this stuff is worth it you can buy me a beer")),
    ("curl", ("except as contained in this notice the name of a copyright holder shall not be used in advertising",)),
    ("x11", ("except as contained in this notice the name of the x consortium shall not be used in advertising",)),
    ("freetype", ("portions of this software are copyright .{1,40}? the freetype project", "the freetype project license")),
    ("libpng", ("the png reference library is supplied as is", "this copy of the libpng notices is provided for your convenience")),
    ("ijg", ("this software is based in part on the work of the independent jpeg group",)),
    ("bzip2", ("the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment",)),
    ("public-domain", ("this (?:file|work|software|code|document) is (?:hereby )?(?:placed )?in the public domain", "the author disclaims copyright to this source code in place of a legal notice here is a blessing", "no rights reserved")),
    ("proprietary", (
        "unauthorized copying of this file via any medium is strictly prohibited",
        "this software is the confidential and proprietary information of",
        "no part of this (?:publication|document|book|work) may be reproduced",
        "may not be reproduced(?: stored| copied| distributed)? .{0,60}?without (?:the )?(?:prior )?written permission",
        "not for redistribution",
        "for internal use only",
    )),
)

IDENTIFIER, GRANT, VERSIONED, NAMED, MENTION = 0, 1, 2, 3, 4
WEIGHT = {IDENTIFIER: 1.0, GRANT: 0.9, VERSIONED: 0.8, NAMED: 0.6, MENTION: 0.4}
_KEEP = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    pattern: bytes
    keywords: frozenset[bytes]


def _keywords(pattern: str) -> frozenset[bytes]:
    """Words that every match of the pattern holds: those outside groups and optional parts, and that no optional space joins to another."""
    plain = re.sub(r"\(\?:[^()|]* \)\?|\(\?: [^()|]*(?:\| [^()|]*)*\)\?", "", pattern)  # groups of whole words
    plain = re.sub(r"\(\?:[^()]*\)\??", "*", plain)
    plain = re.sub(r"\S+ \?\S+", "*", plain)
    return frozenset(w.encode() for w in plain.split() if not re.search(r"[?\[\]{}.*\\|()]", w))


def rules() -> tuple[Rule, ...]:
    """The rules in order of priority: for each family identifier lines, grants, versions, the name and short mentions."""
    out: dict[tuple[int, str, str], frozenset[bytes]] = {}

    def add(priority: int, label: str, pattern: str) -> None:
        out[priority, label, pattern] = _keywords(pattern)

    for label, stem, name, versions in FAMILIES:
        tail = "(?: only| or later| plus)?"
        for v in (*versions, ""):
            ident, full = f"{stem} {v}".strip(), f"{name}(?: v| version)? ?{v}" if v else name
            add(IDENTIFIER, label, f"spdx license identifier {ident}{tail}")
            add(GRANT, label, f"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?{full}")
            if v:
                add(VERSIONED, label, full)
                add(VERSIONED, label, f"{stem} v?{v}{tail}")
        add(NAMED, label, name)
        if label != "unlicense" and f"{stem} license" != name:
            add(MENTION, label, f"{stem} licen[cs]ed?")
    for label, pattern, keywords in NOTICES:
        out[GRANT, label, pattern] = frozenset(k.encode() for k in keywords)
    for label, phrases in SIGNATURES:
        for pattern in phrases:
            add(GRANT, label, pattern)
    made = [Rule(p, label, rb"(?<![^ ])" + pattern.encode() + rb"(?![^ ])", keys) for (p, label, pattern), keys in out.items()]
    return tuple(sorted(made, key=lambda r: (r.priority, r.label, r.pattern)))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_KEEP).split()


RULES = rules()


@cache
def _compiled(pattern: bytes) -> re.Pattern[bytes]:
    """Each worker compiles a rule when it first needs it; there are more rules than the cache of ``re`` holds."""
    return re.compile(pattern)


def detect(found: list[bytes]) -> list[tuple[int, int, int, str]]:
    """(first word, end word, priority, label) of what is left after suppression, in order of place."""
    kinds = set(found)
    tried = [r for r in RULES if r.keywords <= kinds]
    if not tried:
        return []
    line = b" ".join(found)
    begins = list(accumulate((len(w) + 1 for w in found), initial=0))
    hits: set[tuple[int, int, int, str]] = set()
    for r in tried:
        for m in _compiled(r.pattern).finditer(line):
            lo = bisect_right(begins, m.start()) - 1
            hits.add((lo, lo + m.group().count(b" ") + 1, r.priority, r.label))
    kept: list[tuple[int, int, int, str]] = []
    for priority in sorted({h[2] for h in hits}):
        kept.sort()
        starts, reach = [k[0] for k in kept], list(accumulate((k[1] for k in kept), max))
        far = 0  # the furthest end in this class so far; the longest at a place comes first
        for hit in sorted((h for h in hits if h[2] == priority), key=lambda h: (h[0], -h[1], h[3])):
            before = bisect_right(starts, hit[0])
            if hit[1] > far and not (before and reach[before - 1] >= hit[1]):
                kept.append(hit)
            far = max(far, hit[1])
    return sorted(kept)


_PHRASES = tuple((tuple(w.encode() for w in phrase.split()), label) for phrase, label in BASE)


def base_places(found: list[bytes]) -> list[tuple[int, str]]:
    """Every place of a base phrase."""
    out = []
    kinds = set(found)
    for phrase, label in _PHRASES:
        if not kinds.issuperset(phrase):
            continue
        at = -1
        for _ in range(found.count(phrase[0])):
            at = found.index(phrase[0], at + 1)
            if tuple(found[at : at + len(phrase)]) == phrase:
                out.append((at, label))
    return sorted(out)


def scan_text(text: bytes | None) -> tuple[int, int, int | None, int | None, str, str, float, list[tuple[int, int, int, str]]]:
    found = words(text)
    base, spans = base_places(found), detect(found)
    labels = {label for _, label in base}
    return (
        len(found), len(base), min((p for p, _ in base), default=None), max((p for p, _ in base), default=None),
        ",".join(sorted(labels)), ",".join(sorted(labels | {s[3] for s in spans})),
        max([WEIGHT[s[2]] for s in spans] + [WEIGHT[NAMED]] * bool(base), default=0.0), spans,
    )


_FIELDS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:int,end:int,priority:int,label:string>>"


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [scan_text(t) for t in frame["raw"]]
        out = pd.DataFrame(rows, columns=list(_FIELDS))
        out.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy() if frame["doc_id"].isna().any() else frame["doc_id"].to_numpy())
        for c in ("first_word", "last_word"):
            out[c] = pd.array(out[c].tolist(), dtype="Int64")
        out["spans"] = [[dict(zip(("start", "end", "priority", "label"), s, strict=True)) for s in row] for row in out["spans"]]
        yield out


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: words, base places and labels, all labels, score, and the detections as word intervals."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("raw")).mapInPandas(_scan, _SCHEMA)
