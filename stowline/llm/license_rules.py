"""The signature rules of the license scan, in order of priority.

Rules match the words of a text: lower case, one space between words, no punctuation (``(c) 2020, The MIT-License`` is
``c 2020 the mit license``). ``RULES`` is built from the table below: by license its identifiers, names, addresses and
telling sentences, each turned into the signatures of its kind. Earlier kinds come first; a rule's keywords are
strings that every text it matches contains.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    kind: str
    keywords: tuple[str, ...]
    pattern: str


#: Kinds in order of priority, and how sure a detection of each is.
KINDS = {"text": 0.95, "tag": 0.9, "grant": 0.85, "address": 0.7, "name": 0.6}

#: SPDX label; identifiers; names; addresses; sentences. All as regular expressions over words.
_OR_LATER = r"(?: or(?: any)? later| plus)?"
LICENSES = (
    ("mit", ["mit"], [r"mit x11 licen[sc]e", r"mit expat licen[sc]e", r"expat licen[sc]e", r"mit licen[sc]e", r"mit style licen[sc]e"],
     [r"opensource org licen[sc]es mit"],
     [r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
      r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"]),
    ("mit-0", [r"mit 0"], [r"mit no attribution", r"mit zero licen[sc]e"], [r"github com aws mit 0"], []),
    ("x11", [r"x11"], [r"x11 licen[sc]e", r"x consortium licen[sc]e"], [r"www xfree86 org [^ ]+ license"],
     [r"except as contained in this notice the name of the x consortium shall not be used in advertising"]),
    ("isc", [r"isc"], [r"isc licen[sc]e", r"internet systems consortium licen[sc]e"], [r"opensource org licen[sc]es isc"],
     [r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]),
    ("apache-2.0", [r"apache 2(?: 0)?"], [r"apache licen[sc]e(?: v| version)? ?2(?: 0)?", r"apache software licen[sc]e(?: version)? 2(?: 0)?", r"asl 2 0", r"apache 2 0 licen[sc]e"],
     [r"www apache org licen[sc]es license 2 0"],
     [r"you may not use this file except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at",
      r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"]),
    ("apache-1.1", [r"apache 1 1"], [r"apache(?: software)? licen[sc]e(?: version)? 1 1"], [r"www apache org licen[sc]es license 1 1"],
     [r"this product includes software developed by the apache software foundation"]),
    ("apache", [], [r"apache(?: software)? licen[sc]e", r"apache software foundation licen[sc]e"], [r"www apache org licen[sc]es"], []),
    ("gpl-2.0", [r"gpl 2 0(?: only| or later)?", r"gplv2"],
     [rf"gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version| v) ?2(?: 0)?(?: of the licen[sc]e)?{_OR_LATER}", rf"gnu gpl(?: version| v) ?2{_OR_LATER}", r"gplv2", r"gpl v ?2"],
     [r"www gnu org licen[sc]es(?: old licen[sc]es)? gpl 2 0"],
     [r"gnu general public licen[sc]e version 2 june 1991"]),
    ("gpl-3.0", [r"gpl 3 0(?: only| or later)?", r"gplv3"],
     [rf"gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version| v) ?3(?: 0)?(?: of the licen[sc]e)?{_OR_LATER}", rf"gnu gpl(?: version| v) ?3{_OR_LATER}", r"gplv3", r"gpl v ?3"],
     [r"www gnu org licen[sc]es gpl 3 0"],
     [r"gnu general public licen[sc]e version 3 29 june 2007"]),
    ("gpl", [r"gpl"], [r"gnu general public licen[sc]e", r"general public licen[sc]e", r"gnu gpl"], [r"www gnu org licen[sc]es gpl", r"gnu org copyleft gpl"],
     [r"you should have received a copy of the gnu general public licen[sc]e",
      r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"]),
    ("lgpl-2.1", [r"lgpl 2 1(?: only| or later)?"], [rf"gnu lesser general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version| v) ?2 1(?: of the licen[sc]e)?{_OR_LATER}", r"lgpl ?v?2 1"],
     [r"www gnu org licen[sc]es(?: old licen[sc]es)? lgpl 2 1"], [r"gnu lesser general public licen[sc]e version 2 1 february 1999"]),
    ("lgpl-3.0", [r"lgpl 3 0(?: only| or later)?"], [rf"gnu lesser general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version| v) ?3(?: 0)?(?: of the licen[sc]e)?{_OR_LATER}", r"lgpl ?v?3"],
     [r"www gnu org licen[sc]es lgpl 3 0"], [r"gnu lesser general public licen[sc]e version 3 29 june 2007"]),
    ("lgpl", [r"lgpl"], [r"gnu lesser general public licen[sc]e", r"lesser general public licen[sc]e", r"gnu library general public licen[sc]e", r"gnu lgpl"],
     [r"www gnu org licen[sc]es lgpl", r"gnu org copyleft lesser"],
     [r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e"]),
    ("agpl-3.0", [r"agpl 3 0(?: only| or later)?"], [r"gnu affero general public licen[sc]e", r"affero general public licen[sc]e", r"gnu agpl", r"agpl ?v?3"],
     [r"www gnu org licen[sc]es agpl"], [r"you should have received a copy of the gnu affero general public licen[sc]e"]),
    ("gfdl-1.3", [r"gfdl 1 [123](?: only| or later)?"], [r"gnu free documentation licen[sc]e", r"gfdl"], [r"www gnu org licen[sc]es fdl"],
     [r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"]),
    ("bsd-2-clause", [r"bsd 2 clause"], [r"2 clause bsd(?: licen[sc]e)?", r"two clause bsd(?: licen[sc]e)?", r"simplified bsd licen[sc]e", r"freebsd licen[sc]e"],
     [r"opensource org licen[sc]es bsd 2 clause"], []),
    ("bsd-3-clause", [r"bsd 3 clause"], [r"3 clause bsd(?: licen[sc]e)?", r"three clause bsd(?: licen[sc]e)?", r"new bsd licen[sc]e", r"revised bsd licen[sc]e", r"modified bsd licen[sc]e"],
     [r"opensource org licen[sc]es bsd 3 clause"],
     [r"may be used to endorse or promote products derived from this software without specific prior written permission"]),
    ("bsd-4-clause", [r"bsd 4 clause"], [r"4 clause bsd(?: licen[sc]e)?", r"original bsd licen[sc]e"], [],
     [r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"]),
    ("bsd", [r"bsd"], [r"bsd licen[sc]e", r"bsd style licen[sc]e", r"berkeley software distribution licen[sc]e"], [r"opensource org licen[sc]es bsd license"],
     [r"redistributions of source code must retain the above copyright notice",
      r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"]),
    ("0bsd", [r"0bsd"], [r"zero clause bsd(?: licen[sc]e)?", r"bsd zero clause(?: licen[sc]e)?", r"0 clause bsd"], [r"opensource org licen[sc]es 0bsd"], []),
    ("mpl-1.1", [r"mpl 1 1"], [r"mozilla public licen[sc]e(?: v| version)? ?1 1", r"mpl ?v?1 1"], [r"www mozilla org mpl 1 1", r"mozilla org mpl mpl 1 1"],
     [r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1"]),
    ("mpl-2.0", [r"mpl 2 0"], [r"mozilla public licen[sc]e(?: v| version)? ?2(?: 0)?", r"mpl ?v?2 0"], [r"mozilla org mpl 2 0", r"www mozilla org en us mpl 2 0"],
     [r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"]),
    ("mpl", [r"mpl"], [r"mozilla public licen[sc]e"], [r"www mozilla org mpl"], []),
    ("epl-1.0", [r"epl 1 0"], [r"eclipse public licen[sc]e(?: v| version)? ?1(?: 0)?"], [r"www eclipse org legal epl v10"], []),
    ("epl-2.0", [r"epl 2 0"], [r"eclipse public licen[sc]e(?: v| version)? ?2(?: 0)?"], [r"www eclipse org legal epl 2 0", r"www eclipse org legal epl v20"],
     [r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"]),
    ("cddl-1.0", [r"cddl 1 [01]"], [r"common development and distribution licen[sc]e", r"cddl licen[sc]e"], [r"opensource org licen[sc]es cddl1", r"www sun com cddl"],
     [r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"]),
    ("eupl-1.2", [r"eupl 1 [12]"], [r"european union public licen[sc]e", r"eupl licen[sc]e"], [r"joinup ec europa eu [^ ]+ eupl"],
     [r"licensed under the eupl version 1 [12]"]),
    ("cecill-2.1", [r"cecill 2 [01]"], [r"cecill(?: free software)? licen[sc]e(?: agreement)?"], [r"www cecill info"],
     [r"this software is governed by the cecill licen[sc]e under french law and abiding by the rules of distribution of free software"]),
    ("artistic-2.0", [r"artistic [12] 0"], [r"artistic licen[sc]e(?: version)?(?: 2(?: 0)?)?", r"perl artistic licen[sc]e"], [r"www perlfoundation org artistic licen[sc]e 2 0", r"opensource org licen[sc]es artistic license"],
     [r"under the same terms as perl itself"]),
    ("unlicense", [r"unlicense"], [r"the unlicense", r"unlicense licen[sc]e"], [r"unlicense org"],
     [r"this is free and unencumbered software released into the public domain"]),
    ("wtfpl", [r"wtfpl"], [r"do what the fuck you want to public licen[sc]e", r"wtfpl licen[sc]e"], [r"www wtfpl net", r"sam zoy org wtfpl"], []),
    ("zlib", [r"zlib"], [r"zlib licen[sc]e", r"zlib libpng licen[sc]e"], [r"zlib net zlib license", r"opensource org licen[sc]es zlib"],
     [r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"]),
    ("bsl-1.0", [r"bsl 1 0"], [r"boost software licen[sc]e(?: version)?(?: 1 0)?"], [r"www boost org license 1 0"],
     [r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"]),
    ("python-2.0", [r"python 2 0", r"psf 2 0"], [r"python software foundation licen[sc]e", r"psf licen[sc]e"], [r"docs python org [^ ]+ license"],
     [r"psf hereby grants licensee a nonexclusive royalty free world wide licen[sc]e"]),
    ("postgresql", [r"postgresql"], [r"postgresql licen[sc]e"], [r"www postgresql org about licen[sc]e"],
     [r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"]),
    ("ncsa", [r"ncsa"], [r"university of illinois ncsa open source licen[sc]e", r"ncsa open source licen[sc]e", r"uiuc licen[sc]e"], [r"opensource org licen[sc]es ncsa"],
     [r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"]),
    ("ofl-1.1", [r"ofl 1 [01]"], [r"sil open font licen[sc]e", r"open font licen[sc]e"], [r"scripts sil org ofl", r"openfontlicense org"],
     [r"this font software is licensed under the sil open font licen[sc]e"]),
    ("openssl", [r"openssl"], [r"openssl licen[sc]e", r"ssleay licen[sc]e"], [r"www openssl org source license"],
     [r"this product includes software developed by the openssl project for use in the openssl toolkit"]),
    ("php-3.01", [r"php 3 0 ?1"], [r"php licen[sc]e(?: version)?(?: 3 01)?"], [r"www php net license 3 01"],
     [r"this source file is subject to version 3 01 of the php licen[sc]e"]),
    ("ruby", [r"ruby"], [r"ruby licen[sc]e", r"same licen[sc]e as ruby"], [r"www ruby lang org [^ ]+ license"], []),
    ("vim", [r"vim"], [r"vim licen[sc]e"], [r"vimhelp org uganda"], []),
    ("w3c", [r"w3c"], [r"w3c software(?: notice)?(?: and)?(?: document)? licen[sc]e"], [r"www w3 org consortium legal"], []),
    ("sspl-1.0", [r"sspl 1 0"], [r"server side public licen[sc]e"], [r"www mongodb com licensing server side public license"],
     [r"it under the terms of the server side public licen[sc]e version 1"]),
    ("busl-1.1", [r"busl 1 1"], [r"business source licen[sc]e(?: version)?(?: 1 1)?"], [r"mariadb com bsl11"],
     [r"use of this software is governed by the business source licen[sc]e"]),
    ("elastic-2.0", [r"elastic 2 0"], [r"elastic licen[sc]e(?: version)?(?: 2(?: 0)?)?"], [r"www elastic co licensing elastic license"], []),
    ("ms-pl", [r"ms pl"], [r"microsoft public licen[sc]e"], [r"opensource org licen[sc]es ms pl"], []),
    ("ms-rl", [r"ms rl"], [r"microsoft reciprocal licen[sc]e"], [r"opensource org licen[sc]es ms rl"], []),
    ("osl-3.0", [r"osl 3 0"], [r"open software licen[sc]e(?: version)?(?: 3 0)?"], [r"opensource org licen[sc]es osl 3 0"],
     [r"licensed under the open software licen[sc]e version 3 0"]),
    ("afl-3.0", [r"afl 3 0"], [r"academic free licen[sc]e(?: version)?(?: 3 0)?"], [r"opensource org licen[sc]es afl 3 0"],
     [r"licensed under the academic free licen[sc]e version 3 0"]),
    ("odbl-1.0", [r"odbl 1 0"], [r"open database licen[sc]e", r"odbl licen[sc]e"], [r"opendatacommons org licen[sc]es odbl"],
     [r"is made available under the open database licen[sc]e"]),
    ("pddl-1.0", [r"pddl 1 0"], [r"public domain dedication and licen[sc]e"], [r"opendatacommons org licen[sc]es pddl"], []),
    ("odc-by-1.0", [r"odc by 1 0"], [r"open data commons attribution licen[sc]e"], [r"opendatacommons org licen[sc]es by"], []),
    ("cc0-1.0", [r"cc0 1 0"], [r"cc0(?: 1 0)?(?: universal)?(?: licen[sc]e)?", r"creative commons zero"], [r"creativecommons org publicdomain zero 1 0"],
     [r"the person who associated a work with this deed has dedicated the work to the public domain"]),
    ("cc-by-4.0", [r"cc by 4 0"], [r"cc by(?: 4 0)?", r"creative commons attribution(?: 4 0)?(?: international)?(?: licen[sc]e)?"], [r"creativecommons org licen[sc]es by 4 0"], []),
    ("cc-by-3.0", [r"cc by 3 0"], [r"cc by 3 0", r"creative commons attribution 3 0(?: unported)?(?: licen[sc]e)?"], [r"creativecommons org licen[sc]es by 3 0"], []),
    ("cc-by-sa-4.0", [r"cc by sa 4 0"], [r"cc by sa(?: 4 0)?", r"creative commons attribution share ?alike(?: 4 0)?(?: international)?(?: licen[sc]e)?"], [r"creativecommons org licen[sc]es by sa 4 0"], []),
    ("cc-by-sa-3.0", [r"cc by sa 3 0"], [r"cc by sa 3 0", r"creative commons attribution share ?alike 3 0(?: unported)?(?: licen[sc]e)?"], [r"creativecommons org licen[sc]es by sa 3 0"], []),
    ("cc-by-nd-4.0", [r"cc by nd 4 0"], [r"cc by nd(?: 4 0)?", r"creative commons attribution no ?deriv(?:ative)?s(?: 4 0)?(?: international)?(?: licen[sc]e)?"], [r"creativecommons org licen[sc]es by nd 4 0"], []),
    ("cc-by-nc-4.0", [r"cc by nc 4 0"], [r"cc by nc(?: 4 0)?", r"creative commons attribution non ?commercial(?: 4 0)?(?: international)?(?: licen[sc]e)?"], [r"creativecommons org licen[sc]es by nc 4 0"], []),
    ("cc-by-nc-sa-4.0", [r"cc by nc sa 4 0"], [r"cc by nc sa(?: 4 0)?", r"creative commons attribution non ?commercial share ?alike(?: 4 0)?(?: international)?(?: licen[sc]e)?"], [r"creativecommons org licen[sc]es by nc sa 4 0"], []),
    ("cc-by-nc-nd-4.0", [r"cc by nc nd 4 0"], [r"cc by nc nd(?: 4 0)?", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: 4 0)?(?: international)?(?: licen[sc]e)?"], [r"creativecommons org licen[sc]es by nc nd 4 0"], []),
    ("public-domain", [r"public domain"], [r"public domain dedication", r"dedicated to the public domain", r"released into the public domain", r"placed in the public domain"], [r"creativecommons org publicdomain mark"], []),
    ("proprietary", [r"licenseref proprietary"], [r"all rights reserved proprietary", r"proprietary and confidential", r"proprietary licen[sc]e"], [],
     [r"unauthorized copying of this file via any medium is strictly prohibited"]),
)

#: How a name is granted: what may stand before it.
GRANT = (r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|made available|redistribut(?:e|ed)|modify it) under (?:the |a |an )?"
         r"(?:terms (?:and conditions )?of (?:the |version [0-9 ]+ of the )?|conditions of the )?")
#: What may stand between an identifier tag and the identifier.
TAG = r"(?:spdx license identifier|license expression|license tag)(?: [^ ]+ (?:or|and|with))? "
#: By kind what stands before the table's expression, and a string that this always holds.
_FRAMES = {"tag": (TAG, "license "), "grant": (GRANT, " under ")}


def _keyword(pattern: str) -> str:
    """The longest literal of ``pattern`` outside its groups and options, for the prefilter."""
    flat = pattern
    while re.search(r"\([^()]*\)", flat):
        flat = re.sub(r"\([^()]*\)[?*+]?", "\0", flat)
    flat = re.sub(r"\[[^\]]*\][?*+]?", "\0", flat)
    flat = re.sub(r".[?*]", "\0", flat)
    return max(flat.split("\0"), key=len).strip(" ")


def _rules() -> list[Rule]:
    made = []
    for label, tags, names, addresses, sentences in LICENSES:
        found = [("text", s) for s in sentences]
        found += [("tag", x) for x in tags]
        found += [("grant", x) for x in names]
        found += [("address", x) for x in addresses]
        found += [("name", x) for x in names]
        made += [Rule(label, kind, (_keyword(x), *_FRAMES.get(kind, ("",))[1:]), _FRAMES.get(kind, ("",))[0] + x) for kind, x in found]
    order = list(KINDS)
    return sorted(made, key=lambda rule: order.index(rule.kind))


RULES = _rules()

#: A text that a rule or base phrase matches holds one of these.
SIGNS = ("licen", "copy", "software", "gpl", "gfdl", "bsd", "clause", "apache", "asl 2", "mpl", "cc by", "cc0", "creative", "domain", " org", "attribution",
         "advertising", "perl itself", "redistribut", "cecill", "proprietary", "aws mit", "sun com", "europa eu", "wtfpl", "bsl11", "vimhelp", "w3c")
for _rule in RULES:
    if not any(sign in " " + k for sign in SIGNS for k in _rule.keywords):
        raise AssertionError(f"no sign in the keywords of {_rule}")
