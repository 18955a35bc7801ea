"""Signature rules for licenses: one family per line, four signatures per family.

A family is (label, keyword, name, identifier): the label of its detections, a literal without which
none of its rules can match, a regular expression for its written name, and one for its short
identifier. `rules()` makes of each family, in order of priority, the tag, the grant, the title and
the mention; free-standing notices follow. Tags and grants also take the plain identifiers, which
are too common as words elsewhere. All patterns read lower-cased text whose gaps are one blank.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

_V = r"(?:,? ?(?:version|v\.?) ?)"
_END = r"(?![\w+])"
# Most specific first: order is priority among rules of the same strength.
FAMILIES = (
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general public licen[sc]e{_V}?3(?:\.0)?", r"agpl-?v?3(?:\.0)?(?:-only|-or-later|\+)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", r"agpl"),
    ("lgpl-3.0", "lesser", rf"(?:gnu )?lesser general public licen[sc]e{_V}?3(?:\.0)?", r"lgpl-?v?3(?:\.0)?(?:-only|-or-later|\+)?"),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general public licen[sc]e{_V}?2\.1", r"lgpl-?v?2\.1(?:-only|-or-later|\+)?"),
    ("lgpl-2.0", "library general", rf"(?:gnu )?library general public licen[sc]e{_V}?2(?:\.0)?", r"lgpl-?v?2(?:\.0)?(?:-only|-or-later|\+)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e", r"lgpl"),
    ("gpl-3.0", "general public", rf"gnu general public licen[sc]e{_V}3(?:\.0)?", r"gpl-?v?3(?:\.0)?(?:-only|-or-later|\+)?"),
    ("gpl-2.0", "general public", rf"gnu general public licen[sc]e{_V}2(?:\.0)?", r"gpl-?v?2(?:\.0)?(?:-only|-or-later|\+)?"),
    ("gpl-1.0", "general public", rf"gnu general public licen[sc]e{_V}1(?:\.0)?", r"gpl-?v?1(?:\.0)?(?:-only|-or-later|\+)?"),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e", r"gnu gpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e", r"gfdl(?:-?1\.[1-3])?"),
    ("apache-2.0", "apache", rf"apache (?:software )?licen[sc]e{_V}2(?:\.0)?", r"apache[- ]?2(?:\.0)?"),
    ("apache-1.1", "apache", rf"apache (?:software )?licen[sc]e{_V}1\.1", r"apache[- ]1\.1"),
    ("apache-1.0", "apache", rf"apache (?:software )?licen[sc]e{_V}1\.0", r"apache[- ]1\.0"),
    ("apache", "apache", r"apache (?:software )?licen[sc]e", r"apache-licen[sc]e"),
    ("mit-0", "no attribution", r"mit no attribution(?: licen[sc]e)?", r"mit-0"),
    ("mit", "mit", r"(?:mit|expat|x11) licen[sc]e", r"mit(?= licen|-licen|$)"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4[- ]clause|original bsd|4[- ]clause bsd) licen[sc]e", r"bsd-4-clause"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3[- ]clause|new bsd|modified bsd|revised bsd|3[- ]clause bsd) licen[sc]e", r"bsd-3-clause"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2[- ]clause|simplified bsd|freebsd|2[- ]clause bsd) licen[sc]e", r"bsd-2-clause"),
    ("0bsd", "bsd", r"(?:zero[- ]clause bsd|bsd zero[- ]clause) licen[sc]e", r"0bsd"),
    ("bsd", "bsd", r"bsd(?:[- ]style)? licen[sc]e", r"bsd-licen[sc]e"),
    ("isc", "isc", r"isc licen[sc]e", r"isc-licen[sc]e"),
    ("mpl-2.0", "mozilla", rf"mozilla public licen[sc]e{_V}2(?:\.0)?", r"mpl-?v?2(?:\.0)?"),
    ("mpl-1.1", "mozilla", rf"mozilla public licen[sc]e{_V}1\.1", r"mpl-?v?1\.1"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", r"mpl-licen[sc]e"),
    ("epl-2.0", "eclipse", rf"eclipse public licen[sc]e{_V}?-?2(?:\.0)?", r"epl-?v?2(?:\.0)?"),
    ("epl-1.0", "eclipse", rf"eclipse public licen[sc]e{_V}?-?1(?:\.0)?", r"epl-?v?1(?:\.0)?"),
    ("epl", "eclipse", r"eclipse public licen[sc]e", r"epl-licen[sc]e"),
    ("eupl-1.2", "european union", rf"european union public licen[sc]e{_V}?1\.2", r"eupl-?v?1\.2"),
    ("eupl", "european union", r"european union public licen[sc]e", r"eupl"),
    ("cddl-1.0", "common development", rf"common development and distribution licen[sc]e{_V}?(?:1\.0)?", r"cddl(?:-1\.[01])?"),
    ("cpl-1.0", "common public", rf"common public licen[sc]e{_V}?(?:1\.0)?", r"cpl-1\.0"),
    ("artistic-2.0", "artistic", rf"artistic licen[sc]e{_V}?2(?:\.0)?", r"artistic-2\.0"),
    ("artistic-1.0", "artistic", rf"artistic licen[sc]e(?:{_V}?1(?:\.0)?)?", r"artistic-1\.0"),
    ("bsl-1.0", "boost", rf"boost software licen[sc]e(?:{_V}1\.0)?", r"bsl-1\.0"),
    ("busl-1.1", "business source", rf"business source licen[sc]e(?:{_V}?1\.1)?", r"busl-1\.1"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e", r"zlib-licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e", r"openssl-licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", r"postgresql-licen[sc]e"),
    ("php-3.01", "php", rf"php licen[sc]e(?:{_V}3\.01)?", r"php-3\.01"),
    ("psf-2.0", "python software", rf"python software foundation licen[sc]e(?:{_V}?2)?", r"psf-2\.0"),
    ("ncsa", "illinois", r"university of illinois/ncsa open source licen[sc]e", r"ncsa-licen[sc]e"),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e", r"ms-pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e", r"ms-rl"),
    ("osl-3.0", "open software", rf"open software licen[sc]e(?:{_V}?3(?:\.0)?)?", r"osl-3\.0"),
    ("afl-3.0", "academic free", rf"academic free licen[sc]e(?:{_V}?3(?:\.0)?)?", r"afl-3\.0"),
    ("ofl-1.1", "open font", rf"(?:sil )?open font licen[sc]e(?:{_V}?1\.1)?", r"ofl-1\.1"),
    ("odbl-1.0", "open database", rf"open (?:data commons open )?database licen[sc]e(?:{_V}?1\.0)?", r"odbl(?:-1\.0)?"),
    ("odc-by", "open data commons", r"open data commons attribution licen[sc]e", r"odc-by"),
    ("pddl", "public domain dedication", r"public domain dedication and licen[sc]e", r"pddl(?:-1\.0)?"),
    ("cc0-1.0", "cc0", rf"(?:creative commons )?cc0(?:{_V}?1\.0)?(?: universal)?", r"cc0-1\.0"),
    ("cc-by-nc-nd", "cc", r"creative commons attribution[- ]non-?commercial[- ]no-?deriv\w*", r"cc[- ]by-nc-nd(?:[- ][1-4]\.[0-9])?"),
    ("cc-by-nc-sa", "cc", r"creative commons attribution[- ]non-?commercial[- ]share-?alike", r"cc[- ]by-nc-sa(?:[- ][1-4]\.[0-9])?"),
    ("cc-by-nc", "cc", r"creative commons attribution[- ]non-?commercial", r"cc[- ]by-nc(?:[- ][1-4]\.[0-9])?"),
    ("cc-by-nd", "cc", r"creative commons attribution[- ]no-?deriv\w*", r"cc[- ]by-nd(?:[- ][1-4]\.[0-9])?"),
    ("cc-by-sa", "cc", r"creative commons attribution[- ]share-?alike", r"cc[- ]by-sa(?:[- ][1-4]\.[0-9])?"),
    ("cc-by", "cc", r"creative commons attribution", r"cc[- ]by(?:[- ][1-4]\.[0-9])?(?!-)"),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"do what the f\w+ you want to public licen[sc]e", r"wtfpl"),
)
# Identifiers of tags and grants that a mention does not take: (label: pattern).
PLAIN = {
    "mit": r"(?:mit|expat|x11)", "isc": r"isc", "zlib": r"zlib", "openssl": r"openssl",
    "postgresql": r"postgresql", "ncsa": r"ncsa",
}
_ALONE = r"(?!-(?!licen))"
# (strength, frame): the frame is filled with the name or the identifier.
_FRAMES = (
    (0.99, r"spdx-licen[sc]e-identifier:? *(?:{ident}){end}"),
    (0.95, r"(?:licen[sc]ed|released|distributed|published|available|provided|made available) under "
           r"(?:the )?(?:terms of (?:the )?)?(?:{name}|{ident}){end}"),
    (0.85, r"(?<!\w)(?:{name}){end}"),
    (0.60, r"(?<![\w-])(?:{ident}){end}"),
)
# Notices that name no license: (label, keyword, strength, pattern).
NOTICES = (
    ("proprietary", "all rights reserved", 0.6, r"all rights reserved"),
    ("proprietary", "confidential", 0.8, r"proprietary and confidential"),
    ("proprietary", "unauthorized", 0.8, r"unauthorized (?:copying|use|reproduction|distribution) (?:of|is)"),
    ("copyright", "copyright", 0.5, r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d"),
    ("copyright", "©", 0.5, r"© ?(?:19|20)\d\d"),
    ("public-domain", "public domain", 0.7, r"(?:in|into|to) the public domain"),
    ("mit", "free of charge", 0.9, r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("isc", "with or without fee", 0.9, r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution", 0.9, r"redistribution and use in source and binary forms, with or without modification"),
    ("cc", "creative commons", 0.5, r"creative commons(?: licen[sc]e)?"),
    ("noncommercial", "commercial", 0.5, r"(?:for )?non-?commercial (?:use|purposes) only"),
    ("other", "subject to the terms", 0.4, r"subject to the terms (?:and conditions )?of the [\w ]{1,40}licen[sc]e"),
)


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    keywords: tuple[str, ...]
    strength: float
    pattern: re.Pattern


def _letters_of(ident: str) -> str:
    """The literal an identifier starts with."""
    return re.match(r"[a-z0-9 ]+", ident)[0]


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority: the stronger signature first, then the family's place."""
    made = []
    for strength, frame in _FRAMES:
        for label, keyword, name, ident in FAMILIES:
            keywords = (keyword,) * ("{name}" in frame) + (_letters_of(ident),) * ("{ident}" in frame)
            if label in PLAIN and strength > 0.9:
                ident += "|" + PLAIN[label] + _ALONE
                keywords += tuple(re.findall(r"[a-z0-9]{3,}", PLAIN[label]))
            made.append((strength, label, keywords, frame.format(name=name, ident=ident, end=_END)))
    made += [(strength, label, (keyword,), text) for label, keyword, strength, text in NOTICES]
    made.sort(key=lambda r: -r[0])
    return tuple(
        Rule(i, label, keywords, strength, re.compile(text))
        for i, (strength, label, keywords, text) in enumerate(made)
    )


@cache
def keyword_index() -> dict[str, tuple[int, ...]]:
    """The rules that each keyword opens."""
    found: dict[str, list[int]] = {}
    for rule in rules():
        for word in dict.fromkeys(rule.keywords):
            found.setdefault(word, []).append(rule.order)
    return {word: tuple(orders) for word, orders in found.items()}
