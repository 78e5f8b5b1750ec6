"""The signature rules of the license scan, in order.

A rule is (label, tier, keywords, pattern).  Patterns are written for the word
stream of a text: words in lower case with one space between them, punctuation
gone, so ``GPL-3.0`` reads ``gpl 3 0``.  A rule is only tried on a text that
holds one of its keywords as a word.  A smaller tier has the higher priority.
"""

from __future__ import annotations

import re
from typing import NamedTuple

TAG, NOTICE, VERSIONED, ADDRESS, SHORT, NAMED, GENERIC = range(1, 8)
# how sure a detection of each tier is
SURE = {TAG: 0.99, NOTICE: 0.95, VERSIONED: 0.9, ADDRESS: 0.9, SHORT: 0.8, NAMED: 0.6, GENERIC: 0.3}


class Rule(NamedTuple):
    label: str
    tier: int
    keywords: tuple[str, ...]
    pattern: re.Pattern


# label stem; keyword and pattern of the full name; keyword and pattern of the short form; versions
FAMILIES = (
    ("gpl", "general", "(?:gnu )?general public licen[cs]e", "gpl", "(?:gnu )?gpl", "1.0 2.0 3.0"),
    ("lgpl", "lesser library", "(?:gnu )?(?:lesser|library)(?: or lesser)? general public licen[cs]e", "lgpl", "(?:gnu )?lgpl", "2.0 2.1 3.0"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", "agpl", "(?:gnu )?agpl", "1.0 3.0"),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[cs]e", "gfdl fdl", "(?:gnu )?g?fdl", "1.1 1.2 1.3"),
    ("apache", "apache", "apache(?: software)? licen[cs]e", "asl apache", "(?:asl|apache)", "1.0 1.1 2.0"),
    ("mpl", "mozilla", "mozilla public licen[cs]e", "mpl", "mpl", "1.0 1.1 2.0"),
    ("epl", "eclipse", "eclipse public licen[cs]e", "epl", "epl", "1.0 2.0"),
    ("cddl", "development", "common development and distribution licen[cs]e", "cddl", "cddl", "1.0 1.1"),
    ("eupl", "union", "european union public licen[cs]e", "eupl", "eupl", "1.0 1.1 1.2"),
    ("osl", "open", "open software licen[cs]e", "osl", "osl", "1.0 1.1 2.0 2.1 3.0"),
    ("afl", "academic", "academic free licen[cs]e", "afl", "afl", "1.1 1.2 2.0 2.1 3.0"),
    ("artistic", "artistic", "(?:perl )?artistic licen[cs]e", "artistic", "artistic", "1.0 2.0"),
    ("bsl", "boost", "boost software licen[cs]e", "bsl", "bsl", "1.0"),
    ("lppl", "latex", "latex project public licen[cs]e", "lppl", "lppl", "1.0 1.1 1.2 1.3"),
    ("zpl", "zope", "zope public licen[cs]e", "zpl", "zpl", "1.1 2.0 2.1"),
    ("psf", "python", "python software foundation licen[cs]e", "psf psfl", "psfl?", "2.0"),
    ("ofl", "font", "(?:sil )?open font licen[cs]e", "ofl", "(?:sil )?ofl", "1.0 1.1"),
    ("cecill", "cecill", "cecill free software licen[cs]e(?: agreement)?", "cecill", "cecill", "1.0 1.1 2.0 2.1"),
    ("odbl", "database", "open(?: data commons)? open database licen[cs]e|open database licen[cs]e", "odbl", "odbl", "1.0"),
    ("odc-by", "commons", "open data commons attribution licen[cs]e", "odc", "odc by", "1.0"),
    ("pddl", "dedication", "(?:open data commons )?public domain dedication and licen[cs]e", "pddl", "pddl", "1.0"),
    ("ogl-uk", "government", "(?:uk )?open government licen[cs]e", "ogl", "ogl(?: uk)?", "1.0 2.0 3.0"),
    ("cpal", "attribution", "common public attribution licen[cs]e", "cpal", "cpal", "1.0"),
    ("cpl", "common", "common public licen[cs]e", "cpl", "cpl", "0.5 1.0"),
    ("ipl", "ibm", "ibm public licen[cs]e", "ipl", "ipl", "1.0"),
    ("apsl", "apple", "apple public source licen[cs]e", "apsl", "apsl", "1.0 1.1 1.2 2.0"),
    ("upl", "permissive", "universal permissive licen[cs]e", "upl", "upl", "1.0"),
    ("busl", "business", "business source licen[cs]e", "busl", "busl", "1.1"),
    ("sspl", "server", "server side public licen[cs]e", "sspl", "sspl", "1.0"),
    ("elastic", "elastic", "elastic licen[cs]e", "elv2", "elv2", "2.0"),
    ("mulanpsl", "mulan", "mulan permissive software licen[cs]e", "mulanpsl", "mulanpsl", "1.0 2.0"),
    ("polyform-noncommercial", "polyform", "polyform noncommercial licen[cs]e", "polyform", "polyform noncommercial", "1.0"),
    ("qpl", "public", "q public licen[cs]e", "qpl", "qpl", "1.0"),
    ("rpl", "reciprocal", "reciprocal public licen[cs]e", "rpl", "rpl", "1.1 1.5"),
    ("ecl", "educational", "educational community licen[cs]e", "ecl", "ecl", "1.0 2.0"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", "ms", "ms pl", ""),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", "ms", "ms rl", ""),
)

# creative commons: label, names of the elements, letters of the elements
COMMONS = (
    ("cc-by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?", "by nc nd"),
    ("cc-by-nc-sa", "attribution non ?commercial share ?alike", "by nc sa"),
    ("cc-by-nc", "attribution non ?commercial", "by nc"),
    ("cc-by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?", "by nd"),
    ("cc-by-sa", "attribution share ?alike", "by sa"),
    ("cc-by", "attribution", "by"),
)
COMMONS_VERSIONS = "1.0 2.0 2.5 3.0 4.0"

# tags without a version of their own
PLAIN_TAGS = "mit isc zlib unlicense wtfpl 0bsd curl ntp ncsa postgresql x11 ruby php-3.01 bsd-2-clause bsd-3-clause bsd-4-clause mit-0 cc0-1.0 blueoak-1.0.0"

# label | tier | keywords | pattern
SINGLE = r"""
mit | NOTICE | hereby | permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?
mit | NOTICE | permission | the above copyright notice and this permission notice shall be included in all copies
mit | NAMED | mit | mit licen[cs]e
mit | NAMED | mit expat | expat licen[cs]e
mit | NAMED | mit | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?mit
mit | ADDRESS | opensource | opensource org licenses mit(?: license)?
mit | NAMED | mit | (?:lizenziert unter|veröffentlicht unter|steht unter) der mit lizenz
mit | NAMED | mit | (?:sous|bajo) (?:la )?(?:licence|licencia) mit
x11 | NAMED | x11 | x11 licen[cs]e
isc | NOTICE | hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | NAMED | isc | isc licen[cs]e
bsd | NOTICE | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | VERSIONED | bsd freebsd simplified | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?
bsd-3-clause | VERSIONED | bsd | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
bsd-4-clause | VERSIONED | bsd | (?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: licen[cs]e)?
bsd-3-clause | NOTICE | endorse | neither the name of (?:\S+ ){1,12}may be used to endorse or promote products
bsd-4-clause | NOTICE | advertising | all advertising materials mentioning features or use of this software must display
bsd | NAMED | bsd | bsd(?: style)? licen[cs]e
0bsd | VERSIONED | 0bsd zero | (?:0bsd|zero clause bsd)(?: licen[cs]e)?
zlib | NOTICE | misrepresented | the origin of this software must not be misrepresented
zlib | NAMED | zlib | zlib(?: libpng)? licen[cs]e
apache-2.0 | NOTICE | compliance | you may not use this file except in compliance with the license
apache-2.0 | ADDRESS | apache | apache org licenses license 2 0(?: html| txt)?
gpl | NOTICE | free | this program is free software(?: you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e)?
gpl | NOTICE | gnu | you should have received a copy of the gnu general public licen[cs]e
lgpl | NOTICE | lesser | you should have received a copy of the gnu lesser general public licen[cs]e
agpl | NOTICE | affero | you should have received a copy of the gnu affero general public licen[cs]e
gpl | NAMED | gpl | gnu gpl
lgpl | NAMED | lgpl | gnu lgpl
agpl | NAMED | agpl | gnu agpl
gpl | ADDRESS | gnu | gnu org (?:licenses gpl|copyleft gpl)(?: 3 0)?(?: html| txt)?
lgpl | NAMED | gpl | gnu gpl
lgpl | NAMED | lgpl | gnu lgpl
agpl | NAMED | agpl | gnu agpl
gpl | ADDRESS | gnu | gnu org (?:licenses lgpl|copyleft lesser)(?: html| txt)?
agpl | ADDRESS | gnu | gnu org licenses agpl(?: 3 0)?(?: html| txt)?
gfdl | ADDRESS | gnu | gnu org (?:licenses fdl|copyleft fdl)(?: html| txt)?
mpl-2.0 | NOTICE | mozilla | this source code form is subject to the terms of the mozilla public licen[cs]e
mpl-2.0 | ADDRESS | mozilla | mozilla org mpl 2 0
epl | ADDRESS | eclipse | eclipse org legal epl(?: v10| 2 0)?(?: html)?
ofl | ADDRESS | sil | scripts sil org ofl
wtfpl | NOTICE | fuck | do what the fuck you want to(?: public licen[cs]e)?
wtfpl | NAMED | wtfpl | wtfpl(?: licen[cs]e)?(?: version 2)?
unlicense | NOTICE | unencumbered | free and unencumbered software released into the public domain
unlicense | NAMED | unlicense | unlicense
unlicense | ADDRESS | unlicense | unlicense org
beerware | NOTICE | beer | you can buy me a beer in return
beerware | NAMED | beerware beer | beer ?ware licen[cs]e
json | NOTICE | evil | the software shall be used for good not evil
ntp | NOTICE | fee | permission to use copy modify and distribute this software and its documentation for any purpose(?: with or)? without fee
postgresql | NAMED | postgresql | postgresql licen[cs]e
openssl | NAMED | openssl | openssl licen[cs]e
php-3.01 | NAMED | php | php licen[cs]e(?: version)?(?: 3 01)?
ruby | NAMED | ruby | ruby licen[cs]e
vim | NAMED | vim | vim licen[cs]e
icu | NAMED | icu unicode | (?:icu|unicode) licen[cs]e
curl | NAMED | curl | curl licen[cs]e
ncsa | NAMED | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[cs]e
commons-clause | NOTICE | clause | commons clause licen[cs]e condition
commons-clause | NAMED | clause | commons clause
cc0-1.0 | VERSIONED | cc0 | cc0 1 0(?: universal)?
cc0-1.0 | ADDRESS | creativecommons | creativecommons org publicdomain zero 1 0
cc0-1.0 | NOTICE | waived | waived all copyright and related (?:or|and) neighboring rights
cc0-1.0 | SHORT | cc0 | cc0
cc-pdm | ADDRESS | creativecommons | creativecommons org publicdomain mark 1 0
cc-pdm | NAMED | domain | public domain mark
public-domain | NOTICE | domain | (?:released|placed|dedicated|donated) (?:in|into|to) the public domain
public-domain | NAMED | domain | (?:is|are|was|be) (?:now )?in the public domain
public-domain | NAMED | domaine | (?:dans|est) (?:le|du) domaine public
public-domain | NAMED | dominio | (?:en el|es de) dominio público
public-domain | NAMED | gemeinfrei | (?:ist|sind|gilt als) gemeinfrei
creative-commons | GENERIC | creative | creative commons(?: licen[cs]e)?
creative-commons | GENERIC | creative | (?:unter einer|sous licence|bajo una licencia) creative commons(?: lizenz)?
all-rights-reserved | NAMED | reserved | (?:with )?all rights reserved(?: worldwide)?
all-rights-reserved | NAMED | reserved | all rights (?:are|not expressly granted are) reserved
all-rights-reserved | NAMED | vorbehalten | alle rechte vorbehalten
all-rights-reserved | NAMED | réservés | tous (?:les )?droits (?:sont )?réservés
all-rights-reserved | NAMED | reservados | todos los derechos reservados
some-rights-reserved | NAMED | reserved | some rights reserved
proprietary | NOTICE | proprietary | (?:confidential and proprietary|proprietary and confidential)(?: information)?
proprietary | NOTICE | reproduced | no part of this (?:\S+ ){1,4}may be reproduced
proprietary | NOTICE | unauthorized | unauthorized (?:copying|reproduction|use|distribution)(?: (?:and|or|of) \S+){0,4} (?:is )?(?:strictly )?prohibited
proprietary | NOTICE | consent | without (?:the )?(?:prior|express|written)(?: (?:prior|express|written))* (?:consent|permission) of
proprietary | NAMED | proprietary | proprietary (?:software|licen[cs]e)
eula | NAMED | user | end user licen[cs]e agreement
eula | SHORT | eula | eula
non-commercial | NAMED | commercial noncommercial | (?:for )?non ?commercial (?:use|purposes) only
non-commercial | NAMED | commercial | (?:not for|no) commercial use
research-only | NAMED | research | for research (?:use|purposes) only
personal-use | NAMED | personal | for personal(?: and)?(?: non ?commercial)? use only
warranty-disclaimer | NOTICE | warranty | the software is provided as is without warranty of any kind
warranty-disclaimer | NOTICE | merchantability | (?:implied )?warrant(?:y|ies) of merchantability
copyright | GENERIC | copyright | copyright (?:c )?(?:by )?(?:\d{4}(?: \d{4})* )(?:by )?\S+
copyright | GENERIC | copyright | copyright (?:c|©) \S+
copyright | GENERIC | © | © (?:copyright )?\d{4}
licensed | GENERIC | licensed licenced | licen[cs]ed under (?:a|an|the)
licensed | GENERIC | license licence | (?:released|distributed|published|available) under (?:a|an|the) (?:\S+ ){0,3}licen[cs]e
licensed | GENERIC | lizenz | unter (?:der|einer) (?:\S+ ){0,3}lizenz
licensed | GENERIC | licence | sous (?:la )?licence
licensed | GENERIC | licencia | bajo (?:la |una )?licencia
"""


def _number(version: str) -> str:
    major, minor = version.split(".")
    return f"{major}(?: 0)?" if minor == "0" else f"{major} {minor}"


def _version(version: str) -> str:
    """``2.0`` as words: with or without the point, with or without ``version``."""
    return f"(?:(?:version|ver|v) |v)?{_number(version)}"


_LATER = "(?: of the licen[cs]e)?(?: or| and)(?: at your option)?(?: any)? (?:later|newer|above)(?: versions?)?"


def _rules() -> list[Rule]:
    rows: list[tuple[str, int, str, str]] = []
    for stem, key, name, short_key, short, versions in FAMILIES:
        for v in versions.split():
            label, words = f"{stem}-{v}", f"{stem} {v}".replace("-", " ").replace(".", " ")
            # the short form with its version, in words of their own or as one word: gpl v2, gplv2, gpl2
            brief = f"(?:{short}(?: licen[cs]e)? {_version(v)}|{short}v?{_number(v)})"
            brief_keys = " ".join(k + w for k in short_key.split() for w in ("", v[0], "v" + v[0]))
            rows += [(f"{label}-or-later", TAG, "spdx", f"spdx license identifier {words}(?: or later)"),
                     (label, TAG, "spdx", f"spdx license identifier {words}(?: only)?"),
                     (f"{label}-or-later", VERSIONED, key, f"(?:{name}) {_version(v)}{_LATER}"),
                     (label, VERSIONED, key, f"(?:{name}) {_version(v)}(?: only)?"),
                     (f"{label}-or-later", SHORT, brief_keys, brief + _LATER),
                     (label, SHORT, brief_keys, brief)]
        rows += [(stem, NAMED, key, f"(?:{name})"), (stem, NAMED, short_key, f"{short} licen[cs]e")]
    for label, names, letters in COMMONS:
        for v in COMMONS_VERSIONS.split():
            number = v.replace(".", " ")
            rows += [(f"{label}-{v}", TAG, "spdx", f"spdx license identifier cc {letters} {number}"),
                     (f"{label}-{v}", ADDRESS, "creativecommons", f"creativecommons org licenses {letters} {number}(?: legalcode| deed)?"),
                     (f"{label}-{v}", VERSIONED, "creative", f"creative commons {names} {_version(v)}(?: international| unported| generic)?(?: licen[cs]e)?"),
                     (f"{label}-{v}", SHORT, "cc", f"cc {letters} {_version(v)}")]
        rows += [(label, ADDRESS, "creativecommons", f"creativecommons org licenses {letters}"),
                 (label, NAMED, "creative", f"creative commons {names}(?: licen[cs]e)?"), (label, NAMED, "cc", f"cc {letters}")]
    rows += [(t, TAG, "spdx", "spdx license identifier " + re.sub("[-.]", " ", t)) for t in PLAIN_TAGS.split()]
    for line in SINGLE.strip().split("\n"):
        label, tier, keys, pattern = line.split(" | ")
        rows.append((label, globals()[tier], keys, pattern))
    # words are whole: a match starts behind a space and ends before one
    return [Rule(label, tier, tuple(keys.split()), re.compile(f"(?<= )(?:{pattern})(?= )")) for label, tier, keys, pattern in rows]


RULES = _rules()
