"""Signatures of licenses, by priority: hand-written patterns over a text's words, with one space between words.

A pattern is a regular expression; its plain words outside groups are its keywords, which a text must hold for the
pattern to be tried. Groups have bounded repeats only, so a search is linear in the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Phrases that are found wherever their words stand, whatever else is (the contract's).
BASE = """
mit | under the mit license
apache-2 | apache license version 2
cc-by-nc | cc by nc
"""

#: Identifiers after "SPDX-License-Identifier:"; a label is made of each by `spdx_label`.
SPDX = """
0BSD AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0
BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-3.0
CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1
CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.2-only GFDL-1.3-only
GFDL-1.3-or-later GPL-1.0-only GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND IPL-1.0 ISC LGPL-2.0-only LGPL-2.1
LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPL-1.02 LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA
ODbL-1.0 ODC-By-1.0 OFL-1.1 OpenSSL OSL-3.0 PDDL-1.0 PHP-3.01 PolyForm-Noncommercial-1.0.0 PostgreSQL Python-2.0 QPL-1.0 RPL-1.5 Ruby Sleepycat SSPL-1.0
Unicode-3.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zend-2.0 Zlib ZPL-2.1
"""

#: (confidence, "label | pattern" by line), the strongest first: SPDX tags go before all of these.
CLASSES = (
    # names with a version, and sentences of the licenses themselves
    (0.95, """
gpl-1 | gnu general public licen[sc]e (?:v1|(?:version |v )?1)(?: 0)?
gpl-2 | gnu general public licen[sc]e (?:v2|(?:version |v )?2)(?: 0)?
gpl-2-or-later | gnu general public licen[sc]e (?:\\S+ ){0,9}?(?:v2|version 2)(?: 0)? (?:of the licen[sc]e )?or (?:at your option )?(?:any )?later(?: version)?
gpl-3 | gnu general public licen[sc]e (?:v3|(?:version |v )?3)(?: 0)?
gpl-3-or-later | gnu general public licen[sc]e (?:\\S+ ){0,9}?(?:v3|version 3)(?: 0)? (?:of the licen[sc]e )?or (?:at your option )?(?:any )?later(?: version)?
gpl-2 | gpl (?:version |v )2(?: 0)?
gpl-3 | gpl (?:version |v )3(?: 0)?
lgpl-2 | gnu library general public licen[sc]e (?:v2|(?:version |v )?2)(?: 0)?
lgpl-2.1 | gnu lesser general public licen[sc]e (?:v2|(?:version |v )?2) 1
lgpl-2.1-or-later | gnu lesser general public licen[sc]e (?:\\S+ ){0,9}?(?:v2|version 2) 1 (?:of the licen[sc]e )?or (?:at your option )?(?:any )?later(?: version)?
lgpl-3 | gnu lesser general public licen[sc]e (?:v3|(?:version |v )?3)(?: 0)?
lgpl-3-or-later | gnu lesser general public licen[sc]e (?:\\S+ ){0,9}?(?:v3|version 3)(?: 0)? (?:of the licen[sc]e )?or (?:at your option )?(?:any )?later(?: version)?
agpl-3 | gnu affero general public licen[sc]e (?:v3|(?:version |v )?3)(?: 0)?
agpl-3-or-later | gnu affero general public licen[sc]e (?:\\S+ ){0,9}?(?:v3|version 3)(?: 0)? (?:of the licen[sc]e )?or (?:at your option )?(?:any )?later(?: version)?
agpl-1 | affero general public licen[sc]e (?:v1|(?:version |v )?1)
gfdl-1.2 | gnu free documentation licen[sc]e (?:version |v )?1 2
gfdl-1.3 | gnu free documentation licen[sc]e (?:version |v )?1 3
apache-1.1 | apache (?:software )?licen[sc]e (?:version |v )?1 1
apache-2 | apache (?:software )?licen[sc]e (?:v2|(?:version |v )?2)(?: 0)?
mpl-1.1 | mozilla public licen[sc]e (?:version |v )?1 1
mpl-2 | mozilla public licen[sc]e (?:v2|(?:version |v )?2)(?: 0)?
epl-1 | eclipse public licen[sc]e (?:v1|(?:version |v )?1)(?: 0)?
epl-2 | eclipse public licen[sc]e (?:v2|(?:version |v )?2)(?: 0)?
eupl-1.1 | european union public licen[sc]e (?:version |v )?1 1
eupl-1.2 | european union public licen[sc]e (?:version |v )?1 2
cddl-1 | common development and distribution licen[sc]e (?:cddl )?(?:version |v )?1 0
cddl-1.1 | common development and distribution licen[sc]e (?:cddl )?(?:version |v )?1 1
cpl-1 | common public licen[sc]e (?:version |v )?1 0
osl-3 | open software licen[sc]e (?:version |v )?3(?: 0)?
afl-3 | academic free licen[sc]e (?:version |v )?3(?: 0)?
artistic-1 | artistic licen[sc]e (?:version |v )?1(?: 0)?
artistic-2 | artistic licen[sc]e (?:version |v )?2(?: 0)?
bsl-1 | boost software licen[sc]e (?:version |v )?1 0
busl-1.1 | business source licen[sc]e (?:version |v )?1 1
elastic-2 | elastic licen[sc]e (?:v2|(?:version |v )?2)(?: 0)?
sspl-1 | server side public licen[sc]e (?:v1|(?:version |v )?1)
ofl-1.1 | sil open font licen[sc]e (?:version |v )?1 1
odbl-1 | open (?:data commons open )?database licen[sc]e (?:odbl )?(?:v1|(?:version |v )?1)(?: 0)?
pddl-1 | public domain dedication and licen[sc]e (?:pddl )?(?:v1|(?:version |v )?1)(?: 0)?
zpl-2.1 | zope public licen[sc]e (?:zpl )?(?:version |v )?2 1
php-3.01 | php licen[sc]e (?:version |v )?3 01
upl-1 | universal permissive licen[sc]e (?:v1|(?:version |v )?1)(?: 0)?
mulanpsl-2 | mulan permissive software licen[sc]e (?:v2|(?:version |v )?2)
bsd-2-clause | simplified bsd licen[sc]e
bsd-2-clause | bsd 2 clause(?: simplified)? licen[sc]e
bsd-2-clause | (?:2|two) clause bsd(?: licen[sc]e)?
bsd-3-clause | (?:modified|revised|new) bsd licen[sc]e
bsd-3-clause | bsd 3 clause(?: new| revised)? licen[sc]e
bsd-3-clause | (?:3|three) clause bsd(?: licen[sc]e)?
bsd-4-clause | original bsd licen[sc]e
bsd-4-clause | bsd 4 clause(?: original)? licen[sc]e
bsd-4-clause | (?:4|four) clause bsd(?: licen[sc]e)?
cc-by | creative commons attribution (?:(?:version )?[1-4] [05] )?(?:international |unported |generic )?(?:public )?licen[sc]e
cc-by-sa | creative commons attribution share ?alike(?: [1-4] [05])?
cc-by-nd | creative commons attribution no ?deriv(?:ative|ative work)?s?(?: [1-4] [05])?
cc-by-nc | creative commons attribution non ?commercial(?: [1-4] [05])?
cc-by-nc-sa | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(?:ative|ative work)?s?(?: [1-4] [05])?
cc0 | (?:cc0|creative commons (?:cc0|zero))(?: 1 0)? universal
mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit-0 | mit no attribution licen[sc]e
isc | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
bsd-2-clause | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | neither the name of (?:\\S+ ){1,16}?nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
bsl-1 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e
unlicense | this is free and unencumbered software released into the public domain
wtfpl | do what the fuck you want to public licen[sc]e
cc0 | (?:affirmer|statement of purpose) (?:\\S+ ){0,40}?waives? (?:\\S+ ){0,12}?copyright and related rights
gpl | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
lgpl | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e
agpl | you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e
apache-2 | you may not use this file except in compliance with the licen[sc]e (?:\\S+ ){0,20}?apache org licenses license 2 0
mpl-2 | this source code form is subject to the terms of the mozilla public licen[sc]e
epl-2 | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v2|2 0)
openssl | this product includes software developed by the openssl project
python-2 | psf licen[sc]e agreement for python
postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ofl-1.1 | this font software is licen[sc]ed under the sil open font licen[sc]e
"""),
    # addresses
    (0.9, """
mit | opensource org licenses? mit
apache-2 | (?:apache org licenses license|opensource org licenses? apache) 2 0
bsd-2-clause | opensource org licenses? bsd 2 clause
bsd-3-clause | opensource org licenses? bsd 3 clause
isc | opensource org licenses? isc
mpl-2 | mozilla org (?:en us )?mpl 2 0
epl-1 | eclipse org legal epl v10
epl-2 | eclipse org legal epl (?:v20|2 0)
gpl-2 | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3 | gnu org licenses gpl 3 0
lgpl-2.1 | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3 | gnu org licenses lgpl 3 0
agpl-3 | gnu org licenses agpl 3 0
gpl | gnu org (?:licenses|copyleft) gpl
lgpl | gnu org (?:licenses|copyleft) lgpl
gfdl | gnu org (?:licenses|copyleft) fdl
cc-by | creativecommons org licenses by
cc-by-sa | creativecommons org licenses by sa
cc-by-nd | creativecommons org licenses by nd
cc-by-nc | creativecommons org licenses by nc
cc-by-nc-sa | creativecommons org licenses by nc sa
cc-by-nc-nd | creativecommons org licenses by nc nd
cc0 | creativecommons org publicdomain zero
public-domain | creativecommons org publicdomain mark
bsl-1 | boost org license 1 0
unlicense | unlicense org
wtfpl | wtfpl net
ofl-1.1 | scripts sil org ofl
odbl-1 | opendatacommons org licenses odbl
odc-by-1 | opendatacommons org licenses by
pddl-1 | opendatacommons org licenses pddl
elastic-2 | elastic co licensing elastic license
sspl-1 | mongodb com licensing server side public license
busl-1.1 | mariadb com bsl11
polyform-noncommercial-1.0.0 | polyformproject org licenses noncommercial 1 0 0
"""),
    # names without a version
    (0.8, """
gpl | gnu general public licen[sc]e
lgpl | gnu (?:lesser|library) general public licen[sc]e
agpl | (?:gnu )?affero general public licen[sc]e
gfdl | gnu free documentation licen[sc]e
apache | apache (?:software )?licen[sc]e
mpl | mozilla public licen[sc]e
epl | eclipse public licen[sc]e
eupl | european union public licen[sc]e
cddl | common development and distribution licen[sc]e
artistic | artistic licen[sc]e
bsd | bsd (?:style )?licen[sc]e
mit | mit (?:style )?licen[sc]e
mit | expat licen[sc]e
isc | isc licen[sc]e
zlib | zlib (?:libpng )?licen[sc]e
bsl-1 | boost software licen[sc]e
busl | business source licen[sc]e
sspl | server side public licen[sc]e
elastic | elastic licen[sc]e
ofl | (?:sil )?open font licen[sc]e
odbl | open database licen[sc]e
psf | python software foundation licen[sc]e
postgresql | postgresql licen[sc]e
ncsa | university of illinois (?:ncsa )?open source licen[sc]e
ms-pl | microsoft public licen[sc]e
ms-rl | microsoft reciprocal licen[sc]e
w3c | w3c software (?:notice and )?licen[sc]e
lppl | latex project public licen[sc]e
qpl | q public licen[sc]e
osl | open software licen[sc]e
afl | academic free licen[sc]e
ecl | educational community licen[sc]e
cecill | cecill (?:[bc] )?(?:free software )?licen[sc]e
polyform | polyform (?:noncommercial|shield|strict|small business) licen[sc]e
public-domain | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain | (?:this|the) (?:work|file|code|software|text|document) is (?:hereby )?in the public domain
"""),
    # short names with what makes a license of them
    (0.7, """
gpl-2 | gpl 2(?: 0)?(?: only)?
gpl-2-or-later | gpl 2(?: 0)? or (?:any )?later
gpl-3 | gpl 3(?: 0)?(?: only)?
gpl-3-or-later | gpl 3(?: 0)? or (?:any )?later
lgpl-2.1 | lgpl 2 1(?: only)?
lgpl-2.1-or-later | lgpl 2 1 or (?:any )?later
lgpl-3 | lgpl 3(?: 0)?(?: only)?
lgpl-3-or-later | lgpl 3(?: 0)? or (?:any )?later
agpl-3 | agpl 3(?: 0)?(?: only)?
agpl-3-or-later | agpl 3(?: 0)? or (?:any )?later
gpl-2 | gplv2(?: 0)?(?: only)?
gpl-2-or-later | gplv2(?: 0)? or (?:any )?later
gpl-3 | gplv3(?: 0)?(?: only)?
gpl-3-or-later | gplv3(?: 0)? or (?:any )?later
lgpl-2.1 | lgplv2 1(?: only)?
lgpl-2.1-or-later | lgplv2 1 or (?:any )?later
lgpl-3 | lgplv3(?: 0)?(?: only)?
lgpl-3-or-later | lgplv3(?: 0)? or (?:any )?later
agpl-3 | agplv3(?: 0)?(?: only)?
agpl-3-or-later | agplv3(?: 0)? or (?:any )?later
gpl | gpl licen[sc]e
gpl | gpl licen[sc]ed
gpl | (?:under|of) the (?:gnu )?gpl
lgpl | (?:under|of) the (?:gnu )?lgpl
agpl | (?:under|of) the (?:gnu )?agpl
apache-2 | apache 2 0 licen[sc]ed?
apache-2 | asl 2 0
apache-2 | apache2 licen[sc]ed?
mpl-2 | mplv2
mpl-2 | mpl 2 0
epl-2 | eplv2
epl-2 | epl 2 0
eupl-1.2 | eupl v?1 2
cc0 | cc0(?: 1 0)?
cc-by | cc by [1-4] [05]
cc-by-sa | cc by sa(?: [1-4] [05])?
cc-by-nd | cc by nd(?: [1-4] [05])?
cc-by-nc-sa | cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | cc by nc nd(?: [1-4] [05])?
mit | mit licen[sc]ed
mit | licen[sc]e mit
bsd-2-clause | bsd 2 clause
bsd-3-clause | bsd 3 clause
bsd-4-clause | bsd 4 clause
unlicense | (?:under|of) the unlicense
wtfpl | (?:under|of) the wtfpl
odbl | (?:under|of) the odbl
"""),
    # what only says that there are terms
    (0.4, """
all-rights-reserved | all rights reserved
proprietary | proprietary and confidential
proprietary | unauthorized (?:copying|use|reproduction|distribution) (?:\\S+ ){0,12}?strictly prohibited
commercial-terms | under (?:a )?commercial licen[sc]e
noncommercial-terms | (?:for )?non ?commercial use only
noncommercial-terms | not for commercial use
creative-commons | (?:under|with) (?:a |the )?creative commons licen[sc]e
"""),
)


@dataclass(frozen=True)
class Rule:
    """A signature. Rules of a lower priority number are stronger; those that are `base` are never suppressed."""

    number: int
    label: str
    priority: int
    confidence: float
    base: bool
    pattern: str
    keywords: frozenset[bytes]

    @property
    def finder(self) -> re.Pattern:
        """The pattern with the space before its first word, in a text that has one before and after each word."""
        return re.compile(b" (?:" + self.pattern.encode() + b")(?= )")


def plain_words(pattern: str) -> frozenset[bytes]:
    """The words that every match of a pattern holds: those outside groups without any sign of an expression.

    A word written licen[sc]e counts as license, as `Scanner.candidates` reads licence.
    """
    flat = re.sub(r"\S+ \?\S+", "*", pattern.replace("licen[sc]e", "license"))
    while found := re.search(r"\((?:\?:)?([^()]*)\)(?:[?*+]|\{[^}]*\})*", flat):
        inner = found[1]
        flat = flat[: found.start()] + " " * inner.startswith(" ") + "*" + " " * inner.endswith(" ") + flat[found.end() :]
    return frozenset(w.encode() for w in flat.split(" ") if re.fullmatch("[a-z0-9]+", w))


def spdx_label(identifier: str) -> str:
    """An identifier as a label: lower case, a final .0 and -only go; Creative Commons labels have no version."""
    label = re.sub(r"\.0(?=$|-(?:only|or-later)$)", "", identifier.lower().replace("-only", ""))
    return re.sub(r"^(cc0|cc-by(?:-[a-z]+)*)-[\d.]+$", r"\1", label)


def all_rules() -> list[Rule]:
    """All rules, by priority, then in the order in which they are written."""
    rows = [("base", 0.95, *row.split(" | ")) for row in BASE.strip().splitlines()]
    spdx = [(spdx_label(i), "spdx licen[sc]e identifier " + re.sub("[^a-z0-9]+", " ", i.lower())) for i in SPDX.split()]
    rows += [(0, 1.0, label, pattern) for label, pattern in spdx]
    for priority, (confidence, text) in enumerate(CLASSES, 1):
        rows += [(priority, confidence, *row.split(" | ")) for row in text.strip().splitlines()]
    return [Rule(n, label, 1 if kind == "base" else kind, confidence, kind == "base", pattern, plain_words(pattern)) for n, (kind, confidence, label, pattern) in enumerate(rows)]
