"""Ordered signature rules for licence mentions.

A rule matches normalised text: lower-case words with single spaces between them. ``RULES`` lists
them by hand, one a line: priority, relevance in percent, label, words that must all occur in the
text (the gate), and the regex. Rules of versioned families are written once with ``{v}``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    order: int
    priority: int
    relevance: int
    label: str
    gate: frozenset[bytes]
    regex: re.Pattern[bytes]


#: Names and identifiers of licences without a family of versions.
PLAIN = """
60 95 apache-2.0 | apache license | apache license(?: version)? 2(?: 0)?
60 90 apache-1.1 | apache license | apache(?: software)? license(?: version)? 1 1
60 90 apache-1.0 | apache license | apache(?: software)? license(?: version)? 1 0
55 90 apache-2.0 | apache | apache 2 0(?: license| licence)?
50 80 apache | apache license | apache(?: software)? license
50 80 apache | apache licence | apache(?: software)? licence
60 95 apache-2.0 | asl | asl 2 0
80 99 apache-2.0 | spdx apache | spdx license identifier apache 2 0
80 99 apache-1.1 | spdx apache | spdx license identifier apache 1 1
75 99 apache-2.0 | apache www | http www apache org licenses license 2 0
75 99 apache-2.0 | apache https | https www apache org licenses license 2 0
70 99 apache-2.0 | apache licensed | licensed under the apache license version 2 0(?: the license)?
80 99 mit | spdx mit | spdx license identifier mit
70 99 mit | permission granted charge | permission is hereby granted free of charge to any person obtaining a copy
70 95 mit | above copyright permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
60 95 mit | mit license | (?:the )?mit license
60 95 mit | mit licence | (?:the )?mit licence
65 97 mit | released mit | released under (?:the |an )?mit(?: license| licence)?
65 97 mit | licensed mit | licensed under (?:the |an )?mit(?: license| licence)?
65 97 mit | distributed mit | distributed under (?:the |an )?mit(?: license| licence)?
65 90 mit | expat license | expat license
65 90 mit | x11 license | (?:mit )?x11 license
75 99 mit | opensource mit | https? (?:www )?opensource org licenses mit(?: license php)?
62 90 mit-0 | mit attribution | mit no attribution(?: license)?
80 99 mit-0 | spdx mit 0 | spdx license identifier mit 0
60 95 bsd-2-clause | bsd clause | bsd 2 clause(?: license)?
60 95 bsd-3-clause | bsd clause | bsd 3 clause(?: license)?
60 95 bsd-4-clause | bsd clause | bsd 4 clause(?: license)?
60 95 bsd-2-clause | clause bsd | (?:2|two) clause bsd(?: license)?
60 95 bsd-3-clause | clause bsd | (?:3|three) clause bsd(?: license)?
60 95 bsd-4-clause | clause bsd | (?:4|four) clause bsd(?: license)?
60 95 bsd-2-clause | simplified bsd | simplified bsd(?: license)?
60 95 bsd-3-clause | bsd | (?:new|modified|revised) bsd(?: license)?
60 95 bsd-3-clause | new bsd | new bsd license
60 95 bsd-4-clause | original bsd | original bsd(?: license)?
50 80 bsd | bsd license | bsd(?: style)? license
50 80 bsd | bsd licence | bsd(?: style)? licence
60 95 0bsd | bsd zero | (?:zero clause bsd|bsd zero clause)(?: license)?
60 95 0bsd | 0bsd | 0bsd
80 99 bsd-2-clause | spdx bsd | spdx license identifier bsd 2 clause
80 99 bsd-3-clause | spdx bsd | spdx license identifier bsd 3 clause
65 95 bsd | redistribution binary forms | redistribution and use in source and binary forms with or without modification are permitted
66 95 bsd-3-clause | endorse promote products | neither the name of (?:(?!neither the name of ).)+? may be used to endorse or promote products
66 95 bsd-4-clause | advertising acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
60 90 isc | isc license | isc license
60 90 isc | isc licence | isc licence
65 95 isc | permission fee purpose | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
80 99 isc | spdx isc | spdx license identifier isc
60 90 zlib | zlib license | zlib(?: libpng)? license
65 95 zlib | origin software misrepresented | the origin of this software must not be misrepresented
60 90 libpng | libpng license | libpng(?: version 2)? license
60 90 boost-1.0 | boost license | boost software license(?: version)?(?: 1 0)?
75 99 boost-1.0 | boost org license | https? www boost org license 1 0 txt
80 99 boost-1.0 | spdx bsl | spdx license identifier bsl 1 0
60 90 unlicense | unlicense | (?:the )?unlicense
65 95 unlicense | unencumbered public domain | this is free and unencumbered software released into the public domain
60 90 wtfpl | wtfpl | wtfpl
65 95 wtfpl | fuck public license | do what the fuck you want to public license
60 90 cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
65 95 cc0-1.0 | creativecommons zero | creativecommons org publicdomain zero 1 0
65 95 cc0-1.0 | commons zero | creative commons zero(?: v?1 0)?(?: universal)?
50 70 public-domain | public domain | (?:placed |released |dedicated )?(?:in|into|to) the public domain
45 60 public-domain | public domain dedication | public domain dedication
65 90 odbl-1.0 | open database license | open database license(?: odbl)?
65 90 odbl-1.0 | odbl | odbl(?: v?1 0)?
65 90 odc-by-1.0 | open data commons attribution | open data commons attribution license
65 90 pddl-1.0 | public domain dedication license | public domain dedication and license
60 90 artistic-1.0 | artistic license 1 | artistic license(?: version)? 1(?: 0)?
60 90 artistic-2.0 | artistic license 2 | artistic license(?: version)? 2(?: 0)?
50 80 artistic | artistic license | artistic license
60 90 postgresql | postgresql | postgresql licen[cs]e
60 90 python-2.0 | python foundation license | python software foundation license(?: version 2)?
60 90 psf-2.0 | psf license | psf license(?: version 2)?
60 90 php-3.01 | php license | php license(?: version)? 3(?: 01)?
60 90 ruby | ruby license | ruby(?: s)? license
60 90 openssl | openssl license | openssl license
60 90 ssleay | ssleay license | (?:original )?ssleay license
60 90 curl | curl license | curl license
60 90 ncsa | ncsa license | (?:university of illinois )?ncsa(?: open source)? license
60 90 w3c | w3c license | w3c software(?: notice and)? license
60 90 ofl-1.1 | open font license | (?:sil )?open font license(?: version)?(?: 1 1)?
60 90 ms-pl | microsoft public license | microsoft public license(?: ms pl)?
60 90 ms-rl | microsoft reciprocal license | microsoft reciprocal license(?: ms rl)?
60 90 afl-3.0 | academic free license | academic free license(?: version)?(?: v?3 0)?
60 90 osl-3.0 | open software license | open software license(?: version)?(?: v?3 0)?
60 90 upl-1.0 | universal permissive license | universal permissive license(?: version)?(?: 1 0)?
60 90 bsl-1.1 | business source license | business source license(?: version)?(?: 1 1)?
60 90 sspl-1.0 | server side public license | server side public license(?: version)?(?: 1)?
60 90 elastic-2.0 | elastic license | elastic license(?: version)?(?: 2 0)?
60 90 polyform | polyform license | polyform .{1,40}? license
60 90 commons-clause | commons clause | commons clause(?: license condition)?
60 90 json | software good evil | the software shall be used for good not evil
60 90 vim | vim license | vim license
60 90 tcl | tcl license | tcl tk license
60 90 beerware | beerware license | (?:the )?beerware license
60 90 beerware | beer ware license | (?:the )?beer ware license
60 90 bigscience-openrail | openrail | (?:bigscience |bigcode )?openrail(?: m)?
60 90 bigscience-openrail | open rail | (?:bigscience |bigcode )?open rail(?: m)?
60 90 llama-community | llama community license | llama(?: 2| 3)? community license(?: agreement)?
60 90 aladdin | aladdin license | aladdin free public license
60 90 sleepycat | sleepycat license | sleepycat license
60 90 qpl-1.0 | q public license | q public license(?: version)?(?: 1 0)?
60 90 ipl-1.0 | ibm public license | ibm public license(?: version)?(?: 1 0)?
60 90 cpl-1.0 | common public license | common public license(?: version)?(?: 1 0)?
60 90 lppl | latex project public license | latex project public license
60 90 ofl-1.1 | scripts sil org ofl | scripts sil org ofl
40 40 proprietary | rights reserved | all rights reserved
45 60 proprietary | proprietary confidential | proprietary and confidential
45 60 proprietary | unauthorized copying | unauthorized copying of this file
45 60 proprietary | commercial license required | commercial license (?:is )?required
40 50 noncommercial | non commercial use only | (?:for )?non commercial use only
40 50 noncommercial | noncommercial use only | (?:for )?noncommercial use only
40 50 research-only | research purposes only | (?:for )?(?:academic )?research purposes only
30 30 copyright-notice | copyright c | copyright c (?:19|20)[0-9][0-9]
30 30 copyright-notice | copyright | copyright (?:19|20)[0-9][0-9]
30 30 warranty-disclaimer | provided software | (?:this )?software is provided (?:by .{1,60}? )?as is
20 20 license-reference | see license file | see (?:the )?license file
20 20 license-reference | license terms | under the terms of (?:the|this) license
20 20 license-reference | licensed under | licensed under the terms
20 20 license-tag | spdx license identifier | spdx license identifier
"""

#: Families: name, versions, then their rules with {v} for a version and {l} for the label.
FAMILIES = {
    "gpl": (("1", "2", "3"), """
72 99 {l} | spdx gpl | spdx license identifier gpl {v} 0(?: only| or later)?
66 97 {l} | gnu general public license | gnu general public license(?: as published by the free software foundation)?(?: either)? version {v}(?: 0)?
66 97 {l} | gnu general public license v{v} | gnu general public license v{v}(?: 0)?
64 95 {l} | gplv{v} | (?:gnu )?gplv{v}(?: 0)?
64 95 {l} | gpl | (?:gnu )?gpl (?:version |v)?{v}(?: 0)?(?: only| or later)?
62 95 {l} | general public license | general public license (?:version |v){v}(?: 0)?
76 99 {l} | gnu licenses gpl | https? www gnu org licenses(?: old licenses)? gpl {v} 0(?: html| txt)?
"""),
    "lgpl": (("2", "2 1", "3"), """
72 99 {l} | spdx lgpl | spdx license identifier lgpl {v}(?: 0)?(?: only| or later)?
67 97 {l} | gnu lesser general public license | gnu lesser general public license(?: as published by the free software foundation)?(?: either)? (?:version |v){v}
67 97 {l} | gnu library general public license | gnu library general public license(?: as published by the free software foundation)?(?: either)? (?:version |v){v}
64 95 {l} | lgplv{w} | (?:gnu )?lgplv{v}
64 95 {l} | lgpl | (?:gnu )?lgpl (?:version |v)?{v}(?: only| or later)?
"""),
    "agpl": (("1", "3"), """
72 99 {l} | spdx agpl | spdx license identifier agpl {v} 0(?: only| or later)?
67 97 {l} | gnu affero general public license | gnu affero general public license(?: as published by the free software foundation)?(?: either)? (?:version |v){v}
64 95 {l} | agplv{v} | (?:gnu )?agplv{v}
64 95 {l} | agpl | (?:gnu )?agpl (?:version |v)?{v}(?: 0)?
"""),
    "gfdl": (("1 1", "1 2", "1 3"), """
66 95 {l} | gnu free documentation license | gnu free documentation license version {v}
64 95 {l} | gfdl | gfdl (?:version |v)?{v}
"""),
    "mpl": (("1 0", "1 1", "2 0"), """
72 99 {l} | spdx mpl | spdx license identifier mpl {v}
66 95 {l} | mozilla public license | mozilla public license (?:version |v)?{v}
64 90 {l} | mpl | mpl (?:version |v)?{v}
76 99 {l} | mozilla mpl | mozilla org mpl {v}
"""),
    "epl": (("1 0", "2 0"), """
72 99 {l} | spdx epl | spdx license identifier epl {v}
66 95 {l} | eclipse public license | eclipse public license (?:version |v)?{v}
64 90 {l} | epl | epl (?:version |v)?{v}
"""),
    "eupl": (("1 0", "1 1", "1 2"), """
66 95 {l} | european union public licence | european union public licence (?:version |v)?{v}
64 90 {l} | eupl | eupl (?:version |v)?{v}
"""),
    "cddl": (("1 0", "1 1"), """
66 95 {l} | common development distribution license | common development and distribution license (?:cddl )?(?:version |v)?{v}
64 90 {l} | cddl | cddl (?:version |v)?{v}
"""),
    "cecill": (("1 0", "2 0", "2 1"), """
64 90 {l} | cecill | cecill(?: license| licence)? (?:version |v)?{v}
"""),
    **{
        f"cc-{kind.replace(' ', '-')}": (("1 0", "2 0", "2 5", "3 0", "4 0"), """
66 97 {l} | cc by | cc %s {v}(?: international| unported| generic)?
76 99 {l} | creativecommons licenses | creativecommons org licenses %s {v}
72 97 {l} | creative commons | creative commons (?:license )?%s {v}
""" % (kind, kind, words))
        for kind, words in (
            ("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nd", "attribution no ?deriv(?:ative)?s"),
            ("by nc", "attribution non ?commercial"), ("by nc sa", "attribution non ?commercial share ?alike"),
            ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
        )
    },
}

#: Families without a version.
GENERIC = """
52 85 gpl | gnu general public license | gnu general public license
50 80 gpl | gpl | (?:gnu )?gpl(?: license)?
53 85 lgpl | gnu lesser general public license | gnu lesser general public license
50 80 lgpl | lgpl | (?:gnu )?lgpl(?: license)?
53 85 agpl | gnu affero general public license | gnu affero general public license
50 80 agpl | agpl | (?:gnu )?agpl(?: license)?
50 80 gfdl | gnu free documentation license | gnu free documentation license
50 80 mpl | mozilla public license | mozilla public license
50 80 epl | eclipse public license | eclipse public license
50 80 eupl | european union public licence | european union public licence
50 80 cddl | common development distribution license | common development and distribution license
50 80 cc-by | cc by | cc by
51 80 cc-by-sa | cc by sa | cc by sa
51 80 cc-by-nd | cc by nd | cc by nd
51 80 cc-by-nc | cc by nc | cc by nc
52 80 cc-by-nc-sa | cc by nc sa | cc by nc sa
52 80 cc-by-nc-nd | cc by nc nd | cc by nc nd
45 70 creative-commons | creative commons | creative commons(?: licen[cs]e)?
"""


def _rule(order: int, line: str) -> Rule:
    head, gate, regex = (x.strip() for x in line.split("|", 2))
    priority, relevance, label = head.split()
    return Rule(order, int(priority), int(relevance), label, frozenset(gate.encode().split()), re.compile(rf"(?<= ){regex}(?= )".encode()))


def build() -> list[Rule]:
    lines = [x for x in (PLAIN + GENERIC).splitlines() if x.strip()]
    for name, (versions, forms) in FAMILIES.items():
        for v in versions:
            label = f"{name}-{v.replace(' ', '.') if ' ' in v else v + '.0'}"
            lines += [x.replace("{v}", v).replace("{w}", v.split()[0]).replace("{l}", label) for x in forms.splitlines() if x.strip()]
    return [_rule(i, x) for i, x in enumerate(lines)]


RULES = build()
