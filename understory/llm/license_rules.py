"""Ordered signature rules for licence and copyright wording.

A rule is ``label | keyword | priority | pattern``. Patterns are matched against a
text's lower-case words with one space between them; the keyword is a word that
any match holds, and gates the rule. Families with many versions are spelled out
by rule below the list.
"""

from __future__ import annotations

from typing import NamedTuple

# The three given phrases, then hand-written signatures.
BASE = """
cc-by | cc | 100 | cc by
gpl | general | 100 | general public license
reserved | reserved | 100 | all rights reserved
"""
SIGNATURES = """
gpl | gpl | 60 | gpl(?: v?[123](?: 0)?)?(?: only| or later)?
gpl | gnu | 62 | gnu gpl(?: v?[123])?
gpl | general | 85 | gnu general public licen[sc]e
gpl | general | 90 | gnu general public licen[sc]e version [123]
gpl | general | 90 | gnu general public licen[sc]e v[123]
gpl | general | 92 | terms of the gnu general public licen[sc]e as published by the free software foundation
gpl | general | 80 | general public licence
lgpl | lesser | 90 | (?:gnu )?lesser general public licen[sc]e(?: version [23](?: [01])?)?
lgpl | library | 90 | (?:gnu )?library general public licen[sc]e(?: version 2)?
lgpl | lgpl | 70 | lgpl(?: v?[23](?: [01])?)?(?: only| or later)?
agpl | affero | 90 | (?:gnu )?affero general public licen[sc]e(?: version [13])?
agpl | agpl | 70 | agpl(?: v?[13](?: 0)?)?(?: only| or later)?
gfdl | documentation | 80 | (?:gnu )?free documentation licen[sc]e(?: version 1 [123])?
gfdl | gfdl | 60 | gfdl(?: v?1 [123])?
gpl-exception | classpath | 80 | classpath exception
gpl-exception | linking | 70 | special linking exception
gpl-exception | runtime | 80 | gcc runtime library exception
gpl | copyleft | 40 | copyleft
gpl | fsf | 40 | published by the fsf
apache | apache | 80 | apache licen[sc]e(?: version)? [12](?: [01])?
apache | apache | 60 | apache licen[sc]e
apache | apache | 90 | licensed under the apache licen[sc]e version 2 0
apache | apache | 85 | apache software licen[sc]e(?: version)?(?: 1 [01])?
apache | asf | 80 | licensed to the apache software foundation asf
apache | apache | 70 | www apache org licenses license 2 0
mit | mit | 70 | mit licen[sc]e
mit | mit | 80 | licensed under the mit licen[sc]e
mit | mit | 80 | the mit licen[sc]e mit
mit | permission | 75 | permission is hereby granted free of charge to any person obtaining a copy
mit | merge | 70 | use copy modify merge publish distribute sublicense and or sell copies
mit | noninfringement | 50 | fitness for a particular purpose and noninfringement
x11 | x11 | 80 | x11 licen[sc]e
expat | expat | 80 | expat licen[sc]e
isc | isc | 70 | isc licen[sc]e
isc | permission | 72 | permission to use copy modify and or distribute this software for any purpose
bsd | bsd | 60 | bsd licen[sc]e
bsd-2 | bsd | 80 | (?:simplified|2 clause) bsd(?: licen[sc]e)?
bsd-2 | bsd | 80 | bsd 2 clause(?: licen[sc]e)?
bsd-3 | bsd | 80 | (?:new|modified|revised|3 clause) bsd(?: licen[sc]e)?
bsd-3 | bsd | 80 | bsd 3 clause(?: licen[sc]e)?
bsd-4 | bsd | 80 | (?:original|4 clause) bsd(?: licen[sc]e)?
bsd-4 | bsd | 80 | bsd 4 clause(?: licen[sc]e)?
bsd | redistribution | 75 | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions | 60 | redistributions of source code must retain the above copyright notice
bsd | redistributions | 60 | redistributions in binary form must reproduce the above copyright notice
bsd-3 | endorse | 70 | be used to endorse or promote products derived from this software without specific prior written permission
bsd-4 | advertising | 70 | all advertising materials mentioning features or use of this software must display
0bsd | 0bsd | 80 | 0bsd
zero-clause | clause | 80 | zero clause bsd
mpl | mozilla | 80 | mozilla public licen[sc]e(?: version)?(?: [12] [01])?
mpl | mpl | 60 | mpl(?: v?[12](?: [01])?)?
epl | eclipse | 80 | eclipse public licen[sc]e(?: version)?(?: [12](?: 0)?)?
edl | eclipse | 80 | eclipse distribution licen[sc]e(?: v?1 0)?
cpl | common | 80 | common public licen[sc]e(?: version)?(?: 1 0)?
cddl | cddl | 70 | cddl(?: 1 [01])?
cddl | common | 80 | common development and distribution licen[sc]e
eupl | european | 80 | european union public licen[sc]e(?: v?1 [012])?
eupl | eupl | 70 | eupl(?: v?1 [012])?
artistic | artistic | 70 | artistic licen[sc]e(?: 2 0)?
artistic | perl | 70 | same terms as perl itself
zlib | zlib | 70 | zlib licen[sc]e
zlib | libpng | 70 | zlib libpng licen[sc]e
zlib | misrepresented | 75 | the origin of this software must not be misrepresented
boost | boost | 80 | boost software licen[sc]e(?: version)?(?: 1 0)?
bsl | bsl | 60 | bsl 1 0
unlicense | unlicense | 70 | (?:the )?unlicense
unlicense | unencumbered | 75 | free and unencumbered software released into the public domain
wtfpl | wtfpl | 70 | wtfpl
wtfpl | want | 75 | do what the (?:fuck|f) you want to public licen[sc]e
ms-pl | microsoft | 80 | microsoft public licen[sc]e
ms-rl | microsoft | 80 | microsoft reciprocal licen[sc]e
psf | python | 80 | python software foundation licen[sc]e(?: version 2)?
python | python | 60 | python licen[sc]e
ruby | ruby | 60 | ruby licen[sc]e
php | php | 70 | php licen[sc]e(?: version)?(?: 3 0[01]?)?
zend | zend | 70 | zend engine licen[sc]e
openssl | openssl | 70 | openssl licen[sc]e
openssl | ssleay | 70 | ssleay licen[sc]e
curl | curl | 70 | curl licen[sc]e
ncsa | ncsa | 70 | (?:university of illinois )?ncsa open source licen[sc]e
postgresql | postgresql | 70 | postgresql licen[sc]e
sqlite | sqlite | 70 | sqlite blessing
bzip2 | bzip2 | 70 | bzip2 licen[sc]e
ofl | ofl | 70 | sil ofl(?: 1 [01])?
ofl | font | 80 | (?:sil )?open font licen[sc]e(?: version)?(?: 1 [01])?
osl | osl | 60 | osl(?: v?3 0)?
osl | software | 80 | open software licen[sc]e(?: v)?(?: ?3 0)?
afl | academic | 80 | academic free licen[sc]e(?: v)?(?: ?[23] [01])?
ecl | educational | 80 | educational community licen[sc]e(?: version)?(?: 2 0)?
upl | universal | 80 | universal permissive licen[sc]e
cecill | cecill | 70 | cecill(?: [bc])?(?: licen[sc]e)?
ipl | ibm | 80 | ibm public licen[sc]e(?: version)?(?: 1 0)?
spl | sun | 80 | sun public licen[sc]e
npl | netscape | 80 | netscape public licen[sc]e
qpl | qpl | 70 | qpl(?: 1 0)?
rpl | reciprocal | 70 | reciprocal public licen[sc]e
sleepycat | sleepycat | 70 | sleepycat licen[sc]e
vim | vim | 60 | vim licen[sc]e
w3c | w3c | 70 | w3c software (?:notice and )?licen[sc]e
wxwindows | wxwindows | 70 | wxwindows library licen[sc]e
zpl | zope | 80 | zope public licen[sc]e
icu | icu | 60 | icu licen[sc]e
unicode | unicode | 70 | unicode licen[sc]e(?: agreement)?
ijg | jpeg | 70 | independent jpeg group licen[sc]e
libtiff | libtiff | 70 | libtiff licen[sc]e
mulan | mulan | 70 | mulan psl(?: v2)?
sspl | server | 80 | server side public licen[sc]e
sspl | sspl | 70 | sspl(?: v?1)?
busl | business | 80 | business source licen[sc]e(?: 1 1)?
elastic | elastic | 80 | elastic licen[sc]e(?: 2 0)?
commons-clause | commons | 80 | commons clause
polyform | polyform | 80 | polyform (?:noncommercial|shield|strict|small business)
prosperity | prosperity | 70 | prosperity public licen[sc]e
parity | parity | 70 | parity public licen[sc]e
hippocratic | hippocratic | 70 | hippocratic licen[sc]e
rail | rail | 70 | (?:open|bigscience|creativeml open) rail(?: m)?(?: licen[sc]e)?
llama | llama | 70 | llama (?:[0-9] )*community licen[sc]e
odbl | odbl | 70 | odbl(?: 1 0)?
odbl | database | 80 | open database licen[sc]e(?: odbl)?
odc-by | attribution | 80 | open data commons attribution licen[sc]e
pddl | dedication | 80 | public domain dedication and licen[sc]e
ogl | government | 80 | open government licen[sc]e(?: v?[123](?: 0)?)?
etalab | etalab | 70 | (?:licence ouverte )?etalab(?: 2 0)?
dl-de | datenlizenz | 70 | datenlizenz deutschland
cc0 | cc0 | 70 | cc0(?: 1 0)?(?: universal)?
cc0 | creative | 80 | creative commons zero
cc | creative | 50 | creative commons
cc | creative | 60 | creative commons licen[sc]e
cc | creativecommons | 60 | creativecommons org licenses
cc-by | attribution | 75 | creative commons attribution
cc-by-sa | sharealike | 70 | attribution sharealike
cc-by-sa | share | 70 | attribution share alike
cc-by-nc | noncommercial | 70 | attribution noncommercial
cc-by-nc | commercial | 70 | attribution non commercial
cc-by-nd | noderivatives | 70 | attribution noderivatives
cc-by-nd | noderivs | 70 | attribution noderivs
public-domain | domain | 60 | (?:in|into|to) the public domain
public-domain | domain | 50 | public domain
public-domain | domain | 70 | dedicated to the public domain
reserved | droits | 60 | tous droits (?:reserves|réservés)
reserved | rechte | 60 | alle rechte vorbehalten
reserved | derechos | 60 | todos los derechos reservados
reserved | direitos | 60 | todos os direitos reservados
reserved | diritti | 60 | tutti i diritti riservati
reserved | reserved | 70 | some rights reserved
reserved | reserved | 70 | no rights reserved
copyright | copyright | 40 | copyright (?:c )?(?:19|20)[0-9][0-9]
copyright | copyright | 45 | copyright (?:c )?(?:19|20)[0-9][0-9] (?:19|20)[0-9][0-9]
copyright | copyright | 35 | copyright by
copyright | copyrighted | 35 | copyrighted (?:material|work|content)
copyright | copr | 30 | copr (?:19|20)[0-9][0-9]
proprietary | proprietary | 50 | proprietary and confidential
proprietary | proprietary | 40 | proprietary licen[sc]e
proprietary | confidential | 40 | trade secret and confidential
proprietary | reproduction | 50 | unauthorized reproduction or distribution
proprietary | reproduced | 50 | may not be reproduced (?:or distributed )?without
proprietary | redistribute | 50 | may not redistribute
proprietary | eula | 60 | end user licen[sc]e agreement eula
proprietary | user | 50 | end user licen[sc]e agreement
noncommercial | noncommercial | 40 | for noncommercial (?:use|purposes) only
noncommercial | commercial | 40 | for non commercial (?:use|purposes) only
noncommercial | personal | 40 | for personal use only
noncommercial | research | 40 | for research (?:use|purposes) only
no-ai | training | 50 | not be used (?:for|to) (?:ai |machine learning |model )?training
no-ai | mining | 50 | text and data mining (?:is )?(?:prohibited|reserved)
beerware | beerware | 70 | beerware licen[sc]e
json | evil | 70 | shall be used for good not evil
licence-notice | licensed | 20 | licensed under the terms of
licence-notice | licence | 20 | see the licence file
licence-notice | license | 20 | see the license file
licence-notice | license | 20 | see the license (?:file )?for (?:the specific language|details)
licence-notice | license | 25 | may not use this file except in compliance with the license
licence-notice | license | 15 | terms of this license
warranty | warranty | 20 | without warranty of any kind
warranty | warranties | 25 | without warranties or conditions of any kind
warranty | warranty | 20 | provided as is without (?:any )?warranty
warranty | merchantability | 20 | implied warranty of merchantability
warranty | liable | 20 | in no event shall the (?:authors?|copyright holders?|contributors?) be liable
"""
# Families by rule: Creative Commons by condition and version, and identifiers in SPDX tags.
CC_CONDITIONS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
SPDX_IDS = ("mit", "apache 2 0", "bsd 2 clause", "bsd 3 clause", "isc", "mpl 2 0", "gpl 2 0", "gpl 3 0", "lgpl 2 1",
            "lgpl 3 0", "agpl 3 0", "epl 2 0", "cc0 1 0", "unlicense", "zlib", "bsl 1 0")


class Rule(NamedTuple):
    order: int
    label: str
    keyword: str
    priority: int
    pattern: str
    base: bool


def _pattern(words: str) -> str:
    """Whole words only: a space before, which is consumed, and one after, which is not."""
    return f" (?:{words})(?= )"


def _lines(block: str) -> list[list[str]]:
    return [[part.strip() for part in line.split("|", 3)] for line in block.strip().splitlines()]


def _families() -> list[list[str]]:
    out = []
    for terms in CC_CONDITIONS:
        label = "cc-" + terms.replace(" ", "-")
        if terms != "by":
            out.append([label, "cc", "90", f"cc {terms}"])
        out += [[label, "cc", "95", f"cc {terms} {v}"] for v in CC_VERSIONS]
        out.append([label, "creativecommons", "95", f"creativecommons org licenses {terms} [1-4] [05]"])
    for name in SPDX_IDS:
        label = name.split(" ")[0] if not name.startswith("bsd") else name.replace(" clause", "").replace(" ", "-")
        out.append([label, "spdx", "99", f"spdx license identifier {name}(?: only| or later)?"])
    return out


def all_rules() -> list[Rule]:
    """Rules in order; where two are equal otherwise, the earlier one wins."""
    lines = [(line, True) for line in _lines(BASE)]
    lines += [(line, False) for line in _lines(SIGNATURES) + _families()]
    return [
        Rule(i, label, keyword, int(priority), _pattern(words), base)
        for i, ((label, keyword, priority, words), base) in enumerate(lines)
    ]
