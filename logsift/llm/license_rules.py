"""Hand-written license signatures.

One line per signature: label | priority | keyword | pattern. Texts are matched
with A-Z lower-cased. A blank in a pattern stands for a run of one or more white
space characters and comment marks, however long. A signature is only tried on texts
that hold one word of its keyword. Priorities: 4 a declared identifier, 3 a license address
or a full header, 2 a license name, 1 a loose mention. The labels are SPDX-like
ids of public licenses.
"""

import re

SIGNATURES = r"""
agpl-1.0 | 4 | spdx | spdx-license-identifier: ?\(?agpl-1\.0(-only|-or-later)?\b
agpl-3.0 | 4 | spdx | spdx-license-identifier: ?\(?agpl-3\.0(-only|-or-later)?\b
apache-1.1 | 4 | spdx | spdx-license-identifier: ?\(?apache-1\.1\b
apache-2.0 | 4 | spdx | spdx-license-identifier: ?\(?apache-2\.0\b
artistic-2.0 | 4 | spdx | spdx-license-identifier: ?\(?artistic-2\.0\b
0bsd | 4 | spdx | spdx-license-identifier: ?\(?0bsd\b
bsd-2-clause | 4 | spdx | spdx-license-identifier: ?\(?bsd-2-clause\b
bsd-3-clause | 4 | spdx | spdx-license-identifier: ?\(?bsd-3-clause\b
bsd-4-clause | 4 | spdx | spdx-license-identifier: ?\(?bsd-4-clause\b
bsl-1.0 | 4 | spdx | spdx-license-identifier: ?\(?bsl-1\.0\b
cc0-1.0 | 4 | spdx | spdx-license-identifier: ?\(?cc0-1\.0\b
cc-by-4.0 | 4 | spdx | spdx-license-identifier: ?\(?cc-by-4\.0\b
cc-by-sa-4.0 | 4 | spdx | spdx-license-identifier: ?\(?cc-by-sa-4\.0\b
cc-by-nc-4.0 | 4 | spdx | spdx-license-identifier: ?\(?cc-by-nc-4\.0\b
cc-by-nd-4.0 | 4 | spdx | spdx-license-identifier: ?\(?cc-by-nd-4\.0\b
cddl-1.0 | 4 | spdx | spdx-license-identifier: ?\(?cddl-1\.0\b
cddl-1.1 | 4 | spdx | spdx-license-identifier: ?\(?cddl-1\.1\b
cecill-2.1 | 4 | spdx | spdx-license-identifier: ?\(?cecill-2\.1\b
ecl-2.0 | 4 | spdx | spdx-license-identifier: ?\(?ecl-2\.0\b
epl-1.0 | 4 | spdx | spdx-license-identifier: ?\(?epl-1\.0\b
epl-2.0 | 4 | spdx | spdx-license-identifier: ?\(?epl-2\.0\b
eupl-1.2 | 4 | spdx | spdx-license-identifier: ?\(?eupl-1\.2\b
gpl-1.0 | 4 | spdx | spdx-license-identifier: ?\(?gpl-1\.0(-only|-or-later|\+)?
gpl-2.0 | 4 | spdx | spdx-license-identifier: ?\(?gpl-2\.0(-only|-or-later|\+)?
gpl-3.0 | 4 | spdx | spdx-license-identifier: ?\(?gpl-3\.0(-only|-or-later|\+)?
isc | 4 | spdx | spdx-license-identifier: ?\(?isc\b
lgpl-2.0 | 4 | spdx | spdx-license-identifier: ?\(?lgpl-2\.0(-only|-or-later|\+)?
lgpl-2.1 | 4 | spdx | spdx-license-identifier: ?\(?lgpl-2\.1(-only|-or-later|\+)?
lgpl-3.0 | 4 | spdx | spdx-license-identifier: ?\(?lgpl-3\.0(-only|-or-later|\+)?
mit | 4 | spdx | spdx-license-identifier: ?\(?mit\b(?!-)
mit-0 | 4 | spdx | spdx-license-identifier: ?\(?mit-0\b
mpl-1.1 | 4 | spdx | spdx-license-identifier: ?\(?mpl-1\.1\b
mpl-2.0 | 4 | spdx | spdx-license-identifier: ?\(?mpl-2\.0\b
ncsa | 4 | spdx | spdx-license-identifier: ?\(?ncsa\b
ofl-1.1 | 4 | spdx | spdx-license-identifier: ?\(?ofl-1\.1\b
openssl | 4 | spdx | spdx-license-identifier: ?\(?openssl\b
postgresql | 4 | spdx | spdx-license-identifier: ?\(?postgresql\b
python-2.0 | 4 | spdx | spdx-license-identifier: ?\(?(python|psf)-2\.0\b
unlicense | 4 | spdx | spdx-license-identifier: ?\(?unlicense\b
upl-1.0 | 4 | spdx | spdx-license-identifier: ?\(?upl-1\.0\b
wtfpl | 4 | spdx | spdx-license-identifier: ?\(?wtfpl\b
zlib | 4 | spdx | spdx-license-identifier: ?\(?zlib\b
agpl-3.0 | 3 | gnu.org | gnu\.org/licenses/agpl(-3\.0)?\b
fdl-1.3 | 3 | gnu.org | gnu\.org/(licenses|copyleft)/fdl(-1\.[123])?\b
gpl-2.0 | 3 | gnu.org | gnu\.org/licenses/(old-licenses/)?gpl-2\.0
gpl-3.0 | 3 | gnu.org | gnu\.org/licenses/gpl-3\.0
gpl | 3 | gnu.org | gnu\.org/(licenses|copyleft)/gpl\b(?!-)
lgpl-2.1 | 3 | gnu.org | gnu\.org/licenses/(old-licenses/)?lgpl-2\.1
lgpl-3.0 | 3 | gnu.org | gnu\.org/licenses/lgpl-3\.0
lgpl | 3 | gnu.org | gnu\.org/(licenses|copyleft)/lesser\b
gnu-any | 1 | gnu.org | gnu\.org/licenses/
apache-2.0 | 3 | apache.org | apache\.org/licenses/license-2\.0
apache-1.1 | 3 | apache.org | apache\.org/licenses/license-1\.1
apache-1.0 | 3 | apache.org | apache\.org/licenses/license-1\.0
mit | 3 | opensource.org | opensource\.org/licen[sc]es?/mit\b
bsd-3-clause | 3 | opensource.org | opensource\.org/licen[sc]es?/bsd-3-clause
bsd-2-clause | 3 | opensource.org | opensource\.org/licen[sc]es?/bsd-2-clause
bsd | 3 | opensource.org | opensource\.org/licen[sc]es?/bsd-license
isc | 3 | opensource.org | opensource\.org/licen[sc]es?/isc
apache-2.0 | 3 | opensource.org | opensource\.org/licen[sc]es?/apache-?2\.0
artistic-2.0 | 3 | opensource.org | opensource\.org/licen[sc]es?/artistic(-license)?-2\.0
gpl-2.0 | 3 | opensource.org | opensource\.org/licen[sc]es?/gpl-2\.0
gpl-3.0 | 3 | opensource.org | opensource\.org/licen[sc]es?/gpl-3\.0
mpl-2.0 | 3 | opensource.org | opensource\.org/licen[sc]es?/mpl-2\.0
zlib | 3 | opensource.org | opensource\.org/licen[sc]es?/zlib
mpl-2.0 | 3 | mozilla.org | mozilla\.org/(en-us/)?mpl/2\.0
mpl-1.1 | 3 | mozilla.org | mozilla\.org/mpl/mpl-1\.1
mpl | 2 | mozilla.org | mozilla\.org/(en-us/)?mpl\b
epl-1.0 | 3 | eclipse.org | eclipse\.org/legal/epl-v10
epl-2.0 | 3 | eclipse.org | eclipse\.org/legal/epl-(v20|2\.0)
edl-1.0 | 3 | eclipse.org | eclipse\.org/org/documents/edl-v10
boost | 3 | boost.org | boost\.org/license_1_0
unlicense | 3 | unlicense.org | unlicense\.org
wtfpl | 3 | wtfpl.net | wtfpl\.net
ofl-1.1 | 3 | scripts.sil.org | scripts\.sil\.org/ofl
cc0-1.0 | 3 | creativecommons.org | creativecommons\.org/publicdomain/zero/1\.0
cc-pdm-1.0 | 3 | creativecommons.org | creativecommons\.org/publicdomain/mark/1\.0
cc-by-1.0 | 3 | creativecommons.org | creativecommons\.org/licenses/by/1\.0
cc-by-2.0 | 3 | creativecommons.org | creativecommons\.org/licenses/by/2\.0
cc-by-2.5 | 3 | creativecommons.org | creativecommons\.org/licenses/by/2\.5
cc-by-3.0 | 3 | creativecommons.org | creativecommons\.org/licenses/by/3\.0
cc-by-4.0 | 3 | creativecommons.org | creativecommons\.org/licenses/by/4\.0
cc-by-sa-1.0 | 3 | creativecommons.org | creativecommons\.org/licenses/by-sa/1\.0
cc-by-sa-2.0 | 3 | creativecommons.org | creativecommons\.org/licenses/by-sa/2\.0
cc-by-sa-2.5 | 3 | creativecommons.org | creativecommons\.org/licenses/by-sa/2\.5
cc-by-sa-3.0 | 3 | creativecommons.org | creativecommons\.org/licenses/by-sa/3\.0
cc-by-sa-4.0 | 3 | creativecommons.org | creativecommons\.org/licenses/by-sa/4\.0
cc-by-nc-2.0 | 3 | creativecommons.org | creativecommons\.org/licenses/by-nc/2\.0
cc-by-nc-2.5 | 3 | creativecommons.org | creativecommons\.org/licenses/by-nc/2\.5
cc-by-nc-3.0 | 3 | creativecommons.org | creativecommons\.org/licenses/by-nc/3\.0
cc-by-nc-4.0 | 3 | creativecommons.org | creativecommons\.org/licenses/by-nc/4\.0
cc-by-nd-2.0 | 3 | creativecommons.org | creativecommons\.org/licenses/by-nd/2\.0
cc-by-nd-3.0 | 3 | creativecommons.org | creativecommons\.org/licenses/by-nd/3\.0
cc-by-nd-4.0 | 3 | creativecommons.org | creativecommons\.org/licenses/by-nd/4\.0
cc-by-nc-sa-2.0 | 3 | creativecommons.org | creativecommons\.org/licenses/by-nc-sa/2\.0
cc-by-nc-sa-2.5 | 3 | creativecommons.org | creativecommons\.org/licenses/by-nc-sa/2\.5
cc-by-nc-sa-3.0 | 3 | creativecommons.org | creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-nc-sa-4.0 | 3 | creativecommons.org | creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-nd-2.0 | 3 | creativecommons.org | creativecommons\.org/licenses/by-nc-nd/2\.0
cc-by-nc-nd-3.0 | 3 | creativecommons.org | creativecommons\.org/licenses/by-nc-nd/3\.0
cc-by-nc-nd-4.0 | 3 | creativecommons.org | creativecommons\.org/licenses/by-nc-nd/4\.0
cc-any | 1 | creativecommons.org | creativecommons\.org/licenses/
mit | 3 | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
isc | 3 | permission to use | permission to use, copy, modify, and(/or)? distribute this software for any purpose with or without fee is hereby granted, provided that
0bsd | 3 | permission to use | permission to use, copy, modify, and(/or)? distribute this software for any purpose with or without fee is hereby granted\.
postgresql | 3 | permission to use | permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee
hpnd | 3 | permission to use | permission to use, copy, modify,( and)? distribute(, and sell)? this software and its documentation for any purpose( is hereby granted)? without fee
bsd | 2 | redistribution and use | redistribution and use in source and binary forms, with or without modification, are permitted
bsd-3-clause | 3 | endorse or promote | neither the names? of .{1,120}? may be used to endorse or promote products derived from
bsd-4-clause | 3 | advertising materials | all advertising materials mentioning features or use of this software must display
bsd-2-clause | 3 | freebsd project | official policies, either expressed or implied, of the freebsd project
zlib | 3 | as-is | this software is provided .as-is., without any express or implied warranty
boost | 3 | boost software | boost software license,? -? ?version 1\.0
unlicense | 3 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 3 | what the fuck | do what the fuck you want to public license
beerware | 3 | beer-ware | the beer-ware license
gpl-2.0 | 3 | general public | gnu general public license as published by the free software foundation;? (either )?version 2\b
gpl-3.0 | 3 | general public | gnu general public license as published by the free software foundation,? (either )?version 3\b
lgpl-2.1 | 3 | general public | gnu lesser general public license as published by the free software foundation;? (either )?version 2\.1
lgpl-3.0 | 3 | general public | gnu lesser general public license as published by the free software foundation,? (either )?version 3\b
lgpl-2.0 | 3 | general public | gnu library general public license as published by the free software foundation;? (either )?version 2\b
agpl-3.0 | 3 | general public | gnu affero general public license as published by the free software foundation,? (either )?version 3\b
apache-2.0 | 3 | apache license | licensed under the apache license, version 2\.0
apache-2.0 | 2 | apache license | apache license,? ?\(?(version|v\.?)? ?2(\.0)?\b
apache-1.1 | 2 | apache software license | apache software license,? version 1\.1
apache-1.0 | 2 | apache software license | apache software license,? version 1\.0
apache | 2 | apache license | apache license
apache-2.0 | 2 | apache-2.0 | \bapache-2\.0\b
apache-2.0 | 2 | asl 2.0 | \basl 2\.0\b
gpl-1.0 | 2 | general public license | gnu general public license,? ?\(?(version|v\.?) ?1\b
gpl-2.0 | 2 | general public license | gnu general public license,? ?\(?(version|v\.?) ?2\b
gpl-3.0 | 2 | general public license | gnu general public license,? ?\(?(version|v\.?) ?3\b
gpl | 2 | general public license | gnu general public license
lgpl-2.1 | 2 | general public license | gnu lesser general public license,? ?\(?(version|v\.?) ?2\.1
lgpl-3.0 | 2 | general public license | gnu lesser general public license,? ?\(?(version|v\.?) ?3\b
lgpl | 2 | general public license | gnu (lesser|library) general public license
agpl-3.0 | 2 | general public license | gnu affero general public license,? ?\(?(version|v\.?) ?3\b
agpl | 2 | general public license | gnu affero general public license
affero-1.0 | 2 | general public license | affero general public license,? version 1\b
fdl-1.1 | 2 | free documentation | gnu free documentation license,? version 1\.1
fdl-1.2 | 2 | free documentation | gnu free documentation license,? version 1\.2
fdl-1.3 | 2 | free documentation | gnu free documentation license,? version 1\.3
fdl | 2 | free documentation | gnu free documentation license
gpl-2.0 | 2 | gpl | \bgpl ?-?v?2(\.0)?\b
gpl-3.0 | 2 | gpl | \bgpl ?-?v?3(\.0)?\b
lgpl-2.1 | 2 | lgpl | \blgpl ?-?v?2\.1\b
lgpl-3.0 | 2 | lgpl | \blgpl ?-?v?3(\.0)?\b
agpl-3.0 | 2 | agpl | \bagpl ?-?v?3(\.0)?\b
gpl | 1 | gpl | \bgpl\b
lgpl | 1 | lgpl | \blgpl\b
agpl | 1 | agpl | \bagpl\b
mit | 2 | mit license | (released|licensed|distributed|available) under the (terms of the )?mit license
mit | 2 | mit license | \bthe mit license\b
mit | 2 | mit license | \bmit license\b
mit | 2 | license: mit | \blicense: ?mit\b
expat | 2 | expat license | \bexpat license\b
x11 | 2 | x11 license | \bx11 license\b
mit-0 | 2 | mit no attribution | mit no attribution
bsd-2-clause | 2 | bsd | \bbsd[ -]2[ -]clause\b
bsd-3-clause | 2 | bsd | \bbsd[ -]3[ -]clause\b
bsd-4-clause | 2 | bsd | \bbsd[ -]4[ -]clause\b
bsd-2-clause | 2 | simplified bsd | simplified bsd license
bsd-2-clause | 2 | freebsd license | freebsd license
bsd-3-clause | 2 | new bsd | new bsd license
bsd-3-clause | 2 | modified bsd | modified bsd license
bsd-3-clause | 2 | revised bsd | revised bsd license
bsd-4-clause | 2 | original bsd | original bsd license
bsd | 2 | bsd license | \bbsd(-style)? license
0bsd | 2 | zero-clause bsd | zero-clause bsd
isc | 2 | isc license | \bisc license\b
mpl-1.0 | 2 | mozilla public | mozilla public license,? (version|v\.?) ?1\.0
mpl-1.1 | 2 | mozilla public | mozilla public license,? (version|v\.?) ?1\.1
mpl-2.0 | 2 | mozilla public | mozilla public license,? (version|v\.?) ?2\.0
mpl | 2 | mozilla public | mozilla public license
mpl-2.0 | 2 | mpl | \bmpl[ -]?v?2\.0\b
npl-1.1 | 2 | netscape public | netscape public license
epl-1.0 | 2 | eclipse public | eclipse public license,? ?-? ?(version|v\.?)? ?1\.0
epl-2.0 | 2 | eclipse public | eclipse public license,? ?-? ?(version|v\.?)? ?2\.0
epl | 2 | eclipse public | eclipse public license
edl-1.0 | 2 | eclipse distribution | eclipse distribution license
cpl-1.0 | 2 | common public license | common public license
ibm-pl-1.0 | 2 | ibm public license | ibm public license
cddl-1.0 | 2 | common development | common development and distribution license,? (version|v\.?) ?1\.0
cddl-1.1 | 2 | common development | common development and distribution license,? (version|v\.?) ?1\.1
cddl | 2 | common development | common development and distribution license
cddl | 1 | cddl | \bcddl\b
artistic-1.0 | 2 | artistic license | artistic license,? (version )?1\.0
artistic-2.0 | 2 | artistic license | artistic license,? (version )?2\.0
artistic | 2 | artistic license | artistic license
perl | 2 | same terms as perl | same terms as perl itself
python-2.0 | 2 | python software foundation | python software foundation license
zpl-2.1 | 2 | zope public license | zope public license
php-3.01 | 2 | php license | \bphp license,? version 3\.01
php | 2 | php license | \bphp license\b
ruby | 2 | ruby license | \bruby license\b
openssl | 2 | openssl license | \bopenssl license\b
zlib | 2 | zlib license | \bzlib(/libpng)? license\b
libpng | 2 | libpng license | \blibpng license\b
ijg | 2 | independent jpeg | independent jpeg group
ncsa | 2 | ncsa open source | university of illinois/ncsa open source license
unlicense | 2 | the unlicense | \bthe unlicense\b
wtfpl | 2 | wtfpl | \bwtfpl\b
ofl-1.1 | 2 | open font license | sil open font license
eupl-1.1 | 2 | european union public | european union public licen[sc]e,? (version|v\.?) ?1\.1
eupl-1.2 | 2 | european union public | european union public licen[sc]e,? (version|v\.?) ?1\.2
eupl | 2 | european union public | european union public licen[sc]e
cecill | 2 | cecill | \bcecill(-[bc])?\b
ms-pl | 2 | microsoft public license | microsoft public license
ms-rl | 2 | microsoft reciprocal | microsoft reciprocal license
odbl-1.0 | 2 | open database license | open (data commons )?open database license|open database license
odc-by | 2 | open data commons | open data commons attribution license
pddl | 2 | public domain dedication | public domain dedication and license
sspl-1.0 | 2 | server side public | server side public license
busl-1.1 | 2 | business source | business source license
elastic-2.0 | 2 | elastic license | elastic license( 2\.0)?
commons-clause | 2 | commons clause | commons clause
rail-m | 2 | openrail | (bigscience |creativeml )?open ?rail(\+\+)?-?m?\b
llama | 2 | llama | llama [23](\.[0-9])? community license
ecl-2.0 | 2 | educational community | educational community license
osl-3.0 | 2 | open software license | open software license,? (version|v\.?)? ?3\.0
afl-3.0 | 2 | academic free license | academic free license
upl-1.0 | 2 | universal permissive | universal permissive license
vim | 2 | vim license | \bvim license\b
w3c | 2 | w3c software | w3c software notice and license
ogl-3.0 | 2 | open government | open government licen[sc]e
cc0-1.0 | 2 | cc0 | \bcc0([ -]1\.0)?\b
cc-by-nc-sa | 2 | cc | \bcc[ -]by[ -]nc[ -]sa\b
cc-by-nc-nd | 2 | cc | \bcc[ -]by[ -]nc[ -]nd\b
cc-by-nc | 2 | cc | \bcc[ -]by[ -]nc\b
cc-by-nd | 2 | cc | \bcc[ -]by[ -]nd\b
cc-by-sa | 2 | cc | \bcc[ -]by[ -]sa\b
cc-by-nc-4.0 | 2 | cc | \bcc[ -]by[ -]nc[ -]4\.0
cc-by-sa-4.0 | 2 | cc | \bcc[ -]by[ -]sa[ -]4\.0
cc-by-sa-3.0 | 2 | cc | \bcc[ -]by[ -]sa[ -]3\.0
cc-by-4.0 | 2 | cc | \bcc[ -]by[ -]4\.0
cc-by-3.0 | 2 | cc | \bcc[ -]by[ -]3\.0
cc-by | 2 | cc | \bcc[ -]by\b
cc-by-nc-sa | 2 | creative commons | creative commons attribution[ -]non-?commercial[ -]share-? ?alike
cc-by-nc-nd | 2 | creative commons | creative commons attribution[ -]non-?commercial[ -]no-? ?deriv(ative)?s?
cc-by-nc | 2 | creative commons | creative commons attribution[ -]non-?commercial
cc-by-nd | 2 | creative commons | creative commons attribution[ -]no-? ?deriv(ative)?s?
cc-by-sa | 2 | creative commons | creative commons attribution[ -]share-? ?alike
cc-by | 2 | creative commons | creative commons attribution
cc-any | 1 | creative commons | creative commons
public-domain | 2 | public domain | (released|placed|dedicated) (in|into|to) the public domain
public-domain | 1 | public domain | \bpublic domain\b
proprietary | 2 | all rights reserved | copyright .{1,80}? all rights reserved
proprietary | 1 | all rights reserved | all rights reserved
proprietary | 2 | proprietary and confidential | proprietary and confidential
"""

#: Words that say little on their own; a keyword is known by its longest other word.
COMMON = {"license", "public", "software", "open", "source", "the", "to", "and", "use", "no", "as", "is", "new", "what", "original", "modified",
          "revised", "simplified", "same", "terms", "development", "distribution"}


def word_of(keyword: str) -> str:
    """One word of a keyword, so that a name broken over lines still passes the prefilter."""
    words = re.findall(r"[^ ]+", keyword)
    return max([w for w in words if w not in COMMON] or words, key=len)


def signatures() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, Java pattern) per line."""
    out = []
    for line in SIGNATURES.strip().splitlines():
        label, priority, keyword, pattern = (x.strip() for x in line.split(" | ", 3))
        pattern = pattern.replace("[ -]", r"[\s-]").replace(" ?", r"\s*+").replace(" ", r"[\s*#/]++")
        out.append((label, int(priority), word_of(keyword), pattern))
    return out


def gates() -> list[str]:
    """Substrings of which a text with any signature holds one."""
    keywords = [line.split(" | ", 3)[2].strip() for line in SIGNATURES.strip().splitlines()]
    found = {"licen" if "licen" in k else word_of(k) for k in keywords}
    return sorted(g for g in found if not any(o != g and o in g for o in found))
