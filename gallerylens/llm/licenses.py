"""License scans by ordered signature rules.

Each rule is a pattern written for one license and one way of naming it or one sentence of its text, has a keyword
and a priority, and is tried only on texts that hold its keyword, which is part of all that it matches.  Where one
find's interval contains another's, the one of higher priority stays, or the longer one of two of the same priority.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batched, raw, texts

#: ASCII other than letters and digits ends a word; A-Z are lower-cased.
_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))
#: Fixed phrases and their labels.
PHRASES = [((b"mit", b"license"), "mit"), ((b"apache", b"license"), "apache"), ((b"general", b"public", b"license"), "gpl")]

#: Signatures in order of priority: label | keyword | weight | pattern. Texts are normalised: words of letters and digits by single spaces.
SIGNATURES = {
    9: r"""
mit | permission is hereby granted free of charge | 0.97 | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | the software is provided as is | 0.8 | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit-0 | permission is hereby granted free of charge | 0.6 | permission is hereby granted free of charge to any person .{0,400}? to permit persons to whom the software is furnished to do so the software is provided
isc | permission to use copy modify and | 0.95 | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
bsd-0-clause | permission to use copy modify and | 0.9 | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd-3-clause | neither the name | 0.95 | neither the names? of \S+(?: \S+){0,12} nor the names of (?:its|their) contributors may be used to endorse
bsd-4-clause | all advertising materials | 0.95 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause | redistributions in binary form | 0.8 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
apache-2.0 | you may not use this file except | 0.97 | licensed under the apache license version 2 0 (?:the )?license you may not use this file except in compliance
apache-2.0 | apache org licenses license 2 0 | 0.97 | (?:http|https) www apache org licenses license 2 0
apache-2.0 | terms and conditions for use reproduction | 0.9 | terms and conditions for use reproduction and distribution 1 definitions
apache-1.1 | this product includes software developed by the apache | 0.9 | this product includes software developed by the apache software foundation
gpl-2.0 | this program is free software | 0.95 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2
gpl-3.0 | this program is free software | 0.95 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3
gpl-1.0 | version 1 february 1989 | 0.95 | gnu general public license version 1 february 1989
gpl-2.0 | version 2 june 1991 | 0.97 | gnu general public license version 2 june 1991
gpl-3.0 | version 3 29 june 2007 | 0.97 | gnu general public license version 3 29 june 2007
lgpl-2.0 | version 2 june 1991 | 0.97 | gnu library general public license version 2 june 1991
lgpl-2.1 | version 2 1 february 1999 | 0.97 | gnu lesser general public license version 2 1 february 1999
lgpl-3.0 | version 3 29 june 2007 | 0.97 | gnu lesser general public license version 3 29 june 2007
agpl-3.0 | version 3 19 november 2007 | 0.97 | gnu affero general public license version 3 19 november 2007
agpl-3.0 | affero general public | 0.95 | under the terms of the gnu affero general public license as published by the free software foundation (?:either )?version 3
lgpl-2.1 | lesser general public | 0.95 | under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 2 1
lgpl-3.0 | lesser general public | 0.95 | under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 3
gfdl-1.1 | free documentation license | 0.95 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 1
gfdl-1.2 | free documentation license | 0.95 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2
gfdl-1.3 | free documentation license | 0.95 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3
mpl-2.0 | this source code form is subject | 0.97 | this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0
mpl-1.1 | the contents of this file are subject | 0.95 | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | the contents of this file are subject | 0.95 | the contents of this file are subject to the mozilla public license version 1 0
cddl-1.0 | the contents of this file are subject | 0.95 | the contents of this file are subject to the terms of the common development and distribution license
epl-1.0 | accompanying materials are made available | 0.95 | accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 | accompanying materials are made available | 0.95 | accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
bsl-1.0 | boost software license version 1 0 | 0.97 | boost software license version 1 0 17th? august 2003|boost software license version 1 0 august 17th? 2003
zlib | this software is provided as is | 0.9 | this software is provided as is without any express or implied warranty in no event will the authors be held liable
wtfpl | do what the | 0.97 | do what the \S+ you want to public license
unlicense | free and unencumbered software | 0.97 | this is free and unencumbered software released into the public domain
ofl-1.1 | sil open font license | 0.95 | this font software is licensed under the sil open font license version 1 1
artistic-2.0 | artistic license | 0.9 | the artistic license 2 0 copyright
python-2.0 | python software foundation license | 0.95 | python software foundation license version 2
postgresql | permission to use copy modify and distribute | 0.9 | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ms-pl | microsoft public license | 0.95 | microsoft public license ms pl
ms-rl | microsoft reciprocal license | 0.95 | microsoft reciprocal license ms rl
curl | copyright and permission notice | 0.7 | copyright and permission notice copyright c \S+(?: \S+){0,9} all rights reserved permission to use copy modify and distribute
openssl | openssl toolkit | 0.9 | this product includes software developed by the openssl project for use in the openssl toolkit
cc0-1.0 | cc0 1 0 universal | 0.97 | creative commons (?:legal code )?cc0 1 0 universal
""",
    8: r"""
mit | spdx license identifier | 0.99 | spdx license identifier mit
mit-0 | spdx license identifier | 0.99 | spdx license identifier mit 0
x11 | spdx license identifier | 0.99 | spdx license identifier x11
isc | spdx license identifier | 0.99 | spdx license identifier isc
zlib | spdx license identifier | 0.99 | spdx license identifier zlib
wtfpl | spdx license identifier | 0.99 | spdx license identifier wtfpl
unlicense | spdx license identifier | 0.99 | spdx license identifier unlicense
apache-1.1 | spdx license identifier | 0.99 | spdx license identifier apache 1 1
apache-2.0 | spdx license identifier | 0.99 | spdx license identifier apache 2 0
gpl-1.0 | spdx license identifier | 0.99 | spdx license identifier gpl 1 0
gpl-2.0 | spdx license identifier | 0.99 | spdx license identifier gpl 2 0(?: only| or later)?
gpl-3.0 | spdx license identifier | 0.99 | spdx license identifier gpl 3 0(?: only| or later)?
lgpl-2.0 | spdx license identifier | 0.99 | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 | spdx license identifier | 0.99 | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 | spdx license identifier | 0.99 | spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3.0 | spdx license identifier | 0.99 | spdx license identifier agpl 3 0(?: only| or later)?
gfdl-1.3 | spdx license identifier | 0.99 | spdx license identifier gfdl 1 3(?: only| or later)?
bsd-0-clause | spdx license identifier | 0.99 | spdx license identifier 0bsd
bsd-2-clause | spdx license identifier | 0.99 | spdx license identifier bsd 2 clause
bsd-3-clause | spdx license identifier | 0.99 | spdx license identifier bsd 3 clause
bsd-4-clause | spdx license identifier | 0.99 | spdx license identifier bsd 4 clause
mpl-1.1 | spdx license identifier | 0.99 | spdx license identifier mpl 1 1
mpl-2.0 | spdx license identifier | 0.99 | spdx license identifier mpl 2 0
epl-1.0 | spdx license identifier | 0.99 | spdx license identifier epl 1 0
epl-2.0 | spdx license identifier | 0.99 | spdx license identifier epl 2 0
cddl-1.0 | spdx license identifier | 0.99 | spdx license identifier cddl 1 0
eupl-1.2 | spdx license identifier | 0.99 | spdx license identifier eupl 1 2
bsl-1.0 | spdx license identifier | 0.99 | spdx license identifier bsl 1 0
ofl-1.1 | spdx license identifier | 0.99 | spdx license identifier ofl 1 1
artistic-2.0 | spdx license identifier | 0.99 | spdx license identifier artistic 2 0
cc0-1.0 | spdx license identifier | 0.99 | spdx license identifier cc0 1 0
cc-by-4.0 | spdx license identifier | 0.99 | spdx license identifier cc by 4 0
cc-by-sa-4.0 | spdx license identifier | 0.99 | spdx license identifier cc by sa 4 0
mit | mit license | 0.97 | opensource org licenses mit(?: license)?|choosealicense com licenses mit(?: license)?
apache-2.0 | licenses apache 2 0 | 0.97 | (?:opensource org|choosealicense com) licenses apache 2 0
gpl-2.0 | gnu org licenses | 0.95 | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 | gnu org licenses | 0.95 | gnu org licenses gpl 3 0
lgpl-2.1 | gnu org licenses | 0.95 | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 | gnu org licenses | 0.95 | gnu org licenses lgpl 3 0
agpl-3.0 | gnu org licenses | 0.95 | gnu org licenses agpl 3 0
mpl-2.0 | mozilla org mpl | 0.97 | mozilla org mpl 2 0
bsl-1.0 | boost org license | 0.97 | boost org license 1 0 txt
cc-by-4.0 | creativecommons org licenses by | 0.97 | creativecommons org licenses by 4 0
cc-by-3.0 | creativecommons org licenses by | 0.97 | creativecommons org licenses by 3 0
cc-by-2.0 | creativecommons org licenses by | 0.97 | creativecommons org licenses by 2 0
cc-by-sa-4.0 | creativecommons org licenses by sa | 0.97 | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | creativecommons org licenses by sa | 0.97 | creativecommons org licenses by sa 3 0
cc-by-sa-2.0 | creativecommons org licenses by sa | 0.97 | creativecommons org licenses by sa 2 0
cc-by-nc-4.0 | creativecommons org licenses by nc | 0.97 | creativecommons org licenses by nc 4 0
cc-by-nc-3.0 | creativecommons org licenses by nc | 0.97 | creativecommons org licenses by nc 3 0
cc-by-nc-sa-4.0 | creativecommons org licenses by nc sa | 0.97 | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3.0 | creativecommons org licenses by nc sa | 0.97 | creativecommons org licenses by nc sa 3 0
cc-by-nc-nd-4.0 | creativecommons org licenses by nc nd | 0.97 | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-3.0 | creativecommons org licenses by nc nd | 0.97 | creativecommons org licenses by nc nd 3 0
cc-by-nd-4.0 | creativecommons org licenses by nd | 0.97 | creativecommons org licenses by nd 4 0
cc0-1.0 | creativecommons org publicdomain zero | 0.97 | creativecommons org publicdomain zero 1 0
pddl-1.0 | opendatacommons org licenses pddl | 0.97 | opendatacommons org licenses pddl(?: 1 0)?
odbl-1.0 | opendatacommons org licenses odbl | 0.97 | opendatacommons org licenses odbl(?: 1 0)?
odc-by-1.0 | opendatacommons org licenses by | 0.97 | opendatacommons org licenses by(?: 1 0)?
""",
    6: r"""
apache-2.0 | apache | 0.95 | apache(?: software)? licen[cs]e,? (?:version |ver |v ?)?2(?: 0)?
apache-2.0 | apache | 0.9 | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?apache (?:version |v ?)?2(?: 0)?(?: licen[cs]e)?
apache-2.0 | asl 2 0 | 0.8 | (?:licensed|released|distributed) under (?:the )?asl 2 0
apache-1.1 | apache | 0.9 | apache(?: software)? licen[cs]e (?:version |v ?)?1 1
apache-1.0 | apache | 0.9 | apache(?: software)? licen[cs]e (?:version |v ?)?1 0
gpl-1.0 | general public | 0.9 | (?:gnu )?general public licen[cs]e (?:version |v ?)?1(?: 0)?
gpl-2.0 | general public | 0.95 | (?:gnu )?general public licen[cs]e (?:version |v ?)?2(?: 0)?(?: only| or later)?
gpl-3.0 | general public | 0.95 | (?:gnu )?general public licen[cs]e (?:version |v ?)?3(?: 0)?(?: only| or later)?
gpl-2.0 | gplv2 | 0.9 | (?:gnu )?gplv2(?: only| or later)?
gpl-3.0 | gplv3 | 0.9 | (?:gnu )?gplv3(?: only| or later)?
gpl-2.0 | gpl | 0.9 | (?:gnu )?gpl (?:version |v ?)2(?: 0)?(?: only| or later)?
gpl-3.0 | gpl | 0.9 | (?:gnu )?gpl (?:version |v ?)3(?: 0)?(?: only| or later)?
gpl-2.0 | gpl | 0.8 | gpl 2(?: 0)?(?: only| or later)?
gpl-3.0 | gpl | 0.8 | gpl 3(?: 0)?(?: only| or later)?
gpl-2.0 | of the license or at your option | 0.8 | either version 2 of the license or at your option any later version
gpl-3.0 | of the license or at your option | 0.8 | either version 3 of the license or at your option any later version
lgpl-2.0 | library general public | 0.95 | (?:gnu )?library general public licen[cs]e (?:version |v ?)?2(?: 0)?
lgpl-2.1 | lesser general public | 0.95 | (?:gnu )?lesser general public licen[cs]e (?:version |v ?)?2 1
lgpl-3.0 | lesser general public | 0.95 | (?:gnu )?lesser general public licen[cs]e (?:version |v ?)?3(?: 0)?
lgpl-2.1 | lgplv2 1 | 0.9 | (?:gnu )?lgplv2 1
lgpl-3.0 | lgplv3 | 0.9 | (?:gnu )?lgplv3
lgpl-2.1 | lgpl | 0.9 | (?:gnu )?lgpl (?:version |v ?)?2 1
lgpl-3.0 | lgpl | 0.9 | (?:gnu )?lgpl (?:version |v ?)?3(?: 0)?
agpl-3.0 | affero general public | 0.95 | (?:gnu )?affero general public licen[cs]e (?:version |v ?)?3(?: 0)?
agpl-3.0 | agplv3 | 0.9 | (?:gnu )?agplv3
agpl-3.0 | agpl | 0.9 | (?:gnu )?agpl (?:version |v ?)?3(?: 0)?
gfdl-1.2 | free documentation | 0.9 | (?:gnu )?free documentation licen[cs]e (?:version |v ?)?1 2
gfdl-1.3 | free documentation | 0.9 | (?:gnu )?free documentation licen[cs]e (?:version |v ?)?1 3
mpl-1.0 | mozilla public | 0.9 | mozilla public licen[cs]e (?:version |v ?)?1 0
mpl-1.1 | mozilla public | 0.9 | mozilla public licen[cs]e (?:version |v ?)?1 1
mpl-2.0 | mozilla public | 0.95 | mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?(?: licen[cs]e)?
mpl-1.1 | mpl | 0.8 | mpl (?:version |v ?)?1 1
mpl-2.0 | mpl | 0.8 | mpl (?:version |v ?)?2(?: 0)?
mpl-2.0 | mplv2 | 0.85 | mplv2(?: 0)?
epl-1.0 | eclipse public | 0.9 | eclipse public licen[cs]e (?:version |v ?)?1(?: 0)?
epl-2.0 | eclipse public | 0.9 | eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?
edl-1.0 | eclipse distribution | 0.9 | eclipse distribution licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?
eupl-1.1 | european union public | 0.9 | european union public licen[cs]e (?:version |v ?)?1 1
eupl-1.2 | european union public | 0.9 | european union public licen[cs]e (?:version |v ?)?1 2
cpl-1.0 | common public | 0.9 | common public licen[cs]e (?:version |v ?)?1(?: 0)?
cpal-1.0 | common public attribution | 0.9 | common public attribution licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?
cddl-1.1 | common development and distribution | 0.9 | common development and distribution licen[cs]e (?:version |v ?)?1 1
cddl-1.0 | cddl | 0.85 | cddl (?:version |v ?)?1(?: 0)?
artistic-1.0 | artistic | 0.85 | artistic licen[cs]e (?:version |v ?)?1(?: 0)?
artistic-2.0 | artistic | 0.9 | artistic licen[cs]e (?:version |v ?)?2(?: 0)?
bsl-1.0 | boost software | 0.9 | boost software licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?
busl-1.1 | business source | 0.9 | business source licen[cs]e(?: (?:version |v ?)?1 1)?
sspl-1.0 | server side public | 0.9 | server side public licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?
elastic-2.0 | elastic license | 0.9 | elastic licen[cs]e (?:version |v ?)?2(?: 0)?
polyform-nc-1.0 | polyform noncommercial | 0.9 | polyform noncommercial licen[cs]e(?: 1 0 0)?
osl-3.0 | open software | 0.9 | open software licen[cs]e (?:version |v ?)?3(?: 0)?
afl-3.0 | academic free | 0.9 | academic free licen[cs]e (?:version |v ?)?3(?: 0)?
upl-1.0 | universal permissive | 0.9 | universal permissive licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?
ncsa | illinois | 0.85 | university of illinois (?:ncsa )?open source licen[cs]e
vim | vim license | 0.85 | vim licen[cs]e
ruby | ruby license | 0.8 | ruby licen[cs]e
php-3.01 | php license | 0.9 | php licen[cs]e (?:version |v ?)?3 01
zpl-2.1 | zope public | 0.9 | zope public licen[cs]e(?: (?:version |v ?)?2 1)?
ecl-2.0 | educational community | 0.9 | educational community licen[cs]e (?:version |v ?)?2(?: 0)?
ofl-1.1 | open font | 0.9 | (?:sil )?open font licen[cs]e(?: (?:version |v ?)?1 1)?
bsd-0-clause | bsd | 0.9 | (?:bsd zero clause|zero clause bsd|bsd 0 clause|0 clause bsd)(?: licen[cs]e)?
bsd-0-clause | 0bsd | 0.9 | 0bsd(?: licen[cs]e)?
bsd-2-clause | bsd | 0.9 | (?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd)(?: licen[cs]e)?
bsd-2-clause | freebsd | 0.8 | (?:the )?freebsd licen[cs]e
bsd-3-clause | bsd | 0.9 | (?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
bsd-4-clause | bsd | 0.9 | (?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: licen[cs]e)?
mit | mit | 0.9 | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit(?: x11)?(?: licen[cs]e)?
mit | expat | 0.85 | (?:the )?expat licen[cs]e
x11 | x11 license | 0.85 | (?:the )?x11 licen[cs]e
isc | isc licen | 0.9 | (?:the )?isc licen[cs]e
zlib | zlib | 0.85 | zlib(?: libpng)? licen[cs]e
unlicense | unlicense | 0.9 | (?:licensed|released|distributed|available) under (?:the )?unlicense
wtfpl | wtfpl | 0.9 | wtfpl
cc0-1.0 | cc0 | 0.9 | cc0(?: 1 0)?(?: universal)?(?: licen[cs]e)?
cc-by-4.0 | cc by 4 0 | 0.95 | cc by 4 0
cc-by-3.0 | cc by 3 0 | 0.95 | cc by 3 0
cc-by-2.0 | cc by 2 0 | 0.95 | cc by 2 0
cc-by-sa-4.0 | cc by sa 4 0 | 0.95 | cc by sa 4 0
cc-by-sa-3.0 | cc by sa 3 0 | 0.95 | cc by sa 3 0
cc-by-nc-4.0 | cc by nc 4 0 | 0.95 | cc by nc 4 0
cc-by-nc-3.0 | cc by nc 3 0 | 0.95 | cc by nc 3 0
cc-by-nd-4.0 | cc by nd 4 0 | 0.95 | cc by nd 4 0
cc-by-nc-sa-4.0 | cc by nc sa 4 0 | 0.95 | cc by nc sa 4 0
cc-by-nc-sa-3.0 | cc by nc sa 3 0 | 0.95 | cc by nc sa 3 0
cc-by-nc-nd-4.0 | cc by nc nd 4 0 | 0.95 | cc by nc nd 4 0
cc-by-4.0 | creative commons attribution | 0.9 | creative commons attribution (?:licen[cs]e )?(?:version |v ?)?4 0(?: international)?
cc-by-3.0 | creative commons attribution | 0.9 | creative commons attribution (?:licen[cs]e )?(?:version |v ?)?3 0(?: unported)?
cc-by-sa-4.0 | creative commons attribution | 0.9 | creative commons attribution share ?alike (?:licen[cs]e )?(?:version |v ?)?4 0(?: international)?
cc-by-sa-3.0 | creative commons attribution | 0.9 | creative commons attribution share ?alike (?:licen[cs]e )?(?:version |v ?)?3 0(?: unported)?
cc-by-nc-4.0 | creative commons attribution | 0.9 | creative commons attribution non ?commercial (?:licen[cs]e )?(?:version |v ?)?4 0(?: international)?
cc-by-nd-4.0 | creative commons attribution | 0.9 | creative commons attribution no ?derivatives (?:licen[cs]e )?(?:version |v ?)?4 0(?: international)?
cc-by-nc-sa-4.0 | creative commons attribution | 0.9 | creative commons attribution non ?commercial share ?alike (?:licen[cs]e )?(?:version |v ?)?4 0(?: international)?
cc-by-nc-nd-4.0 | creative commons attribution | 0.9 | creative commons attribution non ?commercial no ?derivatives (?:licen[cs]e )?(?:version |v ?)?4 0(?: international)?
odbl-1.0 | open database | 0.9 | open (?:data commons )?(?:open )?database licen[cs]e(?: (?:version |v ?)?1 0)?
odc-by-1.0 | open data commons attribution | 0.9 | open data commons attribution licen[cs]e(?: (?:version |v ?)?1 0)?
cdla-permissive-2.0 | community data license | 0.9 | community data license agreement permissive (?:version |v ?)?2 0
""",
    3: r"""
mit | mit licen | 0.6 | (?:the )?mit(?: x11)? licen[cs]e
bsd | bsd licen | 0.6 | (?:the )?bsd(?: style)? licen[cs]e
cc | creative commons licen | 0.5 | (?:a |the )?creative commons licen[cs]e
lgpl | lesser general public | 0.6 | (?:gnu )?lesser general public licen[cs]e
agpl | affero general public | 0.6 | (?:gnu )?affero general public licen[cs]e
gfdl | free documentation | 0.6 | (?:gnu )?free documentation licen[cs]e
mpl | mozilla public | 0.6 | mozilla public licen[cs]e
epl | eclipse public | 0.6 | eclipse public licen[cs]e
cddl | common development and distribution | 0.6 | common development and distribution licen[cs]e
eupl | european union public | 0.6 | european union public licen[cs]e
artistic | artistic licen | 0.5 | (?:the )?artistic licen[cs]e
public-domain | public domain | 0.8 | (?:released|dedicated|placed|donated) (?:in ?to|to|in) the public domain
public-domain | public domain | 0.5 | (?:is|are) in the public domain
proprietary | all rights reserved | 0.4 | (?:copyright (?:c )?\S+(?: \S+){0,6} )?all rights reserved
proprietary | confidential | 0.6 | proprietary and confidential|confidential and proprietary
proprietary | may not be reproduced | 0.5 | may not be reproduced (?:in any form )?without (?:the )?(?:prior )?(?:written )?permission
proprietary | end user license agreement | 0.6 | end user license agreement
""",
}


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    pattern: re.Pattern[bytes]
    priority: int
    weight: float


def rules() -> list[Rule]:
    """The signatures, of the highest priority first, in the order in which they are written."""
    found = []
    for priority, written in SIGNATURES.items():
        for line in written.strip().split("\n"):
            label, keyword, weight, pattern = (x.strip() for x in line.split(" | "))
            found.append(Rule(label, keyword.encode(), re.compile(rb" (?:" + pattern.encode() + rb")(?= )"), priority, float(weight)))
    return found


class Kept:
    """Intervals of which none contains another: sorted by start they are sorted by end as well."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """Whether the interval neither lies in one that is kept nor contains one; then it is kept too."""
        at = bisect_right(self.starts, start)  # of those that start no later the last reaches furthest
        if at and (self.ends[at - 1] >= end or self.starts[at - 1] == start):
            return False
        if at < len(self.ends) and self.ends[at] <= end:  # of those that start later the first ends first
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


class Scanner:
    def __init__(self) -> None:
        self.by_keyword: dict[bytes, list[tuple[int, Rule]]] = {}
        for n, rule in enumerate(rules()):
            self.by_keyword.setdefault(rule.keyword, []).append((n, rule))

    def finds(self, text: bytes) -> list[tuple[int, int, Rule]]:
        """The finds in normalised text (a space, words by single spaces, a space) that no other one suppresses.

        The strongest come first: of higher priority, then longer, then further in front, then written first.  A
        find that lies in a kept one, or contains one, is suppressed.
        """
        found = []
        for keyword, own in self.by_keyword.items():
            if keyword in text:
                found += [(-r.priority, m.start() - m.end(), m.start(), n, m.end(), r) for n, r in own for m in r.pattern.finditer(text)]
        held = Kept()
        kept = [(start, end, rule) for _, _, start, _, end, rule in sorted(found, key=lambda f: f[:4]) if held.add(start, end)]
        return sorted(kept, key=lambda f: f[:2])


def phrase_places(words: list[bytes], at: dict[bytes, list[int]]) -> list[tuple[int, str]]:
    """(first word, label) of each place where a phrase's words stand one after another; at: places of the last word 'license'."""
    found = []
    for phrase, label in PHRASES:
        n = len(phrase)
        for k in at.get(phrase[-1], ()):
            if k - n + 1 >= 0 and tuple(words[k - n + 1 : k + 1]) == phrase:
                found.append((k - n + 1, label))
    return found


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of letters and digits, A-Z lower-cased, and of characters beyond ASCII.  score is the
    probability that one of the finds is right, their weights taken as independent; without finds 0.  A null
    or empty text has no words.  Repeated rows, and rows without an id, are kept; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(batches):
        scanner = Scanner()

        def rows():
            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text")), strict=True):
                    words = text.translate(_TABLE).split()
                    normal = b" " + b" ".join(words) + b" "
                    base = phrase_places(words, {b"license": [i for i, w in enumerate(words) if w == b"license"]}) if b" license " in normal else []
                    finds = scanner.finds(normal)
                    doubt = 1.0
                    for weight in [0.6] * bool(base) + [r.weight for _, _, r in finds]:
                        doubt *= 1 - weight
                    own = {x for _, x in base}
                    yield doc, len(words), len(base), min((k for k, _ in base), default=None), max((k for k, _ in base), default=None), ",".join(sorted(own)), ",".join(sorted(own | {r.label for _, _, r in finds})), 1 - doubt

        return batched(rows(), schema)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
