"""Hand-written licence signatures, in order of priority.

A line is ``label | priority | keyword | expression``.  Expressions match texts whose words (lower-cased
letters, digits and non-ASCII) are joined by single blanks, at word ends only.  The keyword is a word that
each match holds; a text without it is never searched.  Smaller priorities win where detections overlap.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

SIGNATURES = r"""
mit | 10 | mit | permission is hereby granted free of charge to any person obtaining a copy of this software .{0,200}? the mit license
mit | 20 | mit | (?:released|licensed|distributed|available|published|provided) under the (?:terms of the )?mit license
mit | 20 | mit | under the mit license
mit | 30 | mit | (?:the )?mit licen[cs]e(?: mit)?
mit | 30 | mit | spdx license identifier mit
mit | 40 | mit | (?:license|licence|licensed under) mit
mit | 40 | mit | opensource org licenses mit(?: license(?: php)?)?
mit-0 | 15 | mit | (?:mit no attribution|mit 0)(?: license)?
mit | 60 | sublicense | use copy modify merge publish distribute sublicense and or sell copies of the software
mit | 60 | noninfringement | the software is provided as is without warranty of any kind express or implied .{0,120}? noninfringement
mit | 50 | expat | expat license
x11 | 30 | x11 | (?:the )?x11 license
x11 | 30 | consortium | x consortium license
apache-2 | 10 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | 20 | apache | (?:released|licensed|distributed|available) under the (?:terms of the )?apache license version 2(?: 0)?
apache-2 | 25 | apache | apache license version 2(?: 0)?
apache-2 | 25 | apache | apache (?:software )?licen[cs]e(?: v| ver)? ?2(?: 0)?
apache-2 | 30 | apache | spdx license identifier apache 2 0
apache-2 | 40 | apache | apache org licenses license 2 0(?: txt| html)?
apache-2 | 40 | apache | (?:license|licence) apache 2 0
apache-2 | 50 | apache | apache 2 0 license
apache-1.1 | 25 | apache | apache (?:software )?license (?:version |v)?1 1
apache-1.0 | 25 | apache | apache (?:software )?license (?:version |v)?1 0
apache | 70 | apache | (?:the )?apache licen[cs]e
bsd-3-clause | 15 | endorse | neither the name of .{0,120}? may be used to endorse or promote products derived from this software
bsd-3-clause | 20 | bsd | (?:3|three) clause bsd(?: license)?
bsd-3-clause | 20 | bsd | bsd (?:3|three) clause(?: license)?
bsd-3-clause | 25 | bsd | (?:new|modified|revised) bsd license
bsd-3-clause | 30 | bsd | spdx license identifier bsd 3 clause
bsd-2-clause | 20 | bsd | (?:2|two) clause bsd(?: license)?
bsd-2-clause | 20 | bsd | bsd (?:2|two) clause(?: license)?
bsd-2-clause | 25 | bsd | simplified bsd license
bsd-2-clause | 25 | freebsd | freebsd (?:copyright|license)
bsd-2-clause | 30 | bsd | spdx license identifier bsd 2 clause
bsd-4-clause | 20 | bsd | (?:4|four) clause bsd(?: license)?
bsd-4-clause | 20 | bsd | (?:bsd (?:4|four) clause|original bsd|old bsd)(?: license)?
bsd-4-clause | 30 | advertising | all advertising materials mentioning features or use of this software must display
0bsd | 15 | bsd | (?:zero clause bsd|bsd zero clause)(?: license)?
0bsd | 15 | 0bsd | (?:spdx license identifier )?0bsd(?: license)?
bsd | 60 | redistributions | redistributions of source code must retain the above copyright notice this list of conditions
bsd | 60 | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd | 60 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | 70 | bsd | (?:the |a )?bsd(?: style)? licen[cs]e
isc | 20 | isc | (?:the )?isc licen[cs]e
isc | 30 | isc | spdx license identifier isc
isc | 40 | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
gpl-3 | 10 | gnu | under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3(?: of the license)?
gpl-3 | 20 | gnu | gnu general public license (?:version|v) ?3(?: 0)?
gpl-3 | 20 | gplv3 | (?:gnu )?gplv3(?: license)?
gpl-3 | 25 | gpl | (?:gnu )?gpl (?:version |v)?3(?: 0)?(?: only| or later)?
gpl-3 | 30 | gpl | spdx license identifier gpl 3 0(?: only| or later)?
gpl-2 | 10 | gnu | under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2(?: of the license)?
gpl-2 | 20 | gnu | gnu general public license (?:version|v) ?2(?: 0)?
gpl-2 | 20 | gplv2 | (?:gnu )?gplv2(?: license)?
gpl-2 | 25 | gpl | (?:gnu )?gpl (?:version |v)?2(?: 0)?(?: only| or later)?
gpl-2 | 30 | gpl | spdx license identifier gpl 2 0(?: only| or later)?
gpl-1 | 25 | gpl | (?:gnu )?gpl (?:version |v)?1(?: 0)?(?: only| or later)?
gpl-2-classpath | 15 | classpath | gpl 2 0(?: only)? with classpath exception(?: 2 0)?
gpl-2-classpath | 20 | classpath | classpath exception
gpl | 70 | gnu | (?:the )?gnu general public license
gpl | 75 | gpl | (?:the )?gnu gpl
gpl | 80 | gpl | (?:under|license|licence) (?:the )?gpl
gpl | 70 | redistribute | this program is free software you can redistribute it and or modify it
lgpl-3 | 20 | gnu | gnu lesser general public license (?:version|v) ?3(?: 0)?
lgpl-3 | 20 | lgplv3 | (?:gnu )?lgplv3(?: license)?
lgpl-3 | 25 | lgpl | (?:gnu )?lgpl (?:version |v)?3(?: 0)?(?: only| or later)?
lgpl-2.1 | 20 | gnu | gnu lesser general public license (?:version|v) ?2 1
lgpl-2.1 | 25 | lgpl | (?:gnu )?lgpl (?:version |v)?2 1(?: only| or later)?
lgpl-2 | 20 | gnu | gnu library general public license(?: (?:version|v) ?2(?: 0)?)?
lgpl-2 | 25 | lgpl | (?:gnu )?lgpl (?:version |v)?2(?: 0)?(?: only| or later)?
lgpl | 65 | gnu | gnu lesser general public license
lgpl | 75 | lgpl | (?:gnu |the )?lgpl(?: license)?
agpl-3 | 20 | affero | gnu affero general public license(?: (?:version|v) ?3(?: 0)?)?
agpl-3 | 20 | agplv3 | (?:gnu )?agplv3(?: license)?
agpl-3 | 25 | agpl | (?:gnu )?agpl (?:version |v)?3(?: 0)?(?: only| or later)?
agpl-1 | 25 | affero | affero general public license (?:version |v)?1(?: 0)?
agpl | 75 | agpl | (?:gnu |the )?agpl(?: license)?
gfdl-1.3 | 20 | gnu | gnu free documentation license (?:version |v)?1 3
gfdl-1.2 | 20 | gnu | gnu free documentation license (?:version |v)?1 2
gfdl | 60 | gnu | gnu free documentation license
gfdl | 75 | gfdl | gfdl(?: 1 [123])?
mpl-2 | 10 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 | 20 | mozilla | mozilla public license (?:version|v) ?2(?: 0)?
mpl-2 | 25 | mpl | mpl (?:version |v)?2(?: 0)?
mpl-1.1 | 20 | mozilla | mozilla public license (?:version|v) ?1 1
mpl-1.1 | 25 | mpl | mpl (?:version |v)?1 1
mpl-1.0 | 20 | mozilla | mozilla public license (?:version|v) ?1 0
mpl | 65 | mozilla | mozilla public license
epl-2 | 20 | eclipse | eclipse public license (?:version |v)?2(?: 0)?
epl-2 | 25 | epl | epl (?:version |v)?2(?: 0)?
epl-1 | 20 | eclipse | eclipse public license (?:version |v)?1(?: 0)?
epl-1 | 25 | epl | epl (?:version |v)?1(?: 0)?
epl | 65 | eclipse | eclipse public license
edl-1 | 20 | eclipse | eclipse distribution license(?: (?:version |v)?1 0)?
cddl-1.1 | 20 | cddl | cddl (?:version |v)?1 1
cddl-1.0 | 20 | cddl | cddl (?:version |v)?1(?: 0)?
cddl | 65 | cddl | cddl(?: license)?
cddl | 60 | common | common development and distribution license(?: (?:version |v)?1 [01])?
cpl-1 | 60 | common | common public license(?: (?:version |v)?1 0)?
cpal-1 | 60 | attribution | common public attribution license(?: (?:version |v)?1 0)?
apsl-2 | 60 | apple | apple public source license(?: (?:version |v)?2 0)?
artistic-2 | 20 | artistic | artistic license (?:version |v)?2(?: 0)?
artistic-1 | 20 | artistic | artistic license (?:version |v)?1(?: 0)?
artistic | 65 | artistic | (?:the )?(?:perl )?artistic license
perl | 60 | perl | (?:under )?the same terms as perl(?: itself)?
bsl-1 | 20 | boost | boost software license(?: (?:version |v)?1 0)?
bsl-1 | 30 | boost | boost org license 1 0 txt
busl-1.1 | 20 | business | business source license(?: (?:version |v)?1 1)?
busl-1.1 | 30 | busl | busl 1 1
sspl-1 | 20 | server | server side public license(?: (?:version |v)?1)?
sspl-1 | 30 | sspl | sspl(?: (?:version |v)?1(?: 0)?)?
elastic-2 | 20 | elastic | elastic license(?: (?:version |v)?2(?: 0)?)?
polyform-noncommercial | 20 | polyform | polyform noncommercial license(?: 1 0 0)?
polyform-small-business | 20 | polyform | polyform small business license(?: 1 0 0)?
polyform | 60 | polyform | polyform [a-z]+ license
commons-clause | 20 | commons | commons clause(?: license condition)?(?: (?:version |v)?1 0)?
unlicense | 10 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 20 | unlicense | (?:the |spdx license identifier )?unlicense
unlicense | 30 | unlicense | unlicense org
wtfpl | 20 | wtfpl | (?:the |spdx license identifier )?wtfpl(?: (?:version |v)?2)?
wtfpl | 20 | want | do what the fuck you want to public license
zlib | 20 | zlib | (?:the )?zlib(?: libpng)? license
zlib | 30 | zlib | spdx license identifier zlib
zlib | 60 | misrepresented | the origin of this software must not be misrepresented
libpng | 25 | libpng | (?:the )?libpng license
openssl | 20 | openssl | openssl(?: ssleay)? license
openssl | 60 | openssl | this product includes software developed by the openssl project
curl | 30 | curl | (?:the )?curl license
python-2 | 20 | psf | psf license(?: (?:version |v)?2)?
python-2 | 20 | python | python software foundation license(?: agreement)?
python-2 | 30 | python | python license 2 0
ruby | 30 | ruby | (?:the )?ruby license
php-3.01 | 20 | php | php license (?:version |v)?3(?: 0)?1
php | 60 | php | (?:the )?php license
postgresql | 20 | postgresql | (?:the )?postgresql licen[cs]e
tcl | 30 | tcl | tcl tk license
vim | 30 | vim | (?:the )?vim license
w3c | 30 | w3c | w3c software(?: and document)?(?: notice and)? license
ofl-1.1 | 20 | ofl | (?:sil )?ofl (?:version |v)?1 1
ofl-1.1 | 20 | sil | sil open font license(?: (?:version |v)?1 1)?
ofl | 60 | font | open font license
ufl-1 | 60 | ubuntu | ubuntu font licen[cs]e(?: (?:version |v)?1 0)?
ms-pl | 20 | microsoft | microsoft public license
ms-rl | 20 | microsoft | microsoft reciprocal license
ms-eula | 60 | microsoft | microsoft software license terms
eupl-1.2 | 20 | eupl | eupl (?:version |v)?1 2
eupl-1.1 | 20 | eupl | eupl (?:version |v)?1 1
eupl | 60 | european | european union public licen[cs]e(?: (?:version |v)?1 [12])?
cecill-2.1 | 20 | cecill | cecill (?:version |v)?2 1
cecill-c | 20 | cecill | cecill c
cecill-b | 20 | cecill | cecill b
cecill | 65 | cecill | cecill(?: licen[cs]e)?
osl-3 | 20 | osl | osl (?:version |v)?3(?: 0)?
osl-3 | 20 | open | open software license(?: (?:version |v)?3 0)?
afl-3 | 20 | academic | academic free license(?: (?:version |v)?3 0)?
afl-3 | 30 | afl | afl (?:version |v)?3(?: 0)?
ecl-2 | 30 | educational | educational community license(?: (?:version |v)?2 0)?
ncsa | 30 | ncsa | (?:university of illinois )?(?:uiuc )?ncsa(?: open source)? license
upl-1 | 30 | upl | upl 1 0
upl-1 | 30 | universal | universal permissive license(?: (?:version |v)?1 0)?
unicode | 30 | unicode | unicode license agreement
blueoak-1 | 30 | oak | blue oak model license(?: 1 0 0)?
mulan-psl-2 | 30 | mulan | mulan (?:permissive software license|psl)(?: (?:version |v)?2)?
hpnd | 30 | hpnd | hpnd(?: license)?
hpnd | 40 | historical | historical permission notice and disclaimer
json | 40 | evil | the software shall be used for good not evil
beerware | 30 | beerware | (?:the )?beerware license
beerware | 30 | beer | the beer ware license
sleepycat | 30 | sleepycat | sleepycat(?: public)? license
ipl-1 | 30 | ibm | ibm public license(?: (?:version |v)?1 0)?
qpl-1 | 30 | q | q public license(?: (?:version |v)?1 0)?
npl-1.1 | 30 | netscape | netscape public license(?: (?:version |v)?1 [01])?
spl-1 | 30 | sun | sun public license(?: (?:version |v)?1 0)?
rpl-1.5 | 30 | reciprocal | reciprocal public license(?: 1 5)?
lppl-1.3c | 30 | latex | latex project public license(?: (?:version |v)?1 3c?)?
lppl-1.3c | 40 | lppl | lppl(?: (?:version |v)?1 3c?)?
intel | 40 | intel | intel simplified software license
nvidia | 40 | nvidia | nvidia (?:software|source code) license(?: agreement)?
openrail | 30 | openrail | (?:bigscience |creativeml )?(?:bigcode )?openrail(?: m| s)?(?: license)?
openrail | 30 | rail | (?:bigscience|bigcode|creativeml) (?:open )?rail(?: m)?(?: license)?
llama-2 | 30 | llama | llama 2 community license(?: agreement)?
llama-3 | 30 | llama | llama 3(?: [0-9])? community license(?: agreement)?
gemma | 30 | gemma | gemma terms of use
cc-by-nc-nd | 10 | nd | (?:cc|creative commons) by nc nd(?: [1-4](?: 0)?)?
cc-by-nc-nd | 12 | noderivatives | creative commons attribution noncommercial noderivatives(?: [1-4] 0)?
cc-by-nc-nd | 12 | noderivs | creative commons attribution noncommercial noderivs(?: [1-4] 0)?
cc-by-nc-sa | 10 | sa | (?:cc|creative commons) by nc sa(?: [1-4](?: 0)?)?
cc-by-nc-sa | 12 | creative | creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?
cc-by-nc | 20 | nc | (?:cc|creative commons) by nc(?: [1-4](?: 0)?)?
cc-by-nc | 22 | noncommercial | creative commons attribution noncommercial(?: [1-4] 0)?
cc-by-nc | 22 | commercial | creative commons attribution non commercial(?: [1-4] 0)?
cc-by-nd | 20 | nd | (?:cc|creative commons) by nd(?: [1-4](?: 0)?)?
cc-by-nd | 22 | noderivatives | creative commons attribution noderivatives(?: [1-4] 0)?
cc-by-nd | 22 | derivatives | creative commons attribution no derivatives(?: [1-4] 0)?
cc-by-sa | 20 | sa | (?:cc|creative commons) by sa(?: [1-4](?: 0)?)?
cc-by-sa | 22 | sharealike | creative commons attribution sharealike(?: [1-4] 0)?
cc-by-sa | 22 | alike | creative commons attribution share alike(?: [1-4] 0)?
cc-by | 40 | cc | cc by(?: [1-4](?: 0)?)?
cc-by | 42 | creative | creative commons attribution(?: (?:international )?(?:public )?license)?(?: [1-4] 0)?
cc0 | 20 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0 | 22 | creative | creative commons (?:zero|public domain dedication)
cc | 80 | creativecommons | creativecommons org licenses [a-z]{2}(?: [a-z]{2}){0,2}(?: [1-4] 0)?
cc | 90 | creative | creative commons(?: licen[cs]e)?
cc-sampling | 30 | sampling | creative commons sampling(?: plus)?(?: 1 0)?
odbl-1 | 30 | odbl | odbl(?: (?:version |v)?1 0)?
odbl-1 | 30 | database | open database license(?: (?:version |v)?1 0)?
odc-by-1 | 30 | data | open data commons attribution license(?: (?:version |v)?1 0)?
odc-by-1 | 30 | odc | odc by(?: 1 0)?
pddl-1 | 30 | pddl | pddl(?: 1 0)?
pddl-1 | 30 | dedication | (?:open data commons )?public domain dedication and license
cdla-permissive | 30 | cdla | cdla permissive(?: [12] 0)?
cdla-sharing | 30 | cdla | cdla sharing(?: 1 0)?
ogl-3 | 30 | government | open government licen[cs]e(?: (?:version |v)?[123] 0)?
etalab-2 | 30 | etalab | (?:licence ouverte )?(?:open licence )?etalab(?: 2 0)?
dl-de-by-2 | 30 | deutschland | datenlizenz deutschland (?:namensnennung|zero)(?: (?:version )?2 0)?
free-art | 30 | art | (?:free art license|licence art libre)(?: 1 3)?
public-domain | 60 | domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | 70 | domain | (?:this work |it )?is in the public domain
proprietary | 60 | proprietary | proprietary and confidential
proprietary | 60 | unauthorized | unauthorized copying of this file via any medium is strictly prohibited
proprietary | 70 | reserved | all rights reserved(?: worldwide)?
copyright | 90 | copyright | copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)?[0-9]{2})?
spdx | 95 | spdx | spdx license identifier [a-z0-9]+
eula | 60 | eula | end user license agreement eula
eula | 65 | user | end user license agreement
"""


@dataclass(frozen=True)
class Signature:
    label: str
    priority: int
    keyword: str
    pattern: re.Pattern[str]


def signatures(text: str = SIGNATURES) -> list[Signature]:
    """Parse signature lines; each keyword must be a plain word of its expression."""
    out = []
    for line in text.strip().splitlines():
        label, priority, keyword, expression = (p.strip() for p in line.split(" | ", 3))
        out.append(Signature(label, int(priority), keyword, re.compile(rf"(?<![^ ])(?:{expression})(?![^ ])")))
    return out
