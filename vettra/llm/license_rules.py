"""Signature rules for licence scans, by kind, kinds in order of priority.

One rule a line: label, keyword, pattern. Patterns are regular expressions over words in lower case with one space
between them ("CC BY-NC 4.0" reads "cc by nc 4 0"), matched at word limits. ``@`` stands for an optional "version" or
"v". The keyword is a piece of text without which the pattern cannot match; a document is tried against a rule only if
it holds the keyword.
"""

from __future__ import annotations

VERSION = "(?:version |ver |v )?v?"

# kind -> how sure a detection of that kind is
KINDS = {"tag": 1.0, "notice": 0.95, "text": 0.9, "url": 0.9, "name": 0.8, "hint": 0.4}

TAG = """
apache-2.0; spdx; spdx license identifier apache 2 0
apache-1.1; spdx; spdx license identifier apache 1 1
mit; spdx; spdx license identifier mit(?! 0)
mit-0; spdx; spdx license identifier mit 0
isc; spdx; spdx license identifier isc
0bsd; spdx; spdx license identifier 0bsd
bsd-2-clause; spdx; spdx license identifier bsd 2 clause
bsd-3-clause; spdx; spdx license identifier bsd 3 clause
bsd-4-clause; spdx; spdx license identifier bsd 4 clause
gpl-1.0; spdx; spdx license identifier gpl 1 0(?: only| or later)?
gpl-2.0; spdx; spdx license identifier gpl 2 0(?: only)?(?! or later)
gpl-2.0-or-later; spdx; spdx license identifier gpl 2 0 or later
gpl-3.0; spdx; spdx license identifier gpl 3 0(?: only)?(?! or later)
gpl-3.0-or-later; spdx; spdx license identifier gpl 3 0 or later
lgpl-2.1; spdx; spdx license identifier lgpl 2 1(?: only)?(?! or later)
lgpl-2.1-or-later; spdx; spdx license identifier lgpl 2 1 or later
lgpl-3.0; spdx; spdx license identifier lgpl 3 0(?: only)?(?! or later)
lgpl-3.0-or-later; spdx; spdx license identifier lgpl 3 0 or later
agpl-3.0; spdx; spdx license identifier agpl 3 0(?: only)?(?! or later)
agpl-3.0-or-later; spdx; spdx license identifier agpl 3 0 or later
mpl-1.1; spdx; spdx license identifier mpl 1 1
mpl-2.0; spdx; spdx license identifier mpl 2 0
epl-1.0; spdx; spdx license identifier epl 1 0
epl-2.0; spdx; spdx license identifier epl 2 0
cddl-1.0; spdx; spdx license identifier cddl 1 0
eupl-1.2; spdx; spdx license identifier eupl 1 2
unlicense; spdx; spdx license identifier unlicense
zlib; spdx; spdx license identifier zlib
bsl-1.0; spdx; spdx license identifier bsl 1 0
busl-1.1; spdx; spdx license identifier busl 1 1
wtfpl; spdx; spdx license identifier wtfpl
artistic-2.0; spdx; spdx license identifier artistic 2 0
ofl-1.1; spdx; spdx license identifier ofl 1 1
psf-2.0; spdx; spdx license identifier (?:psf|python) 2 0
postgresql; spdx; spdx license identifier postgresql
ncsa; spdx; spdx license identifier ncsa
cc0-1.0; spdx; spdx license identifier cc0 1 0
cc-by-3.0; spdx; spdx license identifier cc by 3 0
cc-by-4.0; spdx; spdx license identifier cc by 4 0
cc-by-sa-3.0; spdx; spdx license identifier cc by sa 3 0
cc-by-sa-4.0; spdx; spdx license identifier cc by sa 4 0
cc-by-nc-4.0; spdx; spdx license identifier cc by nc 4 0
cc-by-nd-4.0; spdx; spdx license identifier cc by nd 4 0
cc-by-nc-sa-4.0; spdx; spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0; spdx; spdx license identifier cc by nc nd 4 0
"""

NOTICE = """
apache-2.0; apache license; licensed under (?:the )?apache license @2(?: 0)?(?: the license)?
apache-2.0; apache; (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache (?:software )?(?:license )?@2(?: 0)?(?: license)?
apache-1.1; apache software license; the apache software license @1 1
mit; mit license; (?:licensed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?mit license
mit; mit; (?:licensed|released|distributed) under mit
mit; expat license; (?:licensed|released|distributed) under (?:the )?expat license
isc; isc license; (?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?isc license
bsd-2-clause; bsd; (?:licensed|released|distributed|available) under (?:the |a )?(?:2|two) clause bsd(?: license)?
bsd-2-clause; simplified bsd; (?:licensed|released|distributed|available) under (?:the |a )?simplified bsd license
bsd-3-clause; bsd; (?:licensed|released|distributed|available) under (?:the |a )?(?:3|three) clause bsd(?: license)?
bsd-3-clause; bsd license; (?:licensed|released|distributed|available) under (?:the |a )?(?:new|modified|revised) bsd license
bsd; bsd; (?:licensed|released|distributed|available) under (?:the |a )?bsd(?: style)? license
gpl-1.0; gnu general public license; gnu general public license (?:as published by the free software foundation )?(?:either )?@1(?! \\d)
gpl-2.0; gnu general public license; gnu general public license (?:as published by the free software foundation )?@2(?: 0)?(?: only)?
gpl-2.0-or-later; gnu general public license; gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
gpl-2.0-or-later; gnu general public license; gnu general public license @2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl-3.0; gnu general public license; gnu general public license (?:as published by the free software foundation )?@3(?: 0)?(?: only)?
gpl-3.0-or-later; gnu general public license; gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
gpl-3.0-or-later; gnu general public license; gnu general public license @3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
lgpl-2.0; gnu library general public license; gnu library general public license (?:as published by the free software foundation )?(?:either )?@2(?: 0)?
lgpl-2.1; gnu lesser general public license; gnu lesser general public license (?:as published by the free software foundation )?@2 1(?: only)?
lgpl-2.1-or-later; gnu lesser general public license; gnu lesser general public license as published by the free software foundation either version 2 1 of the license or (?:at your option )?any later version
lgpl-3.0; gnu lesser general public license; gnu lesser general public license (?:as published by the free software foundation )?@3(?: 0)?(?: only)?
lgpl-3.0-or-later; gnu lesser general public license; gnu lesser general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
agpl-3.0; gnu affero general public license; gnu affero general public license (?:as published by the free software foundation )?@3(?: 0)?(?: only)?
agpl-3.0-or-later; gnu affero general public license; gnu affero general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
gfdl; gnu free documentation license; under the terms of the gnu free documentation license(?: version 1 [123])?(?: or any later version)?
mpl-1.1; mozilla public license; the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0; mozilla public license; subject to the terms of the mozilla public license @2 0
epl-1.0; eclipse public license; under the terms of the eclipse public license @1 0
epl-2.0; eclipse public license; under the terms of the eclipse public license @2 0
cddl-1.0; common development and distribution license; subject to the terms of the common development and distribution license(?: @1 0)?
eupl-1.2; eupl; licensed under the eupl @1 2
bsl-1.0; boost software license; distributed under the boost software license version 1 0
artistic-2.0; artistic license; under (?:the )?(?:terms of (?:the )?)?artistic license @2(?: 0)?
ofl-1.1; sil open font license; licensed under the sil open font license version 1 1
wtfpl; do what the fuck you want to; under the terms of the do what the fuck you want to public license
perl; same terms as perl; under the same terms as perl(?: itself)?
python-2.0; psf license; (?:licensed|released|distributed) under the psf license
python-2.0; python software foundation license; (?:licensed|released|distributed) under the python software foundation license
zlib; zlib; (?:licensed|released|distributed) under the zlib(?: libpng)? license
cc-by-4.0; cc by 4 0; licensed under (?:a |the )?cc by 4 0(?: international)?(?: license)?
cc-by-sa-4.0; cc by sa 4 0; licensed under (?:a |the )?cc by sa 4 0(?: international)?(?: license)?
cc-by-nc-4.0; cc by nc 4 0; licensed under (?:a |the )?cc by nc 4 0(?: international)?(?: license)?
cc-by-nd-4.0; cc by nd 4 0; licensed under (?:a |the )?cc by nd 4 0(?: international)?(?: license)?
cc-by-nc-sa-4.0; cc by nc sa 4 0; licensed under (?:a |the )?cc by nc sa 4 0(?: international)?(?: license)?
cc-by-nc-nd-4.0; cc by nc nd 4 0; licensed under (?:a |the )?cc by nc nd 4 0(?: international)?(?: license)?
cc-by; creative commons attribution; licensed under (?:a |the )?creative commons attribution (?:[1-4] [05] )?(?:international |unported |generic )?license
cc-by-sa; creative commons attribution sharealike; licensed under (?:a |the )?creative commons attribution sharealike (?:[1-4] [05] )?(?:international |unported |generic )?license
cc-by-nc; creative commons attribution noncommercial; licensed under (?:a |the )?creative commons attribution noncommercial (?:[1-4] [05] )?(?:international |unported |generic )?license
cc0-1.0; cc0; (?:dedicated to the public domain|released|published) under cc0(?: 1 0)?
public-domain; public domain; (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain; public domain; this (?:work|file|software|code|program|text) is (?:in the )?public domain
proprietary; proprietary and confidential; (?:this (?:file|software|document|material) is )?proprietary and confidential
proprietary; unauthorized copying; unauthorized copying of this (?:file|software|document|material)(?: via any medium)? is strictly prohibited
proprietary; may not be reproduced; (?:no part of this .{1,40}|this .{1,40}) may not be reproduced(?: distributed)?(?: or transmitted)? (?:in any form )?without (?:the )?(?:prior )?(?:written )?(?:permission|consent)
proprietary; no part of this; no part of this (?:publication|book|work|document|site|website) may be (?:reproduced|copied|used)
commercial; commercial license; (?:use|used|available|licensed|distributed) under (?:a|the|our) commercial license
non-commercial; non commercial; for (?:personal|academic|research|educational)(?: and| or)? non commercial use only
non-commercial; noncommercial; for noncommercial use only
all-permissive; copying and distribution of this file; copying and distribution of this file with or without modification are permitted in any medium without royalty
"""

TEXT = """
mit; permission is hereby granted free of charge; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit; to deal in the software without restriction; to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
mit; shall be included in all copies or substantial portions; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit; the software is provided as is; the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
isc; with or without fee is hereby granted; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
isc; the software is provided as is and; the software is provided as is and the author disclaims all warranties with regard to this software
0bsd; with or without fee is hereby granted; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)
bsd; redistribution and use in source and binary forms; redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd; redistributions of source code must retain; redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd; redistributions in binary form must reproduce; redistributions in binary form must reproduce the above copyright notice
bsd-3-clause; to endorse or promote products; neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products
bsd-4-clause; all advertising materials mentioning; all advertising materials mentioning features or use of this software must display the following acknowledg?ement
apache-2.0; apache license; apache license version 2 0 january 2004
apache-2.0; you may not use this file except in compliance; you may not use this file except in compliance with the license(?: you may obtain a copy of the license at)?
apache-2.0; unless required by applicable law or agreed to in writing; unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0; terms and conditions for use reproduction and distribution; terms and conditions for use reproduction and distribution
apache-2.0; grant of patent license; grant of patent license subject to the terms and conditions of this license
gpl; this program is free software; this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl; you should have received a copy; you should have received a copy of the gnu general public license along with this program
gpl; without even the implied warranty; without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl-2.0; gnu general public license version 2 june 1991; gnu general public license version 2 june 1991
gpl-3.0; gnu general public license version 3 29 june 2007; gnu general public license version 3 29 june 2007
gpl; everyone is permitted to copy and distribute verbatim copies; everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
lgpl; this library is free software; this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl; you should have received a copy; you should have received a copy of the gnu (?:lesser|library) general public license
lgpl-2.1; gnu lesser general public license version 2 1 february 1999; gnu lesser general public license version 2 1 february 1999
agpl; you should have received a copy; you should have received a copy of the gnu affero general public license
agpl-3.0; gnu affero general public license version 3 19 november 2007; gnu affero general public license version 3 19 november 2007
agpl; remote network interaction; remote network interaction use with the gnu general public license
mpl-2.0; mozilla public license; this source code form is subject to the terms of the mozilla public license v ?2 0
mpl-2.0; incompatible with secondary licenses; incompatible with secondary licenses
mpl-2.0; covered software is provided under this license; covered software is provided under this license on an as is basis
epl-1.0; eclipse public license; the accompanying program is provided under the terms of this eclipse public license
epl-2.0; eclipse public license; this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
unlicense; this is free and unencumbered software; this is free and unencumbered software released into the public domain
unlicense; free to copy modify publish use compile sell; anyone is free to copy modify publish use compile sell or distribute this software
zlib; in no event will the authors be held liable; this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
zlib; the origin of this software must not be misrepresented; the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib; altered source versions must be plainly marked; altered source versions must be plainly marked as such
bsl-1.0; permission is hereby granted free of charge; permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
wtfpl; you just do what the fuck you want to; 0 you just do what the fuck you want to
artistic; the intent of this document is to state; the intent of this document is to state the conditions under which a package may be copied
artistic-2.0; this license establishes the terms under which; this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
ofl-1.1; fonts may be bundled embedded redistributed; fonts may be bundled embedded redistributed and or sold with any software
ofl-1.1; reserved font name; no modified version of the font software may use the reserved font names?
postgresql; in no event shall the university of california; in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
ncsa; university of illinois; university of illinois ncsa open source license
python-2.0; psf hereby grants; psf hereby grants licensee a nonexclusive royalty free world wide license
openssl; this product includes software developed by the openssl project; this product includes software developed by the openssl project
x11; the open group; except as contained in this notice the name of the open group shall not be used in advertising
x11; the x consortium; except as contained in this notice the name of the x consortium shall not be used in advertising
curl; except as contained in this notice; except as contained in this notice the name of a copyright holder shall not be used in advertising
jpeg; independent jpeg group; this software is based in part on the work of the independent jpeg group
bzip2; julian; the bzip2 .{1,60} julian r? ?seward
json; the software shall be used for good; the software shall be used for good not evil
beerware; you can buy me a beer; you can buy me a beer in return
cc0-1.0; has waived all copyright; has waived all copyright and related or neighboring rights
cc; by exercising the licensed rights; by exercising the licensed rights defined below you accept and agree to be bound
cc-by; you must give appropriate credit; you must give appropriate credit provide a link to the license and indicate if changes were made
cc-nc; you may not use the material for commercial purposes; you may not use the material for commercial purposes
cc-nd; you may not distribute the modified material; if you remix transform or build upon the material you may not distribute the modified material
cc-sa; you must distribute your contributions under the same license; you must distribute your contributions under the same license as the original
odbl; open database license; made available under the open database license
busl-1.1; business source license; use of the licensed work in production is governed by the business source license|business source license 1 1 parameters
elastic-2.0; you may not provide the software to third parties; you may not provide the software to third parties as a hosted or managed service
sspl-1.0; making the functionality of the program; making the functionality of the program or modified version available to third parties as a service
commons-clause; commons clause; commons clause license condition
"""

URL = """
apache-2.0; apache org licenses license 2 0; apache org licenses license 2 0
apache-1.1; apache org licenses license 1 1; apache org licenses license 1 1
mit; opensource org licenses mit; opensource org licenses mit(?: license)?
isc; opensource org licenses isc; opensource org licenses isc(?: license)?
bsd-2-clause; opensource org licenses bsd 2 clause; opensource org licenses bsd 2 clause
bsd-3-clause; opensource org licenses bsd 3 clause; opensource org licenses bsd 3 clause
gpl-2.0; gnu org licenses; gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0; gnu org licenses gpl 3 0; gnu org licenses gpl 3 0
gpl; gnu org licenses gpl; gnu org licenses gpl(?: html)?(?! \\d)
lgpl-2.1; gnu org licenses; gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0; gnu org licenses lgpl 3 0; gnu org licenses lgpl 3 0
lgpl; gnu org licenses lgpl; gnu org licenses lgpl(?: html)?(?! \\d)
agpl-3.0; gnu org licenses agpl; gnu org licenses agpl(?: 3 0)?
gfdl; gnu org licenses fdl; gnu org licenses fdl(?: 1 [123])?
mpl-1.1; mozilla org mpl 1 1; mozilla org mpl 1 1
mpl-2.0; mozilla org mpl 2 0; mozilla org mpl 2 0
epl-1.0; eclipse org legal epl v10; eclipse org legal epl v10
epl-2.0; eclipse org legal epl; eclipse org legal epl (?:v20|2 0)
bsl-1.0; boost org license 1 0; boost org license 1 0
unlicense; unlicense org; unlicense org
wtfpl; wtfpl net; wtfpl net
ofl-1.1; scripts sil org ofl; scripts sil org ofl
cddl-1.0; opensource org licenses cddl; opensource org licenses cddl(?: 1 0| 1)?
artistic-2.0; opensource org licenses artistic; opensource org licenses artistic license 2 0
cc0-1.0; creativecommons org publicdomain zero; creativecommons org publicdomain zero 1 0
public-domain; creativecommons org publicdomain mark; creativecommons org publicdomain mark 1 0
cc-by-1.0; creativecommons org licenses by 1 0; creativecommons org licenses by 1 0
cc-by-2.0; creativecommons org licenses by 2 0; creativecommons org licenses by 2 0
cc-by-2.5; creativecommons org licenses by 2 5; creativecommons org licenses by 2 5
cc-by-3.0; creativecommons org licenses by 3 0; creativecommons org licenses by 3 0
cc-by-4.0; creativecommons org licenses by 4 0; creativecommons org licenses by 4 0
cc-by-sa-2.0; creativecommons org licenses by sa 2 0; creativecommons org licenses by sa 2 0
cc-by-sa-3.0; creativecommons org licenses by sa 3 0; creativecommons org licenses by sa 3 0
cc-by-sa-4.0; creativecommons org licenses by sa 4 0; creativecommons org licenses by sa 4 0
cc-by-nc-3.0; creativecommons org licenses by nc 3 0; creativecommons org licenses by nc 3 0
cc-by-nc-4.0; creativecommons org licenses by nc 4 0; creativecommons org licenses by nc 4 0
cc-by-nd-3.0; creativecommons org licenses by nd 3 0; creativecommons org licenses by nd 3 0
cc-by-nd-4.0; creativecommons org licenses by nd 4 0; creativecommons org licenses by nd 4 0
cc-by-nc-sa-3.0; creativecommons org licenses by nc sa 3 0; creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0; creativecommons org licenses by nc sa 4 0; creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-3.0; creativecommons org licenses by nc nd 3 0; creativecommons org licenses by nc nd 3 0
cc-by-nc-nd-4.0; creativecommons org licenses by nc nd 4 0; creativecommons org licenses by nc nd 4 0
odbl; opendatacommons org licenses odbl; opendatacommons org licenses odbl
"""

NAME = """
apache-2.0; apache license; (?:the )?apache license @2(?: 0)?
apache-2.0; apache 2 0; apache 2 0
apache; apache license; (?:the )?apache license
apache; apache software license; (?:the )?apache software license
mit; mit license; (?:the )?mit license
mit; expat license; (?:the )?expat license
mit-0; mit no attribution; mit no attribution(?: license)?
isc; isc license; (?:the )?isc license
bsd-2-clause; bsd 2 clause; bsd 2 clause(?: license)?
bsd-2-clause; 2 clause bsd; 2 clause bsd(?: license)?
bsd-2-clause; simplified bsd license; simplified bsd license
bsd-3-clause; bsd 3 clause; bsd 3 clause(?: license)?
bsd-3-clause; 3 clause bsd; 3 clause bsd(?: license)?
bsd-3-clause; new bsd license; new bsd license
bsd-4-clause; 4 clause bsd; 4 clause bsd(?: license)?
bsd; bsd license; bsd license
bsd; bsd style license; bsd style license
gpl-2.0; gpl; (?:gnu )?gpl @2(?: 0)?
gpl-2.0; gplv2; (?:gnu )?gplv2(?: 0)?
gpl-2.0-or-later; gplv2; (?:gnu )?gplv2(?: 0)? or later
gpl-3.0; gpl; (?:gnu )?gpl @3(?: 0)?
gpl-3.0; gplv3; (?:gnu )?gplv3(?: 0)?
gpl-3.0-or-later; gplv3; (?:gnu )?gplv3(?: 0)? or later
gpl; general public license; (?:gnu )?general public license
gpl; gnu gpl; (?:the )?gnu gpl
lgpl-2.1; lgpl; (?:gnu )?lgpl @2 1
lgpl-3.0; lgpl; (?:gnu )?lgpl @3(?: 0)?
lgpl-2.1; lgplv2 1; (?:gnu )?lgplv2 1
lgpl-3.0; lgplv3; (?:gnu )?lgplv3(?: 0)?
lgpl; lesser general public license; (?:gnu )?lesser general public license
lgpl; library general public license; (?:gnu )?library general public license
agpl-3.0; agpl; (?:gnu )?agpl @3(?: 0)?
agpl-3.0; agplv3; (?:gnu )?agplv3(?: 0)?
agpl; affero general public license; (?:gnu )?affero general public license
gfdl; gnu free documentation license; gnu free documentation license(?: @1 [123])?
mpl-1.1; mozilla public license; mozilla public license @1 1
mpl-2.0; mozilla public license; mozilla public license @2 0
mpl; mozilla public license; mozilla public license
epl-1.0; eclipse public license; eclipse public license @1 0
epl-2.0; eclipse public license; eclipse public license @2 0
epl; eclipse public license; eclipse public license
cddl-1.0; common development and distribution license; common development and distribution license(?: @1 0)?
cpl-1.0; common public license; common public license @1 0
eupl-1.2; european union public licence; european union public licence(?: @1 2)?
bsl-1.0; boost software license; boost software license(?: @1 0)?
busl-1.1; business source license; business source license(?: @1 1)?
artistic-2.0; artistic license; artistic license @2(?: 0)?
artistic; artistic license; artistic license
wtfpl; wtfpl; wtfpl
unlicense; the unlicense; the unlicense
zlib; zlib license; zlib license
zlib; zlib libpng license; zlib libpng license
ofl-1.1; sil open font license; sil open font license(?: @1 1)?
python-2.0; python software foundation license; python software foundation license(?: @2)?
postgresql; postgresql licen; postgresql licen[sc]e
ncsa; ncsa open source license; ncsa open source license
ms-pl; microsoft public license; microsoft public license
ms-rl; microsoft reciprocal license; microsoft reciprocal license
osl-3.0; open software license; open software license @3 0
afl-3.0; academic free license; academic free license @3 0
php-3.01; php license; php license(?: @3 01)?
ruby; ruby license; ruby license
vim; vim license; vim license
qpl-1.0; q public license; q public license(?: @1 0)?
ipl-1.0; ibm public license; ibm public license(?: @1 0)?
apsl-2.0; apple public source license; apple public source license(?: @2(?: 0)?)?
sspl-1.0; server side public license; server side public license(?: @1)?
elastic-2.0; elastic license; elastic license(?: @2(?: 0)?)?
odbl; open database license; open database license(?: @1 0)?
cdla; community data license agreement; community data license agreement
ogl; open government licence; open government licence(?: @[123](?: 0)?)?
cc0-1.0; cc0; (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc-by-2.0; cc by 2 0; cc by 2 0
cc-by-3.0; cc by 3 0; cc by 3 0
cc-by-4.0; cc by 4 0; cc by 4 0
cc-by-sa-2.0; cc by sa 2 0; cc by sa 2 0
cc-by-sa-3.0; cc by sa 3 0; cc by sa 3 0
cc-by-sa-4.0; cc by sa 4 0; cc by sa 4 0
cc-by-nc-2.0; cc by nc 2 0; cc by nc 2 0
cc-by-nc-3.0; cc by nc 3 0; cc by nc 3 0
cc-by-nc-4.0; cc by nc 4 0; cc by nc 4 0
cc-by-nd-3.0; cc by nd 3 0; cc by nd 3 0
cc-by-nd-4.0; cc by nd 4 0; cc by nd 4 0
cc-by-nc-sa-3.0; cc by nc sa 3 0; cc by nc sa 3 0
cc-by-nc-sa-4.0; cc by nc sa 4 0; cc by nc sa 4 0
cc-by-nc-nd-3.0; cc by nc nd 3 0; cc by nc nd 3 0
cc-by-nc-nd-4.0; cc by nc nd 4 0; cc by nc nd 4 0
cc-by-sa; cc by sa; cc by sa
cc-by-nc; cc by nc; cc by nc
cc-by-nd; cc by nd; cc by nd
cc-by-nc-sa; cc by nc sa; cc by nc sa
cc-by-nc-nd; cc by nc nd; cc by nc nd
cc-by; cc by; cc by
cc-by-sa; attribution sharealike; creative commons attribution sharealike(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-nc; attribution noncommercial; creative commons attribution noncommercial(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-nd; attribution noderivatives; creative commons attribution noderivatives(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-nc-sa; attribution noncommercial sharealike; creative commons attribution noncommercial sharealike(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-nc-nd; attribution noncommercial noderivatives; creative commons attribution noncommercial noderivatives(?: [1-4] [05])?(?: international| unported| generic)?
cc-by; creative commons attribution; creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?
"""

HINT = """
reserved; all rights reserved; all rights reserved
reserved; rights reserved; (?:some|certain|no) rights reserved
reserved; alle rechte vorbehalten; alle rechte vorbehalten
reserved; tous droits réservés; tous droits réservés
reserved; todos los derechos reservados; todos los derechos reservados
cc; creative commons; creative commons(?: license)?
copyright; copyright; copyright (?:c |© )?(?:19|20)\\d\\d(?: (?:19|20)\\d\\d)?
copyright; copyrighted; copyrighted (?:material|work)
public-domain; public domain; in the public domain
proprietary; proprietary license; proprietary license
proprietary; end user license agreement; end user license agreement
"""

# Phrases whose places every scan reports, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def rules() -> list[tuple[str, str, str, str]]:
    """(kind, label, keyword, pattern) of every rule, highest priority first; within a kind in the order written."""
    told = {"tag": TAG, "notice": NOTICE, "text": TEXT, "url": URL, "name": NAME, "hint": HINT}
    out = []
    for kind in KINDS:
        for line in told[kind].strip().splitlines():
            label, keyword, pattern = line.split("; ", 2)
            out.append((kind, label, keyword, pattern.replace("@", VERSION)))
    return out
