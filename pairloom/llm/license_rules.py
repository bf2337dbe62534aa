"""Signature rules for licences, in order of priority classes.

One rule a line: label, class, keyword, pattern. A blank in a pattern stands for what separates words; a pattern begins
and ends at word borders of the lower-cased text. Classes: 5 identifier, 4 grant, 3 full name with version, 2 address,
1 name alone, 0 phrase of a licence text. The keyword is a string without which the pattern cannot match.
"""

RULES = r"""
apache-2.0 5 spdx spdx license identifier apache 2 0
apache-2.0 4 apache (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache(?: software)? licen[cs]e(?: version)? v?2(?: 0)?
apache-2.0 3 apache apache(?: software)? licen[cs]e(?: version)? v?2(?: 0)?
apache-2.0 3 apache apache 2(?: 0)?(?: licen[cs]e)?
apache-2.0 2 apache apache org licenses license 2 0(?: txt| html)?
apache-2.0 2 apache opensource org licenses? apache 2 0
apache-2.0 0 governing see the license for the specific language governing permissions and limitations under the license
apache-2.0 0 compliance you may not use this file except in compliance with the license
apache-1.1 5 spdx spdx license identifier apache 1 1
apache-1.1 3 apache apache(?: software)? licen[cs]e(?: version)? v?1 1
apache-1.1 2 apache apache org licenses license 1 1
apache-1.0 5 spdx spdx license identifier apache 1 0
apache-1.0 3 apache apache(?: software)? licen[cs]e(?: version)? v?1 0
apache 1 apache apache(?: software)? licen[cs]e
mit 5 spdx spdx license identifier mit
mit 4 mit (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:expat )?mit licen[cs]e
mit 2 mit opensource org licenses? mit(?: license)?(?: php)?
mit 2 mit spdx org licenses mit
mit 1 mit (?:the )?mit licen[cs]ed?
mit 1 expat expat licen[cs]e
mit 0 hereby permission is hereby granted free of charge to any person obtaining a copy
mit 0 substantial the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit-0 5 spdx spdx license identifier mit 0
mit-0 1 attribution mit no attribution(?: licen[cs]e)?
x11 5 spdx spdx license identifier x11
x11 1 x11 x11 licen[cs]e
isc 5 spdx spdx license identifier isc
isc 4 isc (?:licensed|released) under (?:the )?isc licen[cs]e
isc 2 isc opensource org licenses? isc
isc 1 isc isc licen[cs]e
isc 0 modify permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
bsd-2-clause 5 spdx spdx license identifier bsd 2 clause
bsd-2-clause 3 bsd (?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e
bsd-2-clause 3 bsd bsd 2 clause(?: simplified)?(?: licen[cs]e)?
bsd-2-clause 2 bsd opensource org licenses? bsd 2 clause
bsd-3-clause 5 spdx spdx license identifier bsd 3 clause
bsd-3-clause 3 bsd (?:new|revised|modified|3 clause|three clause) bsd licen[cs]e
bsd-3-clause 3 bsd bsd 3 clause(?: new| revised)?(?: licen[cs]e)?
bsd-3-clause 2 bsd opensource org licenses? bsd 3 clause
bsd-3-clause 0 endorse neither the name of [^\n]{1,120} nor the names of its contributors may be used to endorse or promote
bsd-4-clause 5 spdx spdx license identifier bsd 4 clause
bsd-4-clause 3 bsd (?:original|old|4 clause|four clause) bsd licen[cs]e
bsd-4-clause 0 advertising all advertising materials mentioning features or use of this software must display
0bsd 5 spdx spdx license identifier 0bsd
0bsd 1 0bsd 0bsd
0bsd 3 bsd (?:bsd zero clause|zero clause bsd)(?: licen[cs]e)?
bsd 4 bsd (?:licensed|released|distributed) under (?:the |a )?bsd(?: style)? licen[cs]e
bsd 1 bsd bsd(?: style)? licen[cs]e
bsd 0 redistribution redistribution and use in source and binary forms with or without modification are permitted
gpl-3.0-or-later 5 spdx spdx license identifier gpl 3 0 or later
gpl-3.0-only 5 spdx spdx license identifier gpl 3 0 only
gpl-3.0 5 spdx spdx license identifier gpl 3 0
gpl-3.0 4 general (?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?3
gpl-3.0 3 general (?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?3(?: 0)?
gpl-3.0 3 gpl (?:gnu )?gpl v(?:ersion )?3(?: 0)?
gpl-3.0 3 gpl gpl 3 0
gpl-3.0 3 gplv3 gplv3
gpl-3.0 2 gpl gnu org licenses gpl 3 0(?: html| txt| en html)?
gpl-3.0 2 gpl opensource org licenses? gpl 3 0
gpl-2.0-or-later 5 spdx spdx license identifier gpl 2 0 or later
gpl-2.0-only 5 spdx spdx license identifier gpl 2 0 only
gpl-2.0 5 spdx spdx license identifier gpl 2 0
gpl-2.0 4 general (?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?2
gpl-2.0 3 general (?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?2(?: 0)?
gpl-2.0 3 gpl (?:gnu )?gpl v(?:ersion )?2(?: 0)?
gpl-2.0 3 gpl gpl 2 0
gpl-2.0 3 gplv2 gplv2
gpl-2.0 2 gpl gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt| en html)?
gpl-2.0 2 gpl opensource org licenses? gpl 2 0
gpl-1.0 5 spdx spdx license identifier gpl 1 0(?: only| or later)?
gpl-1.0 3 general (?:gnu )?general public licen[cs]e v(?:ersion )?1(?: 0)?
gpl 2 gpl gnu org (?:copyleft|licenses) gpl(?: html)?
gpl 1 general (?:gnu )?general public licen[cs]e
gpl 1 gpl gnu gpl
gpl 1 gpl gpl licen[cs]ed?
gpl 0 redistribute you can redistribute it and or modify it under the terms of the gnu general public license
gpl 0 foundation write to the free software foundation inc
lgpl-3.0 5 spdx spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3.0 3 lesser (?:gnu )?lesser general public licen[cs]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?3(?: 0)?
lgpl-3.0 3 lgpl lgpl v?3(?: 0)?
lgpl-3.0 3 lgplv3 lgplv3
lgpl-3.0 2 lgpl gnu org licenses lgpl 3 0(?: html| txt)?
lgpl-2.1 5 spdx spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1 3 lesser (?:gnu )?lesser general public licen[cs]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?2 1
lgpl-2.1 3 lgpl lgpl v?2 1
lgpl-2.1 3 lgplv2 lgplv2 1
lgpl-2.1 2 lgpl gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl-2.0 5 spdx spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.0 3 library (?:gnu )?library general public licen[cs]e(?: v(?:ersion )?2(?: 0)?)?
lgpl 1 lesser (?:gnu )?lesser general public licen[cs]e
lgpl 1 lgpl (?:gnu )?lgpl(?: licen[cs]ed?)?
agpl-3.0 5 spdx spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0 3 affero (?:gnu )?affero general public licen[cs]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?3(?: 0)?
agpl-3.0 3 agpl agpl v?3(?: 0)?
agpl-3.0 3 agplv3 agplv3
agpl-3.0 2 agpl gnu org licenses agpl 3 0(?: html| txt)?
agpl-1.0 3 affero affero general public licen[cs]e v(?:ersion )?1(?: 0)?
agpl 1 affero (?:gnu )?affero general public licen[cs]e
agpl 1 agpl agpl(?: licen[cs]ed?)?
gfdl-1.3 5 spdx spdx license identifier gfdl 1 3(?: only| or later)?
gfdl-1.3 3 documentation gnu free documentation licen[cs]e v(?:ersion )?1 3
gfdl-1.2 5 spdx spdx license identifier gfdl 1 2(?: only| or later)?
gfdl-1.2 3 documentation gnu free documentation licen[cs]e v(?:ersion )?1 2
gfdl 2 fdl gnu org (?:copyleft|licenses) fdl(?: html)?
gfdl 1 documentation (?:gnu )?free documentation licen[cs]e
gfdl 1 gfdl gfdl
mpl-2.0 5 spdx spdx license identifier mpl 2 0
mpl-2.0 3 mozilla mozilla public licen[cs]e(?: version)? v?2(?: 0)?
mpl-2.0 3 mpl mpl(?: version)? v?2(?: 0)?
mpl-2.0 2 mozilla mozilla org (?:en us )?mpl 2 0
mpl-2.0 0 mozilla subject to the terms of the mozilla public license
mpl-1.1 5 spdx spdx license identifier mpl 1 1
mpl-1.1 3 mozilla mozilla public licen[cs]e(?: version)? v?1 1
mpl-1.1 3 mpl mpl(?: version)? v?1 1
mpl-1.1 2 mozilla mozilla org mpl mpl 1 1
mpl-1.0 5 spdx spdx license identifier mpl 1 0
mpl-1.0 3 mozilla mozilla public licen[cs]e(?: version)? v?1 0
mpl 1 mozilla mozilla public licen[cs]e
epl-2.0 5 spdx spdx license identifier epl 2 0
epl-2.0 3 eclipse eclipse public licen[cs]e(?: version)? v?2(?: 0)?
epl-2.0 2 epl eclipse org legal epl 2 0
epl-1.0 5 spdx spdx license identifier epl 1 0
epl-1.0 3 eclipse eclipse public licen[cs]e(?: version)? v?1(?: 0)?
epl-1.0 2 epl eclipse org legal epl v10(?: html)?
epl 1 eclipse eclipse public licen[cs]e
edl-1.0 1 eclipse eclipse distribution licen[cs]e(?: version)?(?: v?1 0)?
cddl-1.0 5 spdx spdx license identifier cddl 1 0
cddl-1.0 3 distribution common development and distribution licen[cs]e(?: cddl)?(?: version)? v?1(?: 0)?
cddl-1.1 5 spdx spdx license identifier cddl 1 1
cddl-1.1 3 distribution common development and distribution licen[cs]e(?: cddl)?(?: version)? v?1 1
cddl 1 distribution common development and distribution licen[cs]e
cddl 1 cddl cddl
cpl-1.0 5 spdx spdx license identifier cpl 1 0
cpl-1.0 1 common common public licen[cs]e(?: version)?(?: v?1 0)?
ipl-1.0 1 ibm ibm public licen[cs]e
eupl-1.2 5 spdx spdx license identifier eupl 1 2
eupl-1.2 3 european european union public licen[cs]e(?: version)? v?1 2
eupl-1.1 5 spdx spdx license identifier eupl 1 1
eupl-1.1 3 european european union public licen[cs]e(?: version)? v?1 1
eupl 1 european european union public licen[cs]e
eupl 1 eupl eupl
cecill-2.1 5 spdx spdx license identifier cecill 2 1
cecill 1 cecill cecill(?: [abc])?(?: licen[cs]e)?
artistic-2.0 5 spdx spdx license identifier artistic 2 0
artistic-2.0 3 artistic artistic licen[cs]e(?: version)? v?2(?: 0)?
artistic-1.0 5 spdx spdx license identifier artistic 1 0
artistic-1.0 3 artistic artistic licen[cs]e(?: version)? v?1(?: 0)?
artistic 1 artistic (?:perl )?artistic licen[cs]e
perl 1 perl same terms as perl(?: itself)?
zlib 5 spdx spdx license identifier zlib
zlib 1 zlib (?:zlib libpng|libpng zlib|zlib) licen[cs]e
zlib 0 misrepresented the origin of this software must not be misrepresented
libpng 1 libpng libpng licen[cs]e
bsl-1.0 5 spdx spdx license identifier bsl 1 0
bsl-1.0 3 boost boost software licen[cs]e(?: version)?(?: v?1(?: 0)?)?
bsl-1.0 2 boost boost org license 1 0(?: txt)?
unlicense 5 spdx spdx license identifier unlicense
unlicense 2 unlicense unlicense org
unlicense 1 unlicense (?:the )?unlicense
unlicense 0 unencumbered this is free and unencumbered software released into the public domain
wtfpl 5 spdx spdx license identifier wtfpl
wtfpl 1 wtfpl wtfpl
public-domain 4 domain (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain 1 domain (?:is|are) in the public domain
cc0-1.0 5 spdx spdx license identifier cc0 1 0
cc0-1.0 2 creativecommons creativecommons org publicdomain zero 1 0
cc0-1.0 3 cc0 cc0(?: 1 0)?(?: universal)?
cc0-1.0 1 zero creative commons zero
cc-pdm-1.0 2 creativecommons creativecommons org publicdomain mark 1 0
cc-by-4.0 5 spdx spdx license identifier cc by 4 0
cc-by-4.0 2 creativecommons creativecommons org licenses by 4 0
cc-by-4.0 3 commons creative commons attribution(?: licen[cs]e)? 4 0(?: international)?(?: licen[cs]e)?
cc-by-4.0 3 cc cc by(?: licen[cs]e)? 4 0
cc-by-3.0 5 spdx spdx license identifier cc by 3 0
cc-by-3.0 2 creativecommons creativecommons org licenses by 3 0
cc-by-3.0 3 commons creative commons attribution(?: licen[cs]e)? 3 0(?: unported)?
cc-by-3.0 3 cc cc by 3 0
cc-by-2.5 2 creativecommons creativecommons org licenses by 2 5
cc-by-2.5 3 cc cc by 2 5
cc-by-2.0 2 creativecommons creativecommons org licenses by 2 0
cc-by-2.0 3 cc cc by 2 0
cc-by-sa-4.0 5 spdx spdx license identifier cc by sa 4 0
cc-by-sa-4.0 2 creativecommons creativecommons org licenses by sa 4 0
cc-by-sa-4.0 3 commons creative commons attribution share ?alike(?: licen[cs]e)? 4 0(?: international)?
cc-by-sa-4.0 3 cc cc by sa 4 0
cc-by-sa-3.0 5 spdx spdx license identifier cc by sa 3 0
cc-by-sa-3.0 2 creativecommons creativecommons org licenses by sa 3 0
cc-by-sa-3.0 3 commons creative commons attribution share ?alike(?: licen[cs]e)? 3 0(?: unported)?
cc-by-sa-3.0 3 cc cc by sa 3 0
cc-by-sa-2.5 2 creativecommons creativecommons org licenses by sa 2 5
cc-by-sa-2.5 3 cc cc by sa 2 5
cc-by-sa-2.0 2 creativecommons creativecommons org licenses by sa 2 0
cc-by-sa-2.0 3 cc cc by sa 2 0
cc-by-nc-4.0 5 spdx spdx license identifier cc by nc 4 0
cc-by-nc-4.0 2 creativecommons creativecommons org licenses by nc 4 0
cc-by-nc-4.0 4 cc (?:licensed|released) under (?:a |the )?cc by nc 4 0
cc-by-nc-4.0 3 commons creative commons attribution non ?commercial(?: licen[cs]e)? 4 0(?: international)?
cc-by-nc-4.0 3 cc cc by nc 4 0
cc-by-nc-3.0 5 spdx spdx license identifier cc by nc 3 0
cc-by-nc-3.0 2 creativecommons creativecommons org licenses by nc 3 0
cc-by-nc-3.0 3 cc cc by nc 3 0
cc-by-nc-2.0 2 creativecommons creativecommons org licenses by nc 2 0
cc-by-nc-2.0 3 cc cc by nc 2 0
cc-by-nd-4.0 5 spdx spdx license identifier cc by nd 4 0
cc-by-nd-4.0 2 creativecommons creativecommons org licenses by nd 4 0
cc-by-nd-4.0 3 commons creative commons attribution no ?deriv(?:ative)?s(?: licen[cs]e)? 4 0
cc-by-nd-4.0 3 cc cc by nd 4 0
cc-by-nd-3.0 2 creativecommons creativecommons org licenses by nd 3 0
cc-by-nd-3.0 3 cc cc by nd 3 0
cc-by-nc-sa-4.0 5 spdx spdx license identifier cc by nc sa 4 0
cc-by-nc-sa-4.0 2 creativecommons creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-4.0 3 commons creative commons attribution non ?commercial share ?alike(?: licen[cs]e)? 4 0
cc-by-nc-sa-4.0 3 cc cc by nc sa 4 0
cc-by-nc-sa-3.0 2 creativecommons creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-3.0 3 cc cc by nc sa 3 0
cc-by-nc-nd-4.0 5 spdx spdx license identifier cc by nc nd 4 0
cc-by-nc-nd-4.0 2 creativecommons creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-4.0 3 commons creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: licen[cs]e)? 4 0
cc-by-nc-nd-4.0 3 cc cc by nc nd 4 0
cc-by-nc-nd-3.0 2 creativecommons creativecommons org licenses by nc nd 3 0
cc-by-nc-nd-3.0 3 cc cc by nc nd 3 0
cc-by-nc-nd 1 commons creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nc-sa 1 commons creative commons attribution non ?commercial share ?alike
cc-by-nc 1 commons creative commons attribution non ?commercial
cc-by-nc 1 cc cc by nc
cc-by-sa 1 commons creative commons attribution share ?alike
cc-by-sa 1 cc cc by sa
cc-by-nd 1 commons creative commons attribution no ?deriv(?:ative)?s
cc-by 1 commons creative commons attribution
cc-by 1 cc cc by
creative-commons 1 commons creative commons licen[cs]e
odbl-1.0 5 spdx spdx license identifier odbl 1 0
odbl-1.0 1 database open (?:data commons open )?database licen[cs]e(?: odbl)?
odbl-1.0 1 odbl odbl
odc-by-1.0 1 commons open data commons attribution licen[cs]e
pddl-1.0 1 commons open data commons public domain dedication
cdla-permissive 1 community community data licen[cs]e agreement permissive
cdla-sharing 1 community community data licen[cs]e agreement sharing
ogl-uk-3.0 1 government open government licen[cs]e(?: v?3(?: 0)?)?
ofl-1.1 5 spdx spdx license identifier ofl 1 1
ofl-1.1 1 font sil open font licen[cs]e(?: version)?(?: v?1 1)?
ofl-1.1 2 sil scripts sil org ofl
psf-2.0 5 spdx spdx license identifier (?:psf|python) 2 0
psf-2.0 1 python python(?: software foundation)? licen[cs]e(?: version)?(?: v?2)?
php-3.01 5 spdx spdx license identifier php 3 01
php-3.01 1 php php licen[cs]e(?: version)?(?: v?3 01)?
ruby 1 ruby ruby licen[cs]e
openssl 5 spdx spdx license identifier openssl
openssl 1 openssl openssl licen[cs]e
postgresql 1 postgresql postgresql licen[cs]e
ncsa 1 illinois university of illinois(?: ncsa)? open source licen[cs]e
ms-pl 5 spdx spdx license identifier ms pl
ms-pl 1 microsoft microsoft public licen[cs]e
ms-rl 1 microsoft microsoft reciprocal licen[cs]e
afl-3.0 1 academic academic free licen[cs]e(?: version)?(?: v?3 0)?
osl-3.0 1 open open software licen[cs]e(?: version)?(?: v?3 0)?
upl-1.0 1 universal universal permissive licen[cs]e
vim 1 vim vim licen[cs]e
w3c 1 w3c w3c(?: software)?(?: notice and)? licen[cs]e
unicode-dfs 1 unicode unicode(?: inc)? licen[cs]e(?: agreement)?
busl-1.1 5 spdx spdx license identifier busl 1 1
busl-1.1 1 business business source licen[cs]e(?: 1 1)?
sspl-1.0 5 spdx spdx license identifier sspl 1 0
sspl-1.0 1 server server side public licen[cs]e
elastic-2.0 1 elastic elastic licen[cs]e(?: 2 0)?
commons-clause 1 clause commons clause(?: licen[cs]e condition)?
openrail 1 openrail (?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?
prosperity-3.0 1 prosperity prosperity public licen[cs]e
polyform-nc-1.0 1 polyform polyform non ?commercial licen[cs]e
all-rights-reserved 1 reserved all rights reserved
proprietary 1 proprietary proprietary and confidential
proprietary 1 proprietary proprietary licen[cs]e
"""
