"""Signature rules for license texts, notices and names, in order.

A line is: label, priority (1 notice or text, 2 name with version, 3 name, 4 hint), keywords, regex. Regexes run over
lower-case words with one space between, and match whole words. A rule is tried only where one of its keywords is a
word of the text, so each text that its regex matches must hold one of them. Of two rules with the same span and priority the first one
counts. Groups repeat a bounded number of times only: some engines take a stack frame for each repetition.
"""

from __future__ import annotations

RULES_TEXT = r"""
gpl-3.0|1|foundation|gnu general public license as published by the free software foundation either version 3( of the license)?( or at your option any later version)?
gpl-3.0|1|june|gnu general public license version 3 29 june 2007
gpl-3.0|1|gnu|terms of (the )?gnu general public license (v|version )?3
gpl-2.0|1|foundation|gnu general public license as published by the free software foundation either version 2( of the license)?( or at your option any later version)?
gpl-2.0|1|june|gnu general public license version 2 june 1991
gpl-2.0|1|gnu|terms of (the )?gnu general public license (v|version )?2
gpl-1.0|1|foundation|gnu general public license as published by the free software foundation either version 1( of the license)?
gpl|1|redistribute|(this program|this library|this file|it) is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl|1|received|you should have received a copy of the gnu general public license( along with this (program|library|file))?
gpl-3.0|2|gnu|gnu general public license v(ersion )?3( 0)?( or later| only)?
gpl-2.0|2|gnu|gnu general public license v(ersion )?2( 0)?( or later| only)?
gpl|3|gnu|gnu general public licen[sc]e
gpl-3.0|2|gpl,gplv3,gpl3|gpl ?v?3( 0)?( or later| only| plus)?
gpl-2.0|2|gpl,gplv2,gpl2|gpl ?v?2( 0)?( or later| only| plus)?
gpl-1.0|2|gpl,gplv1,gpl1|gpl ?v?1( 0)?( or later| only| plus)?
gpl|4|gpl|licen[sc]ed under (the )?(gnu )?gpl
gpl|4|gpl|gnu gpl
gpl-exception-classpath|2|exception|(with )?(the )?(gnu )?classpath exception( 2 0)?
gpl-exception-linking|2|exception|(with )?(a |the )?linking exception
gpl-exception-gcc|2|exception|gcc runtime library exception( 3 1| 2 0)?
gpl-exception-bison|2|exception|bison exception( 2 2)?
gpl-exception-autoconf|2|exception|autoconf exception( 3 0| 2 0)?
lgpl-3.0|1|lesser|gnu lesser general public license as published by the free software foundation either version 3( of the license)?
lgpl-2.1|1|lesser|gnu lesser general public license as published by the free software foundation either version 2 1( of the license)?
lgpl-2.0|1|foundation|gnu library general public license as published by the free software foundation either version 2( of the license)?
lgpl|1|lesser|you should have received a copy of the gnu lesser general public license
lgpl-3.0|2|lesser|gnu lesser general public license v(ersion )?3( 0)?
lgpl-2.1|2|lesser|gnu lesser general public license v(ersion )?2 1
lgpl-2.0|2|gnu|gnu library general public license v(ersion )?2( 0)?
lgpl|3|lesser|gnu lesser general public licen[sc]e
lgpl|3|gnu|gnu library general public licen[sc]e
lgpl-3.0|2|lgpl,lgplv3,lgpl3|lgpl ?v?3( 0)?( or later| only)?
lgpl-2.1|2|lgpl,lgplv2,lgpl2|lgpl ?v?2 1( or later| only)?
lgpl-2.0|2|lgpl,lgplv2,lgpl2|lgpl ?v?2 0( or later| only)?
lgpl|4|lgpl|(gnu |licensed under (the )?)lgpl
agpl-3.0|1|affero|gnu affero general public license as published by the free software foundation either version 3( of the license)?
agpl|1|affero|you should have received a copy of the gnu affero general public license
agpl-3.0|2|affero|(gnu )?affero general public license v(ersion )?3( 0)?
agpl-1.0|2|affero|affero general public license v(ersion )?1( 0)?
agpl|3|affero|(gnu )?affero general public licen[sc]e
agpl-3.0|2|agpl,agplv3,agpl3|agpl ?v?3( 0)?( or later| only)?
agpl|4|agpl|(gnu |licensed under (the )?)agpl
gfdl-1.3|2|documentation|gnu free documentation license v(ersion )?1 3
gfdl-1.2|2|documentation|gnu free documentation license v(ersion )?1 2
gfdl-1.1|2|documentation|gnu free documentation license v(ersion )?1 1
gfdl|1|documentation|permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl|3|documentation|gnu free documentation license
gfdl|4|gfdl|gfdl( 1 [123])?
apache-2.0|1|apache|licensed under the apache license version 2 0( the license)?
apache-2.0|1|apache|you may obtain a copy of the license at https? www apache org licenses license 2 0
apache-2.0|1|apache|apache license version 2 0 january 2004
apache-2.0|2|apache|apache license (v|version )?2( 0)?
apache-1.1|2|apache|apache (software )?license (v|version )?1 1
apache-1.0|2|apache|apache (software )?license (v|version )?1 0
apache|3|apache|apache license
apache|3|apache|apache (software |public )licen[sc]e
apache-2.0|4|apache|apache 2( 0)?( license)?
apache|4|apache|licensed under apache
asf-notice|1|foundation|licensed to the apache software foundation asf under one or more contributor license agreements
asf-notice|1|foundation|this product includes software developed (by|at) the apache software foundation
mit|1|permission|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files( the software)?( to deal in the software without restriction)?
mit|1|distribute|including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit|1|permission|the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit|1|warranty|the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit-0|2|attribution|mit no attribution( license)?
mit|2|mit|(released|distributed|licensed|available|published) under (the )?(terms of the )?mit licen[sc]e
mit|3|mit|(the )?mit licen[sc]e
mit|4|mit|licen[sc]ed (under )?mit
mit|4|x11|mit x11( licen[sc]e)?
expat|3|expat|expat licen[sc]e
x11|3|x11|x11 licen[sc]e
x11|1|consortium|except as contained in this notice the name of the x consortium shall not be used in advertising
isc|1|permission|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc|1|without|permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted
isc|3|isc|isc licen[sc]e
bsd-4-clause|1|advertising|all advertising materials mentioning features or use of this software must display the following acknowledg(e)?ment
bsd-3-clause|1|promote|neither the name of (\S+ ){1,12}?nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-3-clause|1|promote|the names? of (\S+ ){1,9}?may not be used to endorse or promote products derived from this software
bsd-2-clause|1|redistribution|redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2-clause|1|redistributions|redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause|1|redistributions|redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd-4-clause|2|bsd|(bsd 4 clause|4 clause bsd|original bsd|old bsd)( licen[sc]e)?
bsd-3-clause|2|bsd|(bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)( licen[sc]e)?
bsd-2-clause|2|bsd,freebsd|(bsd 2 clause|2 clause bsd|simplified bsd|freebsd)( licen[sc]e)?
bsd-1-clause|2|bsd|(bsd 1 clause|1 clause bsd)( licen[sc]e)?
0bsd|2|bsd,0bsd|(zero clause bsd|bsd zero clause|0bsd)( licen[sc]e)?
bsd-clear|2|bsd|(clear bsd|bsd 3 clause clear)( licen[sc]e)?
bsd-protection|3|protection|bsd protection licen[sc]e
bsd-patent|2|bsd|bsd 2 clause plus patent( licen[sc]e)?
bsd|3|bsd|bsd licen[sc]e
bsd|3|bsd|bsd style licen[sc]e
bsd|4|bsd|licen[sc]ed under (the )?(terms of the )?bsd
cc-by-4.0|1|creative|(this work is )?licensed under (a |the )?creative commons attribution 4 0 international( public)? licen[sc]e
cc-by-sa-4.0|1|creative|licensed under (a |the )?creative commons attribution share ?alike 4 0 international( public)? licen[sc]e
cc-by-nc-4.0|1|creative|licensed under (a |the )?creative commons attribution non ?commercial 4 0 international( public)? licen[sc]e
cc-by-nd-4.0|1|creative|licensed under (a |the )?creative commons attribution no ?derivatives 4 0 international( public)? licen[sc]e
cc-by-nc-sa-4.0|1|creative|creative commons attribution non ?commercial share ?alike 4 0 international( public)? licen[sc]e
cc-by-nc-nd-4.0|1|creative|creative commons attribution non ?commercial no ?deriv(ative)?s 4 0 international( public)? licen[sc]e
cc-by-nc-sa|2|creative|creative commons attribution non ?commercial share ?alike( [1234] [05])?
cc-by-nc-nd|2|creative|creative commons attribution non ?commercial no ?deriv(ative)?(s|works)?( [1234] [05])?
cc-by-nc|2|creative|creative commons attribution non ?commercial( [1234] [05])?
cc-by-sa|2|creative|creative commons attribution share ?alike( [1234] [05])?
cc-by-nd|2|creative|creative commons attribution no ?deriv(ative)?(s|works)?( [1234] [05])?
cc-by|2|creative|creative commons attribution( [1234] [05])?( international| unported| generic)?( licen[sc]e)?
cc0|2|creative|creative commons (zero|cc0)( v?1 0)?( universal)?
cc0|2|cc0|cc0( v?1 0)?( universal)?( public domain dedication)?
cc-by-nc-sa|2|cc|cc by nc sa( [1234] [05])?
cc-by-nc-nd|2|cc|cc by nc nd( [1234] [05])?
cc-by-nc|2|cc|cc by nc( [1234] [05])?
cc-by-sa|2|cc|cc by sa( [1234] [05])?
cc-by-nd|2|cc|cc by nd( [1234] [05])?
cc-by-4.0|2|cc|cc by 4 0
cc-by-3.0|2|cc|cc by 3 0
cc-by-2.5|2|cc|cc by 2 5
cc-by-2.0|2|cc|cc by 2 0
cc-by-1.0|2|cc|cc by 1 0
cc-by|3|cc|cc by
cc-pd-mark|2|domain|(creative commons )?public domain mark( 1 0)?
cc-url|4|creativecommons|creativecommons org licenses by( nc| nd| sa| nc sa| nc nd)?( [1234] [05])?
cc-url-zero|4|creativecommons|creativecommons org publicdomain zero 1 0
creative-commons|4|creative|creative commons licen[sc]e
mpl-2.0|1|mozilla|this source code form is subject to the terms of the mozilla public license v(ersion )? ?2 0
mpl-1.1|1|mozilla|the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0|2|mozilla|mozilla public license (v|version )?2( 0)?
mpl-1.1|2|mozilla|mozilla public license (v|version )?1 1
mpl-1.0|2|mozilla|mozilla public license (v|version )?1 0
mpl|3|mozilla|mozilla public licen[sc]e
mpl|4|mpl|(mpl v?(1 [01]|2 0)|licensed under (the )?mpl)
epl-2.0|2|eclipse|eclipse public license (v|version )?2( 0)?
epl-1.0|2|eclipse|eclipse public license (v|version )?1( 0)?
epl|1|eclipse|made available under the terms of the eclipse public license
epl|3|eclipse|eclipse public licen[sc]e
epl|4|epl|epl v?[12]( 0)?
edl-1.0|2|distribution|eclipse distribution license (v|version )?1( 0)?
edl|3|distribution|eclipse distribution licen[sc]e
cpl-1.0|2|common|common public license (v|version )?1( 0)?
cpl|3|common|common public license
ipl-1.0|3|ibm|ibm public license( (v|version )?1 0)?
cddl-1.1|2|distribution|common development and distribution license( cddl)? (v|version )?1 1
cddl-1.0|2|distribution|common development and distribution license( cddl)? (v|version )?1 0
cddl|3|distribution|common development and distribution licen[sc]e
cddl|4|cddl|cddl( v?1 [01])?
eupl-1.2|2|european|european union public licen[sc]e( eupl)? (v|version )?1 2
eupl-1.1|2|european|european union public licen[sc]e( eupl)? (v|version )?1 1
eupl|3|european|european union public licen[sc]e
eupl|4|eupl|eupl( v?1 [012])?
cecill-2.1|2|cecill|cecill (license )?(v|version )?2 1
cecill-2.0|2|cecill|cecill (license )?(v|version )?2( 0)?
cecill-b|2|cecill|cecill b( licen[sc]e)?
cecill-c|2|cecill|cecill c( licen[sc]e)?
cecill|3|cecill|cecill( licen[sc]e)?
artistic-2.0|2|artistic|artistic license (v|version )?2( 0)?
artistic-1.0|2|artistic|artistic license (v|version )?1( 0)?
artistic|3|artistic|(the )?artistic licen[sc]e
perl|1|same|same terms as perl( 5)?( programming language system)? itself
perl|1|itself|under the same terms as perl itself
python-2.0|2|foundation|python software foundation license (v|version )?2
psf|3|foundation|python software foundation licen[sc]e
psf|4|psf|psf licen[sc]e
cnri-python|3|cnri|cnri (python )?(open source )?licen[sc]e( agreement)?
ruby|3|ruby|ruby licen[sc]e
ruby|1|ruby|(same terms as|under) ruby s licen[sc]e
php-3.01|2|php|php license (v|version )?3 01
php-3.0|2|php|php license (v|version )?3( 0)?
php|3|php|php licen[sc]e
zend-2.0|3|zend|zend (engine )?licen[sc]e( (v|version )?2 0)?
zlib|1|warranty|this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib|3|zlib|zlib( libpng)? licen[sc]e
libpng|3|libpng|libpng licen[sc]e( (v|version )?2)?
boost-1.0|1|boost|distributed under the boost software license version 1 0
boost-1.0|2|boost|boost software license (v|version )?1( 0)?
boost|3|boost|boost software licen[sc]e
boost|4|boost|boost licen[sc]e
unlicense|1|unencumbered|this is free and unencumbered software released into the public domain
unlicense|3|unlicense|(the )?unlicense
wtfpl|1|what|do what the fuck you want to public license
wtfpl|4|wtfpl|wtfpl( v?[12])?
public-domain|1|domain|(released|placed|dedicated|put) (in|into|to) the public domain
public-domain|1|domain|dedicate any and all copyright interest in the software to the public domain
public-domain|2|domain|this (work|file|code|software|document|text) is in the public domain
public-domain|4|domain|public domain
pddl-1.0|2|dedication|(open data commons )?public domain dedication and licen[sc]e( (v|version )?1 0)?
odbl-1.0|2|database|(open data commons )?open database licen[sc]e( odbl)?( (v|version )?1 0)?
odc-by-1.0|2|commons|open data commons attribution licen[sc]e( (v|version )?1 0)?
odbl|4|odbl|odbl( v?1 0)?
cdla-permissive-2.0|2|community|community data license agreement permissive( version)? 2 0
cdla-permissive-1.0|2|community|community data license agreement permissive( version)? 1 0
cdla-sharing-1.0|2|community|community data license agreement sharing( version)? 1 0
cdla|3|community|community data license agreement
ogl-uk-3.0|2|government|open government licen[sc]e (for public sector information )?(v|version )?3( 0)?
ogl-uk-2.0|2|government|open government licen[sc]e (for public sector information )?(v|version )?2( 0)?
ogl|3|government|open government licen[sc]e
etalab-2.0|2|ouverte|licence ouverte (v|version )?2( 0)?
etalab|3|ouverte|licence ouverte( open licen[sc]e)?
etalab|4|etalab|etalab( [12] 0)?
ofl-1.1|1|font|this font software is licensed under the sil open font license version 1 1
ofl-1.1|2|font|(sil )?open font license (v|version )?1 1
ofl-1.0|2|font|(sil )?open font license (v|version )?1 0
ofl|3|font|(sil )?open font licen[sc]e
ubuntu-font-1.0|3|ubuntu|ubuntu font licen[sc]e( (v|version )?1 0)?
bitstream-vera|3|bitstream|bitstream vera (fonts? )?(copyright|licen[sc]e)
ncsa|3|university|university of illinois (ncsa )?open source licen[sc]e
ncsa|4|ncsa|ncsa (open source )?licen[sc]e
afl-3.0|2|academic|academic free license (v|version )?3( 0)?
afl-2.1|2|academic|academic free license (v|version )?2 1
afl|3|academic|academic free licen[sc]e
osl-3.0|2|software|open software license (v|version )?3( 0)?
osl-2.1|2|software|open software license (v|version )?2 1
osl|3|software|open software licen[sc]e
ecl-2.0|2|educational|educational community license (v|version )?2( 0)?
ecl|3|educational|educational community licen[sc]e
ms-pl|3|microsoft|microsoft public licen[sc]e( ms pl)?
ms-rl|3|reciprocal|microsoft reciprocal licen[sc]e( ms rl)?
ms-lpl|3|microsoft|microsoft limited public licen[sc]e
apsl-2.0|2|apple|apple public source license (v|version )?2( 0)?
apsl-1.2|2|apple|apple public source license (v|version )?1 2
apsl|3|apple|apple public source licen[sc]e
npl-1.1|3|netscape|netscape public licen[sc]e( (v|version )?1 [01])?
sissl|3|standards|sun industry standards source licen[sc]e
spl-1.0|3|sun|sun public licen[sc]e( (v|version )?1 0)?
qpl-1.0|3|q|q public licen[sc]e( (v|version )?1 0)?
w3c|3|w3c|w3c( software)?( and document)?( notice and)? licen[sc]e
w3c|1|w3c|w3c software notice and license
openssl|1|project|this product includes software developed by the openssl project
openssl|3|openssl|openssl licen[sc]e
ssleay|1|young|this product includes cryptographic software written by eric young
curl|3|curl|curl licen[sc]e
icu|3|icu|icu licen[sc]e
unicode-dfs|3|unicode|unicode (inc )?licen[sc]e agreement( data files and software)?
unicode-3.0|2|unicode|unicode licen[sc]e (v|version )?3( 0)?
postgresql|3|postgresql|postgresql licen[sc]e
vim|3|vim|vim licen[sc]e
tcl|3|tcl|tcl tk licen[sc]e
beerware|1|beer|if we meet some day and you think this stuff is worth it you can buy me a beer in return
beerware|3|beerware|(the )?beerware licen[sc]e
json|1|good|the software shall be used for good not evil
json|3|json|json licen[sc]e
latex-lppl-1.3|2|project|latex project public license (v|version )?1 3[abc]?
latex-lppl|3|project|latex project public licen[sc]e
latex-lppl|4|lppl|lppl( v?1 [0123][abc]?)?
imagemagick|3|imagemagick|imagemagick licen[sc]e
ijg|1|independent|this software is based in part on the work of the independent jpeg group
freetype|3|freetype|freetype (project )?licen[sc]e
zope-2.1|2|zope|zope public license( zpl)? (v|version )?2 1
zope|3|zope|zope public licen[sc]e
sleepycat|3|sleepycat|sleepycat (public )?licen[sc]e
sspl-1.0|2|server|server side public license (v|version )?1( 0)?
sspl|3|server|server side public licen[sc]e
busl-1.1|2|business|business source license (v|version )?1 1
busl|3|business|business source licen[sc]e
elastic-2.0|2|elastic|elastic license (v|version )?2( 0)?
elastic|3|elastic|elastic licen[sc]e
commons-clause|2|commons|commons clause( license condition)?( v?1 0)?
polyform-nc|2|polyform|polyform noncommercial licen[sc]e( 1 0 0)?
polyform-small|2|polyform|polyform small business licen[sc]e( 1 0 0)?
polyform|3|polyform|polyform( [a-z]+)? licen[sc]e
rail-openrail-m|2|openrail|(creativeml |bigscience )?openrail (m|\+\+ m)( licen[sc]e)?
rail|3|rail|(responsible ai |bigscience )?rail licen[sc]e( (v|version )?1 0)?
llama-community|3|community|llama ?[234]?( [123])? community licen[sc]e( agreement)?
hippocratic|3|hippocratic|hippocratic licen[sc]e( (v|version )?[123]( [01])?)?
mulan-2.0|2|mulan|mulan permissive software license (v|version )?2
mulan|3|mulan|mulan (permissive software|psl)( licen[sc]e)?
anti-996|3|anti|anti 996 licen[sc]e( (v|version )?1 0)?
upl-1.0|3|permissive|universal permissive licen[sc]e( (v|version )?1 0)?
blueoak-1.0|3|blue|blue oak model licen[sc]e( 1 0 0)?
free-art-1.3|3|art|free art licen[sc]e( 1 3)?
dsl|3|science|design science licen[sc]e
opl-1.0|3|publication|open publication licen[sc]e( (v|version )?1 0)?
oclc-2.0|3|research|oclc research public licen[sc]e( 2 0)?
reciprocal-1.5|3|reciprocal|reciprocal public licen[sc]e( (v|version )?1 [15])?
ricoh|3|ricoh|ricoh source code public licen[sc]e
nokia|3|nokia|nokia open source licen[sc]e
intel|3|intel|intel open source licen[sc]e
cua-opl|3|office|cua office public licen[sc]e
lucent-1.02|3|lucent|lucent public licen[sc]e( (v|version )?1 0 ?2?)?
motosoto|3|motosoto|motosoto (open source )?licen[sc]e
naumen|3|naumen|naumen public licen[sc]e
nethack|3|nethack|nethack general public licen[sc]e
realnetworks|3|realnetworks|realnetworks public source licen[sc]e
sybase|3|sybase|sybase open watcom public licen[sc]e
vovida|3|vovida|vovida software licen[sc]e
watcom|3|watcom|open watcom public licen[sc]e
xnet|3|net|x net licen[sc]e
spdx-mit|1|spdx|spdx license identifier mit
spdx-apache-2.0|1|spdx|spdx license identifier apache 2 0
spdx-gpl-2.0|1|spdx|spdx license identifier gpl 2 0( only| or later)?
spdx-gpl-3.0|1|spdx|spdx license identifier gpl 3 0( only| or later)?
spdx-bsd|1|spdx|spdx license identifier bsd [0-4] clause
spdx|1|spdx|spdx license identifier [a-z0-9]+( [0-9]+){0,3}( (only|or later|clause))?
proprietary|1|reserved|copyright (c )?[0-9]{4}( [0-9]{4})? (\S+ ){1,12}?all rights reserved
proprietary|1|proprietary|(confidential and proprietary|proprietary and confidential)
proprietary|1|permission|no part of this (publication|work|document|book) may be reproduced (\S+ ){1,20}?without the prior written permission
proprietary|1|unauthorized|unauthorized (copying|use|reproduction|distribution)( or [a-z]+)? of this (file|material|software|document)( via any medium)? is strictly prohibited
proprietary|4|reserved|all rights reserved
copyright-notice|4|copyright|copyright (c )?[0-9]{4}( [0-9]{4})?
commercial|3|commercial|commercial license (agreement|available)
eula|3|user|end user licen[sc]e agreement
freeware|4|freeware|(this (program|software) is )?freeware
shareware|4|shareware|(this (program|software) is )?shareware
dual-license|2|dual|dual licen[sc]ed( under (the )?)?
permissive-notice|2|see|see the license for the specific language governing permissions and limitations
warranty-disclaimer|4|without|without warrant(y|ies)( or conditions)? of any kind
warranty-disclaimer|4|merchantability|implied warrant(y|ies) of merchantability( or| and) fitness for a particular purpose
license-file|4|see|see (the )?(accompanying )?license file( for (details|more information))?
license-file|4|full|for the full license( text)?
"""

#: Confidence of a detection by its priority.
CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.75, 4: 0.5}
#: (label, priority, keywords, regex), in order.
RULES = tuple((a, int(b), tuple(c.split(",")), d) for a, b, c, d in (line.split("|", 3) for line in RULES_TEXT.strip().splitlines()))
