"""Licence signatures, in order of priority: the first line is the strongest.

A line is ``label :: keyword :: expression`` over lower-case text.  The keyword is a
string that every match holds.  In an expression a blank stands for a gap (one or
more characters that are no part of a word), ``(?: `` for a group that begins with
one, and ``licen[sc]e`` for both spellings.  Lines that name a version stand before
those that name the family, and longer versions before their beginnings.
"""

from __future__ import annotations

SIGNATURES = r"""
0bsd :: spdx :: spdx license identifier 0bsd
afl-3.0 :: spdx :: spdx license identifier afl 3\.0
agpl-3.0 :: spdx :: spdx license identifier agpl 3\.0(?: only| or later)?
apache-1.1 :: spdx :: spdx license identifier apache 1\.1
apache-2.0 :: spdx :: spdx license identifier apache 2\.0
artistic-2.0 :: spdx :: spdx license identifier artistic 2\.0
bsd-2-clause :: spdx :: spdx license identifier bsd 2 clause
bsd-3-clause :: spdx :: spdx license identifier bsd 3 clause
bsd-4-clause :: spdx :: spdx license identifier bsd 4 clause
bsl-1.0 :: spdx :: spdx license identifier bsl 1\.0
busl-1.1 :: spdx :: spdx license identifier busl 1\.1
cc0-1.0 :: spdx :: spdx license identifier cc0 1\.0
cc-by-4.0 :: spdx :: spdx license identifier cc by 4\.0
cc-by-sa-4.0 :: spdx :: spdx license identifier cc by sa 4\.0
cddl-1.0 :: spdx :: spdx license identifier cddl 1\.0
cecill-2.1 :: spdx :: spdx license identifier cecill 2\.1
cpl-1.0 :: spdx :: spdx license identifier cpl 1\.0
ecl-2.0 :: spdx :: spdx license identifier ecl 2\.0
epl-1.0 :: spdx :: spdx license identifier epl 1\.0
epl-2.0 :: spdx :: spdx license identifier epl 2\.0
eupl-1.2 :: spdx :: spdx license identifier eupl 1\.2
gpl-2.0 :: spdx :: spdx license identifier gpl 2\.0(?: only| or later)?
gpl-3.0 :: spdx :: spdx license identifier gpl 3\.0(?: only| or later)?
isc :: spdx :: spdx license identifier isc
lgpl-2.0 :: spdx :: spdx license identifier lgpl 2\.0(?: only| or later)?
lgpl-2.1 :: spdx :: spdx license identifier lgpl 2\.1(?: only| or later)?
lgpl-3.0 :: spdx :: spdx license identifier lgpl 3\.0(?: only| or later)?
mit :: spdx :: spdx license identifier mit
mit-0 :: spdx :: spdx license identifier mit 0
mpl-1.1 :: spdx :: spdx license identifier mpl 1\.1
mpl-2.0 :: spdx :: spdx license identifier mpl 2\.0
ms-pl :: spdx :: spdx license identifier ms pl
ms-rl :: spdx :: spdx license identifier ms rl
ncsa :: spdx :: spdx license identifier ncsa
ofl-1.1 :: spdx :: spdx license identifier ofl 1\.1
osl-3.0 :: spdx :: spdx license identifier osl 3\.0
postgresql :: spdx :: spdx license identifier postgresql
python-2.0 :: spdx :: spdx license identifier python 2\.0
unlicense :: spdx :: spdx license identifier unlicense
upl-1.0 :: spdx :: spdx license identifier upl 1\.0
wtfpl :: spdx :: spdx license identifier wtfpl
zlib :: spdx :: spdx license identifier zlib
agpl-3 :: affero :: (?:gnu )?affero general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version | v ?| )3(?:\.0)?
agpl-1 :: affero :: affero general public licen[sc]e(?: version | v ?| )1(?:\.0)?
agpl-3 :: agpl :: (?:gnu )?agpl(?: version)? ?v?3(?:\.0)?
agpl :: affero :: (?:gnu )?affero general public licen[sc]e
agpl :: affero :: affero gpl
agpl :: agpl :: (?:gnu )?agpl
lgpl-2.1 :: general :: (?:gnu )?(?:lesser|library) general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version | v ?| )2\.1
lgpl-2 :: general :: (?:gnu )?(?:lesser|library) general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version | v ?| )2(?:\.0)?
lgpl-3 :: general :: (?:gnu )?(?:lesser|library) general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version | v ?| )3(?:\.0)?
lgpl-2.1 :: lgpl :: (?:gnu )?lgpl(?: version)? ?v?2\.1
lgpl-3 :: lgpl :: (?:gnu )?lgpl(?: version)? ?v?3(?:\.0)?
lgpl-2 :: lgpl :: (?:gnu )?lgpl(?: version)? ?v?2(?:\.0)?
lgpl :: general :: (?:gnu )?lesser general public licen[sc]e
lgpl :: general :: (?:gnu )?library general public licen[sc]e
lgpl :: lgpl :: (?:gnu )?lgpl
gfdl-1.1 :: documentation :: (?:gnu )?free documentation licen[sc]e(?: version | v ?| )1\.1
gfdl-1.2 :: documentation :: (?:gnu )?free documentation licen[sc]e(?: version | v ?| )1\.2
gfdl-1.3 :: documentation :: (?:gnu )?free documentation licen[sc]e(?: version | v ?| )1\.3
gfdl :: documentation :: (?:gnu )?free documentation licen[sc]e
gfdl :: gfdl :: gnu gfdl
gpl-2-classpath :: classpath :: general public licen[sc]e(?: version)? 2(?:\.0)? with(?: the)?(?: gnu)? classpath exception
gpl-3 :: general :: (?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version | v ?| )3(?:\.0)?
gpl-2 :: general :: (?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version | v ?| )2(?:\.0)?
gpl-1 :: general :: (?:gnu )?general public licen[sc]e(?: version | v ?| )1(?:\.0)?
gpl-3 :: gpl :: (?:gnu )?gpl(?: version)? ?v?3(?:\.0)?
gpl-2 :: gpl :: (?:gnu )?gpl(?: version)? ?v?2(?:\.0)?
gpl :: general :: (?:gnu )?general public licen[sc]e
gpl :: redistribute :: this program is free software you can redistribute it and or modify
gpl :: warranty :: this program comes with absolutely no warranty
gpl :: gnu :: you should have received a copy of the gnu general public licen[sc]e
gpl :: gpl :: gnu gpl
gpl-exception :: gcc :: gcc runtime library exception
apache-2 :: apache :: apache(?: software)? licen[sc]e(?: version | v ?| )2(?:\.0)?
apache-1.1 :: apache :: apache(?: software)? licen[sc]e(?: version | v ?| )1\.1
apache-1 :: apache :: apache(?: software)? licen[sc]e(?: version | v ?| )1(?:\.0)?
apache-2 :: apache :: apache\.org licen[sc]es license 2\.0
apache-2 :: apache :: licensed under(?: the)? apache 2(?:\.0)?
apache-2 :: limitations :: see the license for the specific language governing permissions and limitations
apache-2 :: compliance :: you may not use this file except in compliance with the license
apache :: apache :: licensed to the apache software foundation
apache :: apache :: apache software licen[sc]e
apache :: apache :: apache licen[sc]e
apache :: apache :: under the terms of the apache
mit-0 :: attribution :: mit no attribution
mit :: granted :: permission is hereby granted free of charge to any person obtaining a copy
mit :: merge :: to use copy modify merge publish distribute sublicense and or sell copies
mit :: substantial :: shall be included in all copies or substantial portions of the software
mit :: noninfringement :: fitness for a particular purpose and noninfringement
mit :: mit :: mit expat licen[sc]e
mit :: expat :: expat licen[sc]e
mit :: mit :: mit x11 licen[sc]e
mit :: mit :: mit style licen[sc]e
mit :: mit :: (?:the )?mit licen[sc]e
mit :: mit :: licen[sc]ed under(?: the)?(?: terms of the)? mit
mit :: mit :: released under(?: the)?(?: terms of the)? mit
x11 :: x11 :: x11 licen[sc]e
x11 :: consortium :: x consortium shall not be used in advertising
mit-cmu :: advertising :: in advertising or publicity pertaining to distribution of the software
isc :: distribute :: permission to use copy modify and or distribute this software for any purpose
isc :: isc :: (?:the )?isc licen[sc]e
isc :: internet :: internet software consortium licen[sc]e
bsd-4-clause :: advertising :: all advertising materials mentioning features or use of this software
bsd-3-clause :: endorse :: may be used to endorse or promote products derived from this software
bsd-2-clause :: bsd :: (?:simplified|freebsd) bsd licen[sc]e
bsd-2-clause :: bsd :: (?:2|two) clause bsd(?: licen[sc]e)?
bsd-2-clause :: bsd :: bsd 2 clause(?: licen[sc]e)?
bsd-3-clause :: bsd :: (?:new|modified|revised) bsd licen[sc]e
bsd-3-clause :: bsd :: (?:3|three) clause bsd(?: licen[sc]e)?
bsd-3-clause :: bsd :: bsd 3 clause(?: licen[sc]e)?
bsd-4-clause :: bsd :: (?:original|old) bsd licen[sc]e
bsd-4-clause :: bsd :: (?:4|four) clause bsd(?: licen[sc]e)?
bsd-4-clause :: bsd :: bsd 4 clause(?: licen[sc]e)?
0bsd :: bsd :: (?:zero|0) clause bsd
bsd :: source :: redistribution and use in source and binary forms
bsd :: redistributions :: redistributions of source code must retain the above copyright notice
bsd :: redistributions :: redistributions in binary form must reproduce the above copyright notice
bsd :: bsd :: bsd style licen[sc]e
bsd :: bsd :: bsd licen[sc]e
bsd :: berkeley :: berkeley software distribution licen[sc]e
mpl-2 :: mozilla :: mozilla public licen[sc]e(?: version | v ?| )2(?:\.0)?
mpl-1.1 :: mozilla :: mozilla public licen[sc]e(?: version | v ?| )1\.1
mpl-1 :: mozilla :: mozilla public licen[sc]e(?: version | v ?| )1(?:\.0)?
mpl-2 :: mozilla :: mozilla\.org mpl 2\.0
mpl-2 :: source :: this source code form is subject to the terms of the mozilla public licen[sc]e
mpl-1.1 :: mozilla :: contents of this file are subject to the mozilla public licen[sc]e
mpl :: mozilla :: mozilla public licen[sc]e
npl :: netscape :: netscape public licen[sc]e
epl-2 :: eclipse :: eclipse public licen[sc]e(?: version | v ?| )2(?:\.0)?
epl-1 :: eclipse :: eclipse public licen[sc]e(?: version | v ?| )1(?:\.0)?
epl :: eclipse :: eclipse public licen[sc]e
edl :: eclipse :: eclipse distribution licen[sc]e
cddl-1.1 :: distribution :: common development and distribution licen[sc]e(?: version | v ?| )1\.1
cddl-1 :: distribution :: common development and distribution licen[sc]e(?: version | v ?| )1(?:\.0)?
cddl :: distribution :: common development and distribution licen[sc]e
cpl-1 :: common :: common public licen[sc]e(?: version | v ?| )1(?:\.0)?
cpl :: common :: common public licen[sc]e
cpal :: attribution :: common public attribution licen[sc]e
ibm-pl :: ibm :: ibm public licen[sc]e
artistic-2 :: artistic :: artistic licen[sc]e(?: version | v ?| )2(?:\.0)?
artistic-1 :: artistic :: artistic licen[sc]e(?: version | v ?| )1(?:\.0)?
artistic :: artistic :: (?:clarified )?artistic licen[sc]e
perl :: perl :: under the same terms as perl itself
bsl-1 :: boost :: boost software licen[sc]e(?: version | v ?| )1(?:\.0)?
bsl :: boost :: boost software licen[sc]e
busl-1.1 :: business :: business source licen[sc]e(?: version | v ?| )1\.1
busl :: business :: business source licen[sc]e
sspl-1 :: server :: server side public licen[sc]e(?: version | v ?| )1(?:\.0)?
sspl :: server :: server side public licen[sc]e
elastic-2 :: elastic :: elastic licen[sc]e(?: version | v ?| )2(?:\.0)?
elastic :: elastic :: elastic licen[sc]e
zlib :: implied :: this software is provided as is without any express or implied warranty
zlib :: misrepresented :: the origin of this software must not be misrepresented
zlib :: zlib :: zlib libpng licen[sc]e
zlib :: zlib :: zlib licen[sc]e
libpng :: libpng :: libpng licen[sc]e
ijg :: jpeg :: independent jpeg group licen[sc]e
ijg :: jpeg :: based in part on the work of the independent jpeg group
freetype :: freetype :: freetype(?: project)? licen[sc]e
python-2 :: python :: python software foundation licen[sc]e(?: version | v ?| )2(?:\.0)?
python :: python :: python software foundation licen[sc]e
python :: psf :: psf licen[sc]e
php-3.01 :: php :: php licen[sc]e(?: version | v ?| )3\.01
php-3 :: php :: php licen[sc]e(?: version | v ?| )3(?:\.0)?
php :: php :: php licen[sc]e
ruby :: ruby :: ruby licen[sc]e
ruby :: ruby :: under the same terms as ruby
ofl-1.1 :: font :: (?:sil )?open font licen[sc]e(?: version | v ?| )1\.1
ofl-1 :: font :: (?:sil )?open font licen[sc]e(?: version | v ?| )1(?:\.0)?
ofl :: font :: (?:sil )?open font licen[sc]e
eupl-1.2 :: union :: european union public licen[sc]e(?: version | v ?| )1\.2
eupl-1.1 :: union :: european union public licen[sc]e(?: version | v ?| )1\.1
eupl-1 :: union :: european union public licen[sc]e(?: version | v ?| )1(?:\.0)?
eupl :: union :: european union public licen[sc]e
osl-3 :: open :: open software licen[sc]e(?: version | v ?| )3(?:\.0)?
osl-2.1 :: open :: open software licen[sc]e(?: version | v ?| )2\.1
osl-2 :: open :: open software licen[sc]e(?: version | v ?| )2(?:\.0)?
osl :: open :: open software licen[sc]e
afl-3 :: academic :: academic free licen[sc]e(?: version | v ?| )3(?:\.0)?
afl-2.1 :: academic :: academic free licen[sc]e(?: version | v ?| )2\.1
afl-2 :: academic :: academic free licen[sc]e(?: version | v ?| )2(?:\.0)?
afl :: academic :: academic free licen[sc]e
ecl-2 :: educational :: educational community licen[sc]e(?: version | v ?| )2(?:\.0)?
ecl :: educational :: educational community licen[sc]e
ms-pl :: microsoft :: microsoft public licen[sc]e
ms-rl :: microsoft :: microsoft reciprocal licen[sc]e
ms-limited :: microsoft :: microsoft limited public licen[sc]e
cecill-2.1 :: cecill :: cecill(?: free software)? licen[sc]e(?: agreement)?(?: version | v ?| )2\.1
cecill-2 :: cecill :: cecill(?: free software)? licen[sc]e(?: agreement)?(?: version | v ?| )2(?:\.0)?
cecill-b :: cecill :: cecill b(?: free software)? licen[sc]e
cecill-c :: cecill :: cecill c(?: free software)? licen[sc]e
cecill :: cecill :: cecill(?: free software)? licen[sc]e
ncsa :: ncsa :: (?:university of illinois )?ncsa open source licen[sc]e
sleepycat :: sleepycat :: sleepycat licen[sc]e
vim :: vim :: vim licen[sc]e
postgresql :: postgresql :: postgresql licen[sc]e
openssl :: openssl :: openssl licen[sc]e
openssl :: openssl :: this product includes software developed by the openssl project
ssleay :: ssleay :: original ssleay licen[sc]e
curl :: curl :: curl licen[sc]e
upl-1 :: universal :: universal permissive licen[sc]e(?: version | v ?| )1(?:\.0)?
upl :: universal :: universal permissive licen[sc]e
odbl-1 :: database :: open database licen[sc]e(?: version | v ?| )1(?:\.0)?
odbl :: database :: open database licen[sc]e
odc-by :: commons :: open data commons attribution licen[sc]e
pddl :: dedication :: public domain dedication and licen[sc]e
json :: good :: the software shall be used for good not evil
json :: json :: json licen[sc]e
beerware :: beer :: beer ware licen[sc]e
beerware :: beer :: you can buy me a beer in return
wtfpl :: want :: do what the fuck you want to public licen[sc]e
wtfpl :: wtfpl :: wtfpl(?: licen[sc]e)?
unlicense :: unencumbered :: free and unencumbered software released into the public domain
unlicense :: unlicense :: the unlicense
w3c :: w3c :: w3c software(?: notice and)? licen[sc]e
unicode :: unicode :: unicode licen[sc]e agreement
nasa :: nasa :: nasa open source agreement
intel :: intel :: intel open source licen[sc]e
qpl :: public :: q public licen[sc]e
apsl :: apple :: apple public source licen[sc]e
sun :: sun :: sun industry standards source licen[sc]e
reciprocal :: reciprocal :: reciprocal public licen[sc]e
zope :: zope :: zope public licen[sc]e
tcl :: tcl :: tcl tk licen[sc]e
mulan :: mulan :: mulan permissive software licen[sc]e
blue-oak :: oak :: blue oak model licen[sc]e
openldap :: openldap :: openldap public licen[sc]e
lppl :: latex :: latex project public licen[sc]e
hippocratic :: hippocratic :: hippocratic licen[sc]e
polyform :: polyform :: polyform (?:noncommercial|small business|shield|strict) licen[sc]e
commons-clause :: commons :: commons clause licen[sc]e condition
cc-by-nc-sa-4.0 :: cc :: cc by nc sa 4\.0
cc-by-nc-sa-3.0 :: cc :: cc by nc sa 3\.0
cc-by-nc-sa-2.5 :: cc :: cc by nc sa 2\.5
cc-by-nc-sa-2.0 :: cc :: cc by nc sa 2\.0
cc-by-nc-nd-4.0 :: cc :: cc by nc nd 4\.0
cc-by-nc-nd-3.0 :: cc :: cc by nc nd 3\.0
cc-by-nc-nd-2.0 :: cc :: cc by nc nd 2\.0
cc-by-nc-4.0 :: cc :: cc by nc 4\.0
cc-by-nc-3.0 :: cc :: cc by nc 3\.0
cc-by-nc-2.0 :: cc :: cc by nc 2\.0
cc-by-sa-4.0 :: cc :: cc by sa 4\.0
cc-by-sa-3.0 :: cc :: cc by sa 3\.0
cc-by-sa-2.5 :: cc :: cc by sa 2\.5
cc-by-sa-2.0 :: cc :: cc by sa 2\.0
cc-by-nd-4.0 :: cc :: cc by nd 4\.0
cc-by-nd-3.0 :: cc :: cc by nd 3\.0
cc-by-4.0 :: cc :: cc by 4\.0
cc-by-3.0 :: cc :: cc by 3\.0
cc-by-2.5 :: cc :: cc by 2\.5
cc-by-2.0 :: cc :: cc by 2\.0
cc-by-nc-sa :: cc :: cc by nc sa
cc-by-nc-nd :: cc :: cc by nc nd
cc-by-nc :: cc :: cc by nc
cc-by-sa :: cc :: cc by sa
cc-by-nd :: cc :: cc by nd
cc-by :: cc :: cc by
cc-by-nc-sa :: creativecommons :: creativecommons\.org licenses by nc sa
cc-by-nc-nd :: creativecommons :: creativecommons\.org licenses by nc nd
cc-by-nc :: creativecommons :: creativecommons\.org licenses by nc
cc-by-sa :: creativecommons :: creativecommons\.org licenses by sa
cc-by-nd :: creativecommons :: creativecommons\.org licenses by nd
cc-by :: creativecommons :: creativecommons\.org licenses by
cc0-1.0 :: creativecommons :: creativecommons\.org publicdomain zero 1\.0
cc0-1.0 :: cc0 :: cc0 1\.0(?: universal)?
cc0-1.0 :: cc0 :: cc0
cc-by-nc-sa :: commons :: creative commons attribution noncommercial sharealike
cc-by-nc-nd :: commons :: creative commons attribution noncommercial noderiv(?:ative)?s
cc-by-nc :: commons :: creative commons attribution noncommercial
cc-by-sa :: commons :: creative commons attribution sharealike
cc-by-nd :: commons :: creative commons attribution noderiv(?:ative)?s
cc-by :: commons :: creative commons attribution
cc :: commons :: creative commons licen[sc]e
cc :: commons :: creative commons
public-domain :: domain :: (?:placed in|dedicated to|released into|in) the public domain
public-domain :: domain :: public domain mark
proprietary :: rights :: all rights reserved
proprietary :: proprietary :: proprietary and confidential
proprietary :: confidential :: confidential and proprietary
proprietary :: unauthorized :: unauthorized copying of this file
proprietary :: permission :: without the prior written permission of
source-available :: evaluation :: for evaluation purposes only
source-available :: commercial :: for non commercial use only
permission :: permission :: used with permission
permission :: permission :: reprinted by permission
"""

#: Every match holds one of these, or "cc" and "by" as words next to each other.
ROOTS = """
licen spdx gpl gfdl permission redistribut warranty gcc apache attribution substantial noninfringement released
consortium advertising endorse bsd mozilla perl ruby misrepresented jpeg openssl evil beer wtfpl unencumbered nasa
creative cc0 domain reserved proprietary unauthorized evaluation commercial
""".split()
