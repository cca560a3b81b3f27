"""Signature rules for license texts, in order of priority.

A line is ``label strength keyword pattern``. The pattern is a row of words: ``a|b`` is either word, a word
with ``?`` may be missing, other regular-expression syntax applies inside one word. A rule is only tried
where its keyword occurs, so every match has to hold it: a whole word, one of several (``a|b``), or the
beginning of a word (``a*``). Earlier lines win where two rules find the same words.
"""

RULES = """
lgpl 1.0 lesser gnu? lesser general public license|licence version? v?[0-9]+ [0-9]? or? later?
lgpl 1.0 library gnu? library general public license|licence version? v?[0-9]+
lgpl 0.9 lesser gnu? lesser general public license|licence
lgpl 0.9 library gnu? library general public license|licence
lgpl 0.9 lgpl gnu? lgpl version? v?[0-9]+ [0-9]? or? later?
lgpl 0.8 lgpl* lgplv?[0-9]+
lgpl 0.7 lgpl lgpl
agpl 1.0 affero gnu? affero general public license|licence version? v?[0-9]+ or? later?
agpl 0.9 affero gnu? affero general public license|licence
agpl 0.9 agpl gnu? agpl version? v?[0-9]+ or? later?
agpl 0.8 agpl* agplv?[0-9]+
agpl 0.7 agpl agpl
affero 0.8 affero affero license|licence
gpl 1.0 general gnu general public license|licence version v?[0-9]+ or later
gpl 1.0 general gnu general public license|licence either? version v?[0-9]+
gpl 1.0 general gnu general public license|licence v[0-9]+
gpl 0.95 general gnu general public license|licence
gpl 0.9 general general public license|licence
gpl 0.9 gpl gnu? gpl version? v?[0-9]+ or? later?
gpl 0.8 gplv* gplv[0-9]+
gpl 0.8 gpl licensed under the? gnu? gpl
gpl 0.6 gpl gnu gpl
gpl 0.5 gpl gpl license|licence|licensed
gfdl 1.0 documentation gnu? free documentation license|licence version? [0-9]? [0-9]?
gfdl 0.8 gfdl gfdl
gcc-exception 0.9 exception gcc runtime library exception
classpath-exception 0.9 classpath gnu? classpath exception
linking-exception 0.8 exception linking exception
gnu-all-permissive 0.8 permissive gnu all permissive license|licence
mit 1.0 mit released|licensed|distributed|available|published under the? terms? of? the? mit license|licence
mit 1.0 charge permission is hereby granted free of charge to any person obtaining a copy
mit 0.95 mit the mit license|licence
mit 0.9 mit mit license|licence
mit 0.9 mit mit licensed
mit 0.8 mit license|licence mit
mit 0.8 mit x11 mit
mit 0.8 mit expat mit
mit-0 0.95 mit mit no attribution license|licence?
mit-0 0.95 mit mit 0
x11 0.9 x11 x11 license|licence
expat 0.9 expat expat license|licence
apache-2.0 1.0 apache licensed|released|distributed under the? apache license|licence version? 2 0?
apache-2.0 1.0 apache apache software? license|licence version? v?2 0?
apache-2.0 0.9 apache apache 2 0? license|licence?
apache-2.0 0.9 apache apache license|licence v2
apache-1.1 0.95 apache apache software? license|licence version? 1 1
apache-1.0 0.95 apache apache software? license|licence version? 1 0
apache 0.8 apache apache software? license|licence
apache 0.7 apache licensed under apache
apache 0.7 apache apache software foundation
bsd-2-clause 1.0 bsd bsd 2 clause license|licence?
bsd-2-clause 1.0 bsd 2 clause bsd license|licence?
bsd-2-clause 1.0 bsd simplified bsd license|licence
bsd-2-clause 1.0 freebsd freebsd license|licence
bsd-2-clause 0.9 bsd two clause bsd license|licence?
bsd-3-clause 1.0 bsd bsd 3 clause license|licence?
bsd-3-clause 1.0 bsd 3 clause bsd license|licence?
bsd-3-clause 1.0 bsd new bsd license|licence
bsd-3-clause 1.0 bsd modified bsd license|licence
bsd-3-clause 1.0 bsd revised bsd license|licence
bsd-3-clause 0.9 bsd three clause bsd license|licence?
bsd-3-clause 0.9 endorse may be used to endorse or promote products derived from
bsd-4-clause 1.0 bsd bsd 4 clause license|licence?
bsd-4-clause 1.0 bsd 4 clause bsd license|licence?
bsd-4-clause 0.9 bsd original bsd license|licence
bsd-4-clause 0.9 advertising all advertising materials mentioning features
bsd-0-clause 1.0 bsd zero clause bsd license|licence?
bsd-0-clause 1.0 0bsd 0bsd
bsd 1.0 redistribution redistribution and use in source and binary forms with or without modification
bsd 0.9 bsd licensed|released under the? bsd license|licence
bsd 0.8 bsd bsd style license|licence
bsd 0.8 bsd bsd license|licence
bsd 0.7 bsd bsd licensed
bsd 0.7 redistributions redistributions of source code must retain
bsd 0.7 redistributions redistributions in binary form must reproduce
isc 1.0 isc isc license|licence
isc 0.9 copy permission to use copy modify and or distribute this software
isc 0.8 consortium internet systems consortium isc?
mpl-2.0 1.0 mozilla mozilla public license|licence version? v?2 0?
mpl-2.0 0.9 mpl mpl v?2 0?
mpl-1.1 1.0 mozilla mozilla public license|licence version? v?1 1
mpl-1.1 0.9 mpl mpl v?1 1
mpl-1.0 1.0 mozilla mozilla public license|licence version? v?1 0
mpl 0.9 mozilla mozilla public license|licence
mpl 0.7 mpl mpl license|licence|licensed
npl 0.9 netscape netscape public license|licence version? [0-9]? [0-9]?
epl-2.0 1.0 eclipse eclipse public license|licence version? v?2 0?
epl-2.0 0.9 epl epl v?2 0?
epl-1.0 1.0 eclipse eclipse public license|licence version? v?1 0?
epl-1.0 0.9 epl epl v?1 0?
epl 0.9 eclipse eclipse public license|licence
edl 0.9 eclipse eclipse distribution license|licence version? [0-9]? [0-9]?
cpl 0.9 common common public license|licence version? [0-9]? [0-9]?
ipl 0.9 ibm ibm public license|licence version? [0-9]? [0-9]?
cddl 1.0 cddl cddl version? [0-9]? [0-9]?
cddl 1.0 development common development and distribution license|licence version? [0-9]? [0-9]?
eupl 1.0 european european union public license|licence version? [0-9]? [0-9]?
eupl 0.9 eupl eupl v?[0-9]? [0-9]?
cecill 0.9 cecill cecill [abc]? free? software? license|licence? agreement?
cecill 0.9 cecill licence cecill
ms-pl 1.0 microsoft microsoft public license|licence
ms-rl 1.0 microsoft microsoft reciprocal license|licence
ms-eula 0.9 microsoft microsoft software license|licence terms
artistic-2.0 1.0 artistic artistic license|licence version? 2 0?
artistic-1.0 1.0 artistic artistic license|licence version? 1 0?
artistic 0.9 artistic artistic license|licence
perl 0.8 perl same terms as perl itself?
python 1.0 python python software foundation license|licence version? [0-9]?
python 0.9 python python license|licence
python 0.9 psf psf license|licence agreement?
ruby 0.9 ruby ruby license|licence
php 0.9 php php license|licence version? [0-9]? [0-9]+?
zlib 1.0 zlib zlib libpng license|licence
zlib 0.9 zlib zlib license|licence
zlib 0.9 altered altered source versions must be plainly marked
libpng 0.9 libpng libpng license|licence version? [0-9]?
boost 1.0 boost boost software license|licence version? [0-9]? [0-9]?
boost 0.9 bsl bsl 1 0
unlicense 1.0 unlicense the unlicense
unlicense 0.9 unencumbered free and unencumbered software released into the public domain
unlicense 0.7 unlicense unlicense
wtfpl 1.0 wtfpl wtfpl version? [0-9]?
beerware 1.0 beerware beerware license|licence?
beerware 1.0 beer beer ware license|licence?
postgresql 1.0 postgresql postgresql license|licence
openssl 1.0 openssl openssl license|licence
openssl 0.8 ssleay original ssleay license|licence
curl 0.9 curl curl license|licence
vim 0.9 vim vim license|licence
tcl 0.9 tcl tcl tk? license|licence
sleepycat 0.9 sleepycat sleepycat license|licence
ncsa 1.0 ncsa university? of? illinois? ncsa open source license|licence
w3c 0.9 w3c w3c software notice? and? document? license|licence
ofl 1.0 sil sil open font license|licence version? [0-9]? [0-9]?
ofl 0.9 ofl ofl [0-9]? [0-9]?
ofl 0.8 font open font license|licence
upl 1.0 universal universal permissive license|licence v?[0-9]? [0-9]?
academic-free 1.0 academic academic free license|licence version? v?[0-9]? [0-9]?
open-software 1.0 open open software license|licence version? v?[0-9]? [0-9]?
sissl 0.9 sun sun industry standards source license|licence
bcl 0.9 binary sun? oracle? binary code license|licence agreement?
otn 0.9 oracle oracle technology network license|licence agreement?
jrl 0.8 java java research license|licence
bsl 1.0 business business source license|licence version? [0-9]? [0-9]?
sspl 1.0 server server side public license|licence version? v?[0-9]?
sspl 0.9 sspl sspl v?[0-9]?
elastic 1.0 elastic elastic license|licence version? v?[0-9]? [0-9]?
commons-clause 1.0 commons commons clause license|licence? condition?
polyform 0.9 polyform polyform noncommercial|shield|strict|perimeter license|licence?
blue-oak 1.0 oak blue oak model license|licence version? [0-9]?
mulan 1.0 mulan mulan permissive|public software? license|licence v?[0-9]?
openldap 0.9 openldap openldap public license|licence version? [0-9]?
qpl 0.9 q q public license|licence
lppl 1.0 latex latex project public license|licence version? [0-9]? [0-9]?
lppl 0.9 lppl lppl v?[0-9]? [0-9]?
afl 0.8 afl afl v?[0-9] [0-9]
fair 0.8 fair fair license|licence
nasa 0.9 nasa nasa open source agreement
json 0.9 evil shall be used for good not evil
cern-ohl 0.9 cern cern open hardware license|licence
odbl 1.0 database open database license|licence v?[0-9]? [0-9]?
odbl 0.9 odbl odbl v?[0-9]? [0-9]?
odc-by 1.0 attribution open data commons attribution license|licence
pddl 1.0 public public domain dedication and license|licence
pddl 0.9 commons open data commons public domain dedication
cdla 0.9 community community data license|licence agreement permissive|sharing version? [0-9]? [0-9]?
ogl 1.0 government open government license|licence v?[0-9]? [0-9]?
ogl 0.8 ogl ogl v?[0-9] [0-9]?
openrail 1.0 openrail openrail [ms]? license|licence?
openrail 0.9 responsible responsible ai license|licence
cc0 1.0 cc0 cc0 [0-9]? [0-9]? universal?
cc0 1.0 zero creative commons zero v?[0-9]? [0-9]?
cc0 0.9 zero cc zero
cc-by-nc-nd 1.0 cc cc by nc nd [0-9]? [0-9]?
cc-by-nc-nd 1.0 attribution attribution noncommercial noderivatives|noderivs [0-9]? [0-9]?
cc-by-nc-nd 1.0 attribution attribution non commercial no derivatives|derivs [0-9]? [0-9]?
cc-by-nc-sa 1.0 cc cc by nc sa [0-9]? [0-9]?
cc-by-nc-sa 1.0 attribution attribution noncommercial sharealike [0-9]? [0-9]?
cc-by-nc-sa 1.0 attribution attribution non commercial share alike [0-9]? [0-9]?
cc-by-nc 1.0 cc cc by nc [0-9]? [0-9]?
cc-by-nc 1.0 attribution attribution noncommercial [0-9]? [0-9]? international?
cc-by-nc 1.0 attribution attribution non commercial [0-9]? [0-9]? international?
cc-by-sa 1.0 cc cc by sa [0-9]? [0-9]?
cc-by-sa 1.0 attribution attribution sharealike [0-9]? [0-9]? international?
cc-by-sa 1.0 attribution attribution share alike [0-9]? [0-9]? international?
cc-by-nd 1.0 cc cc by nd [0-9]? [0-9]?
cc-by-nd 1.0 attribution attribution noderivatives|noderivs [0-9]? [0-9]? international?
cc-by-nd 1.0 attribution attribution no derivatives|derivs [0-9]? [0-9]? international?
cc-by 1.0 cc cc by [0-9] [0-9]
cc-by 0.9 cc cc by
cc-by 1.0 creative creative commons attribution [0-9]? [0-9]? international? license|licence?
cc-by 0.9 ccby ccby
cc 0.8 creative creative commons license|licence
cc 0.7 creative creative commons
public-domain 0.9 domain dedicated to the public domain
public-domain 0.9 domain released into the public domain
public-domain 0.9 domain placed in the public domain
public-domain 0.7 domain in the public domain
public-domain 0.5 domain public domain
reserved 0.9 reserved copyright c? [0-9]+? all rights reserved
reserved 0.8 reserved all rights reserved
reserved 0.8 droits tous droits réservés
reserved 0.8 vorbehalten alle rechte vorbehalten
reserved 0.8 reservados todos los derechos reservados
reserved 0.6 reserved some rights reserved
proprietary 0.9 proprietary proprietary and confidential
proprietary 0.8 proprietary proprietary software|license|licence
proprietary 0.8 reproduced no part of this publication|document|work may be reproduced
proprietary 0.7 written without prior written consent|permission
commercial 0.7 commercial commercial license|licence required?
non-commercial 0.7 commercial for non commercial use only
non-commercial 0.7 noncommercial for noncommercial use only
educational 0.6 educational for educational purposes only
shareware 0.6 shareware shareware
freeware 0.6 freeware freeware
eula 0.9 end end user license|licence agreement
no-warranty 0.6 warranty without warranty of any kind
no-warranty 0.6 warranties without warranties or conditions of any kind
no-warranty 0.6 warranty without any warranty
no-warranty 0.6 warranty disclaimer of warranty
no-warranty 0.5 provided is provided as is
liability 0.5 event in no event shall the? authors?|copyright holders? be? liable?
license-text 0.6 copy you may obtain a copy of the license|licence at
license-text 0.6 licensed this file|work|software|program|document|project is licensed
license-text 0.6 license|licence see the license|licence file? for
license-text 0.5 license|licence subject to the terms of the license|licence
license-text 0.5 license|licence license|licence agreement
license-text 0.4 licensed licensed under
license-text 0.4 terms under the terms of
copyright 0.5 copyright copyright c? [0-9]{4}
copyright 0.4 copyright copyright holder|holders|owner|owners
copyright 0.4 notice copyright notice
trademark 0.4 trademark registered? trademark of
trademark 0.4 trademarks trademarks of
patent 0.4 patent patent license|licence|grant
spdx 0.9 spdx spdx license identifier
attribution 0.4 attribution attribution required
copyleft 0.6 copyleft copyleft
dual 0.6 dual dual licensed?
open-source 0.5 source open source license|licence
free-software 0.5 free free software license|licence|foundation
""".strip().splitlines()


def compiled() -> list[tuple[int, str, float, str, str]]:
    """(priority, label, strength, keyword, regular expression) per rule; every word of a text is `` word ``."""
    rules = []
    for priority, line in enumerate(RULES):
        label, strength, keyword, *words = line.split(" ")
        parts = []
        for word in words:
            optional = word.endswith("?")
            body = f" (?:{word.removesuffix('?')}) "
            parts.append(f"(?:{body})?" if optional else body)
        rules.append((priority, label, float(strength), keyword, "".join(parts)))
    return rules
