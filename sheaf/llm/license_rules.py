"""Signature rules for licences, in order: licence; priority; keywords, one of which the lower-cased text must have; pattern.

A space in a pattern stands for any white space.  Patterns ignore ASCII case.  Priorities: 90 words of a licence's own text,
80 machine-readable tags, 70 addresses, 60 a name with its version, 50 a name that means one version, 40 a name without a
version, 20 a general notice.
"""

TABLE = r"""
Apache-2.0; 90; apache license; licensed under the apache license,? version 2\.0 \(the "?license"?\)
Apache-2.0; 90; terms and conditions for use, reproduction; apache license version 2\.0, january 2004.{0,80}?terms and conditions for use, reproduction
Apache-2.0; 80; spdx; spdx-license-identifier: *apache-2\.0\b
Apache-1.1; 80; spdx; spdx-license-identifier: *apache-1\.1\b
Apache-1.0; 80; spdx; spdx-license-identifier: *apache-1\.0\b
Apache-2.0; 70; apache.org; https?://(?:www\.)?apache\.org/licenses/license-2\.0
Apache-1.1; 70; apache.org; https?://(?:www\.)?apache\.org/licenses/license-1\.1
Apache-1.0; 70; apache.org; https?://(?:www\.)?apache\.org/licenses/license-1\.0
Apache-2.0; 60; apache; \bapache(?: software)? licen[sc]e,?(?: \(?(?:version|v\.?))? ?2(?:\.0)?\b\)?
Apache-2.0; 60; apache; \bapache[- ]?2(?:\.0)?(?: licen[sc]e)?\b
Apache-2.0; 60; asl; \basl[- ]2\.0\b
Apache-1.1; 60; apache; \bapache(?: software)? licen[sc]e,?(?: version| v)? ?1\.1\b
Apache-1.0; 60; apache; \bapache(?: software)? licen[sc]e,?(?: version| v)? ?1\.0\b
Apache; 40; apache; \b(?:under|by) the apache(?: software)? licen[sc]e\b
MIT; 90; permission is hereby granted; permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the "software"\), to deal
MIT; 90; the above copyright notice and this permission notice; the above copyright notice and this permission notice shall be included in all copies or substantial portions
MIT-0; 90; permission is hereby granted; permission is hereby granted, free of charge.{0,400}?without limitation the rights to use.{0,160}?permit persons to whom the software is furnished to do so\. the software is provided
MIT; 80; spdx; spdx-license-identifier: *mit\b(?!-)
MIT-0; 80; spdx; spdx-license-identifier: *mit-0\b
MIT; 70; opensource.org; https?://(?:www\.)?opensource\.org/licenses?/mit(?:-license)?(?:\.php|\.html)?\b
MIT; 70; mit-license; https?://mit-license\.org\b
MIT; 60; mit; \b(?:released|licensed|distributed|available|provided) (?:under|with|by) (?:the )?(?:terms of (?:the )?)?mit(?:/x11)? licen[sc]e\b
MIT; 50; mit; \bmit(?:/x11| style| open source)? licen[sc]e\b
MIT; 50; mit; \blicen[sc]ed? *[:=] *"?mit\b
MIT; 50; expat; \bexpat licen[sc]e\b
X11; 80; spdx; spdx-license-identifier: *x11\b
X11; 90; x consortium; except as contained in this notice, the name of the x consortium shall not be used
X11; 50; x11; \bx11 licen[sc]e\b
BSD-3-Clause; 90; neither the name; neither the name of .{1,120}? nor the names of (?:its|their|the) contributors may be used to endorse or promote products
BSD-4-Clause; 90; advertising materials; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
BSD-2-Clause; 90; redistribution and use in source and binary; redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
BSD-3-Clause; 80; spdx; spdx-license-identifier: *bsd-3-clause\b(?!-)
BSD-2-Clause; 80; spdx; spdx-license-identifier: *bsd-2-clause\b(?!-)
BSD-2-Clause-Patent; 80; spdx; spdx-license-identifier: *bsd-2-clause-patent\b
BSD-3-Clause-Clear; 80; spdx; spdx-license-identifier: *bsd-3-clause-clear\b
BSD-4-Clause; 80; spdx; spdx-license-identifier: *bsd-4-clause\b
0BSD; 80; spdx; spdx-license-identifier: *0bsd\b
BSD-3-Clause; 70; opensource.org; https?://(?:www\.)?opensource\.org/licenses?/bsd-3-clause\b
BSD-2-Clause; 70; opensource.org; https?://(?:www\.)?opensource\.org/licenses?/bsd-2-clause\b
BSD; 70; opensource.org; https?://(?:www\.)?opensource\.org/licenses?/bsd-license\b
BSD-3-Clause; 60; bsd; \b(?:3|three)[- ]clause (?:"?modified"? )?bsd\b
BSD-3-Clause; 60; bsd; \b(?:new|modified|revised) bsd(?: licen[sc]e)?\b
BSD-3-Clause; 60; bsd; \bbsd[- ](?:3|three)[- ]clause\b
BSD-2-Clause; 60; bsd; \b(?:2|two)[- ]clause (?:simplified )?bsd\b
BSD-2-Clause; 60; bsd; \b(?:simplified|freebsd) bsd? ?licen[sc]e\b
BSD-2-Clause; 60; bsd; \bbsd[- ](?:2|two)[- ]clause\b
BSD-4-Clause; 60; bsd; \b(?:4|four)[- ]clause bsd\b
BSD-4-Clause; 60; bsd; \b(?:original|old) bsd licen[sc]e\b
0BSD; 60; bsd; \b(?:0|zero)[- ]clause bsd\b
0BSD; 90; with or without fee is hereby granted; permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software is provided
BSD; 40; bsd; \bbsd(?:[- ]style)? licen[sc]e\b
ISC; 90; with or without fee is hereby granted; permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
ISC; 80; spdx; spdx-license-identifier: *isc\b
ISC; 70; opensource.org; https?://(?:www\.)?opensource\.org/licenses?/isc\b
ISC; 50; isc; \bisc licen[sc]e\b
GPL-3.0; 90; gnu general public license; gnu general public license version 3, 29 june 2007
GPL-2.0; 90; gnu general public license; gnu general public license version 2, june 1991
GPL-1.0; 90; gnu general public license; gnu general public license version 1, february 1989
GPL-3.0-or-later; 90; gnu general public license; under the terms of the gnu general public license as published by the free software foundation[,;] either version 3 of the license, or \(at your option\) any later version
GPL-2.0-or-later; 90; gnu general public license; under the terms of the gnu general public license as published by the free software foundation[,;] either version 2 of the license, or \(at your option\) any later version
GPL-1.0-or-later; 90; gnu general public license; under the terms of the gnu general public license as published by the free software foundation[,;] either version 1,? or \(at your option\) any later version
GPL-2.0-only; 90; gnu general public license; under the terms of the gnu general public license version 2(?:,)? as published by the free software foundation
GPL-3.0-only; 90; gnu general public license; under the terms of the gnu general public license version 3(?:,)? as published by the free software foundation
GPL-3.0-or-later; 80; spdx; spdx-license-identifier: *gpl-3\.0(?:-or-later|\+)
GPL-3.0-only; 80; spdx; spdx-license-identifier: *gpl-3\.0(?:-only)?\b(?!-or|\+)
GPL-2.0-or-later; 80; spdx; spdx-license-identifier: *gpl-2\.0(?:-or-later|\+)
GPL-2.0-only; 80; spdx; spdx-license-identifier: *gpl-2\.0(?:-only)?\b(?!-or|\+)
GPL-1.0-or-later; 80; spdx; spdx-license-identifier: *gpl-1\.0(?:-or-later|\+)
GPL-1.0-only; 80; spdx; spdx-license-identifier: *gpl-1\.0(?:-only)?\b(?!-or|\+)
GPL-3.0; 70; gnu.org; https?://(?:www\.)?gnu\.org/licenses/gpl-3\.0
GPL-2.0; 70; gnu.org; https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
GPL-1.0; 70; gnu.org; https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0
GPL; 70; gnu.org; https?://(?:www\.)?gnu\.org/(?:licenses|copyleft)/gpl(?:\.html|\.txt)?\b(?!-)
GPL-3.0-or-later; 60; general public license; \b(?:gnu )?general public license,?(?: version| v)? ?3(?:\.0)?,? (?:or|and) (?:\(at your option\) )?(?:any )?(?:later|newer)
GPL-2.0-or-later; 60; general public license; \b(?:gnu )?general public license,?(?: version| v)? ?2(?:\.0)?,? (?:or|and) (?:\(at your option\) )?(?:any )?(?:later|newer)
GPL-3.0; 60; general public license; \b(?:gnu )?(?<!lesser )(?<!affero )(?<!library )general public licen[sc]e,?(?: \(?(?:version|v\.?))? ?3(?:\.0)?\b
GPL-2.0; 60; general public license; \b(?:gnu )?(?<!lesser )(?<!affero )(?<!library )general public licen[sc]e,?(?: \(?(?:version|v\.?))? ?2(?:\.0)?\b(?!\.1)
GPL-1.0; 60; general public license; \b(?:gnu )?(?<!lesser )(?<!affero )(?<!library )general public licen[sc]e,?(?: \(?(?:version|v\.?))? ?1(?:\.0)?\b
GPL-3.0-or-later; 60; gpl; (?<![a-z])gpl[- ]?(?:v|version )?\.?3(?:\.0)?(?:\+| or later)
GPL-2.0-or-later; 60; gpl; (?<![a-z])gpl[- ]?(?:v|version )?\.?2(?:\.0)?(?:\+| or later)
GPL-3.0; 60; gpl; (?<![a-z])gpl[- ]?(?:v|version )?\.?3(?:\.0)?\b
GPL-2.0; 60; gpl; (?<![a-z])gpl[- ]?(?:v|version )?\.?2(?:\.0)?\b
GPL; 40; general public license; \bgnu general public licen[sc]e\b
GPL; 40; gpl; \b(?:under|by) the (?:gnu )?gpl\b
LGPL-3.0; 90; lesser general public license; gnu lesser general public license version 3, 29 june 2007
LGPL-2.1; 90; lesser general public license; gnu lesser general public license version 2\.1, february 1999
LGPL-2.0; 90; library general public license; gnu library general public license version 2, june 1991
LGPL-2.1-or-later; 90; lesser general public license; under the terms of the gnu lesser general public license as published by the free software foundation[,;] either version 2\.1 of the license, or \(at your option\) any later version
LGPL-3.0-or-later; 90; lesser general public license; under the terms of the gnu lesser general public license as published by the free software foundation[,;] either version 3(?:\.0)? of the license, or \(at your option\) any later version
LGPL-2.0-or-later; 90; library general public license; under the terms of the gnu library general public license as published by the free software foundation[,;] either version 2 of the license, or \(at your option\) any later version
LGPL-3.0-or-later; 80; spdx; spdx-license-identifier: *lgpl-3\.0(?:-or-later|\+)
LGPL-3.0-only; 80; spdx; spdx-license-identifier: *lgpl-3\.0(?:-only)?\b(?!-or|\+)
LGPL-2.1-or-later; 80; spdx; spdx-license-identifier: *lgpl-2\.1(?:-or-later|\+)
LGPL-2.1-only; 80; spdx; spdx-license-identifier: *lgpl-2\.1(?:-only)?\b(?!-or|\+)
LGPL-2.0-or-later; 80; spdx; spdx-license-identifier: *lgpl-2\.0(?:-or-later|\+)
LGPL-2.0-only; 80; spdx; spdx-license-identifier: *lgpl-2\.0(?:-only)?\b(?!-or|\+)
LGPL-3.0; 70; gnu.org; https?://(?:www\.)?gnu\.org/licenses/lgpl-3\.0
LGPL-2.1; 70; gnu.org; https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
LGPL; 70; gnu.org; https?://(?:www\.)?gnu\.org/(?:licenses|copyleft)/lesser(?:\.html)?\b
LGPL-3.0; 60; lesser general public; \blesser general public licen[sc]e,?(?: \(?(?:version|v\.?))? ?3(?:\.0)?\b
LGPL-2.1; 60; lesser general public; \blesser general public licen[sc]e,?(?: \(?(?:version|v\.?))? ?2\.1\b
LGPL-2.0; 60; library general public; \blibrary general public licen[sc]e,?(?: \(?(?:version|v\.?))? ?2(?:\.0)?\b
LGPL-3.0; 60; lgpl; \blgpl[- ]?(?:v|version )?\.?3(?:\.0)?\b
LGPL-2.1; 60; lgpl; \blgpl[- ]?(?:v|version )?\.?2\.1\b
LGPL-2.0; 60; lgpl; \blgpl[- ]?(?:v|version )?\.?2(?:\.0)?\b(?!\.1)
LGPL; 40; lesser general public; \blesser general public licen[sc]e\b
LGPL; 40; lgpl; \b(?:under|by) the (?:gnu )?lgpl\b
AGPL-3.0; 90; affero general public; gnu affero general public license version 3, 19 november 2007
AGPL-3.0-or-later; 90; affero general public; under the terms of the gnu affero general public license as published by the free software foundation[,;] either version 3 of the license, or \(at your option\) any later version
AGPL-3.0-or-later; 80; spdx; spdx-license-identifier: *agpl-3\.0(?:-or-later|\+)
AGPL-3.0-only; 80; spdx; spdx-license-identifier: *agpl-3\.0(?:-only)?\b(?!-or|\+)
AGPL-1.0; 80; spdx; spdx-license-identifier: *agpl-1\.0
AGPL-3.0; 70; gnu.org; https?://(?:www\.)?gnu\.org/licenses/agpl-3\.0
AGPL-3.0; 60; affero general public; \baffero general public licen[sc]e,?(?: \(?(?:version|v\.?))? ?3(?:\.0)?\b
AGPL-3.0; 60; agpl; \bagpl[- ]?(?:v|version )?\.?3(?:\.0)?\b
AGPL-1.0; 60; affero general public; \baffero general public licen[sc]e,?(?: version| v)? ?1(?:\.0)?\b
AGPL; 40; affero; \b(?:gnu )?affero general public licen[sc]e\b
GFDL-1.3; 80; spdx; spdx-license-identifier: *gfdl-1\.3
GFDL-1.2; 80; spdx; spdx-license-identifier: *gfdl-1\.2
GFDL-1.1; 80; spdx; spdx-license-identifier: *gfdl-1\.1
GFDL-1.3; 60; free documentation license; \bgnu free documentation licen[sc]e,?(?: version| v)? ?1\.3\b
GFDL-1.2; 60; free documentation license; \bgnu free documentation licen[sc]e,?(?: version| v)? ?1\.2\b
GFDL-1.1; 60; free documentation license; \bgnu free documentation licen[sc]e,?(?: version| v)? ?1\.1\b
GFDL; 40; free documentation license; \bgnu free documentation licen[sc]e\b
GFDL; 70; gnu.org; https?://(?:www\.)?gnu\.org/(?:licenses|copyleft)/fdl
MPL-2.0; 90; mozilla public; this source code form is subject to the terms of the mozilla public license, v\. ?2\.0
MPL-1.1; 90; mozilla public; the contents of this file are subject to the mozilla public license version 1\.1
MPL-1.0; 90; mozilla public; the contents of this file are subject to the mozilla public license version 1\.0
MPL-2.0; 80; spdx; spdx-license-identifier: *mpl-2\.0\b(?!-no)
MPL-2.0-no-copyleft-exception; 80; spdx; spdx-license-identifier: *mpl-2\.0-no-copyleft-exception
MPL-1.1; 80; spdx; spdx-license-identifier: *mpl-1\.1\b
MPL-1.0; 80; spdx; spdx-license-identifier: *mpl-1\.0\b
MPL-2.0; 70; mozilla.org; https?://(?:www\.)?mozilla\.org/(?:en-us/)?mpl/2\.0
MPL-1.1; 70; mozilla.org; https?://(?:www\.)?mozilla\.org/mpl/(?:mpl-)?1\.1
MPL-2.0; 60; mozilla public; \bmozilla public licen[sc]e,?(?: \(?(?:version|v\.?))? ?2(?:\.0)?\b
MPL-1.1; 60; mozilla public; \bmozilla public licen[sc]e,?(?: \(?(?:version|v\.?))? ?1\.1\b
MPL-2.0; 60; mpl; \bmpl[- ]?(?:v|version )?\.?2(?:\.0)?\b
MPL-1.1; 60; mpl; \bmpl[- ]?(?:v|version )?\.?1\.1\b
MPL; 40; mozilla public; \bmozilla public licen[sc]e\b
EPL-2.0; 80; spdx; spdx-license-identifier: *epl-2\.0
EPL-1.0; 80; spdx; spdx-license-identifier: *epl-1\.0
EPL-2.0; 90; eclipse public; this program and the accompanying materials are made available under the terms of the eclipse public license (?:v\. ?|version )?2\.0
EPL-1.0; 90; eclipse public; this program and the accompanying materials are made available under the terms of the eclipse public license (?:v\. ?|version )?1\.0
EPL-2.0; 70; eclipse.org; https?://(?:www\.)?eclipse\.org/(?:legal/)?(?:org/documents/)?epl-(?:v20|2\.0)
EPL-1.0; 70; eclipse.org; https?://(?:www\.)?eclipse\.org/legal/epl-v10
EPL-2.0; 60; eclipse public; \beclipse public licen[sc]e,?(?: -)?(?: \(?(?:version|v\.?))? ?2(?:\.0)?\b
EPL-1.0; 60; eclipse public; \beclipse public licen[sc]e,?(?: -)?(?: \(?(?:version|v\.?))? ?1(?:\.0)?\b
EPL; 40; eclipse public; \beclipse public licen[sc]e\b
EDL-1.0; 60; eclipse distribution; \beclipse distribution licen[sc]e,?(?: version| v\.?)? ?1\.0\b
CDDL-1.0; 80; spdx; spdx-license-identifier: *cddl-1\.0
CDDL-1.1; 80; spdx; spdx-license-identifier: *cddl-1\.1
CDDL-1.0; 60; common development and distribution; \bcommon development and distribution licen[sc]e,?(?: \(cddl\))?,?(?: version| v\.?)? ?1\.0\b
CDDL-1.1; 60; common development and distribution; \bcommon development and distribution licen[sc]e,?(?: \(cddl\))?,?(?: version| v\.?)? ?1\.1\b
CDDL; 40; common development and distribution; \bcommon development and distribution licen[sc]e\b
CPL-1.0; 80; spdx; spdx-license-identifier: *cpl-1\.0
CPL-1.0; 50; common public license,common public licence; \bcommon public licen[sc]e(?:,? (?:version|v)? ?1\.0)?\b
IPL-1.0; 50; ibm public; \bibm public licen[sc]e(?:,? (?:version|v)? ?1\.0)?\b
CPAL-1.0; 50; common public attribution; \bcommon public attribution licen[sc]e\b
Artistic-2.0; 80; spdx; spdx-license-identifier: *artistic-2\.0
Artistic-1.0; 80; spdx; spdx-license-identifier: *artistic-1\.0
Artistic-2.0; 60; artistic license; \bartistic licen[sc]e,?(?: \(?(?:version|v\.?))? ?2(?:\.0)?\b
Artistic-1.0; 60; artistic license; \bartistic licen[sc]e,?(?: \(?(?:version|v\.?))? ?1(?:\.0)?\b
Artistic; 40; artistic license; \b(?:perl )?artistic licen[sc]e\b
Perl; 60; same terms as perl; \bunder the same terms as perl(?: itself| 5)?
Zlib; 90; altered source versions; altered source versions must be plainly marked as such, and must not be misrepresented as being the original software
Zlib; 80; spdx; spdx-license-identifier: *zlib\b(?!-)
Zlib; 70; zlib.net; https?://(?:www\.)?zlib\.net/zlib_license
Zlib; 50; zlib; \bzlib(?:/libpng)? licen[sc]e\b
libpng-2.0; 80; spdx; spdx-license-identifier: *libpng-2\.0
Libpng; 50; libpng; \blibpng licen[sc]e\b
BSL-1.0; 90; boost software; distributed under the boost software license, version 1\.0
BSL-1.0; 80; spdx; spdx-license-identifier: *bsl-1\.0
BSL-1.0; 70; boost.org; https?://(?:www\.)?boost\.org/license_1_0\.txt
BSL-1.0; 50; boost software; \bboost software licen[sc]e\b
BUSL-1.1; 80; spdx; spdx-license-identifier: *busl-1\.1
BUSL-1.1; 50; business source; \bbusiness source licen[sc]e(?: 1\.1)?\b
Unlicense; 90; free and unencumbered; this is free and unencumbered software released into the public domain
Unlicense; 80; spdx; spdx-license-identifier: *unlicense\b
Unlicense; 70; unlicense.org; https?://(?:www\.)?unlicense\.org\b
Unlicense; 50; unlicense; \bthe unlicense\b
WTFPL; 90; do what the fuck; do what the fuck you want to public license
WTFPL; 80; spdx; spdx-license-identifier: *wtfpl\b
WTFPL; 70; wtfpl.net; https?://(?:www\.)?wtfpl\.net\b
WTFPL; 50; wtfpl; \bwtfpl\b
Beerware; 90; buy me a beer; as long as you retain this notice you can do whatever you want with this stuff
Beerware; 50; beer-ware,beerware; \bbeer-?ware licen[sc]e\b
CC0-1.0; 90; cc0; creative commons legal code cc0 1\.0 universal
CC0-1.0; 80; spdx; spdx-license-identifier: *cc0-1\.0
CC0-1.0; 70; creativecommons.org; https?://(?:www\.)?creativecommons\.org/publicdomain/zero/1\.0
CC0-1.0; 60; cc0; \bcc0(?:[- ]1\.0)?(?: universal)?\b
CC-PDM-1.0; 70; creativecommons.org; https?://(?:www\.)?creativecommons\.org/publicdomain/mark/1\.0
CC-BY-4.0; 80; spdx; spdx-license-identifier: *cc-by-4\.0
CC-BY-SA-4.0; 80; spdx; spdx-license-identifier: *cc-by-sa-4\.0
CC-BY-NC-4.0; 80; spdx; spdx-license-identifier: *cc-by-nc-4\.0
CC-BY-ND-4.0; 80; spdx; spdx-license-identifier: *cc-by-nd-4\.0
CC-BY-NC-SA-4.0; 80; spdx; spdx-license-identifier: *cc-by-nc-sa-4\.0
CC-BY-NC-ND-4.0; 80; spdx; spdx-license-identifier: *cc-by-nc-nd-4\.0
CC-BY-3.0; 80; spdx; spdx-license-identifier: *cc-by-3\.0
CC-BY-SA-3.0; 80; spdx; spdx-license-identifier: *cc-by-sa-3\.0
CC-BY-4.0; 70; creativecommons.org; https?://(?:www\.)?creativecommons\.org/licenses/by/4\.0
CC-BY-SA-4.0; 70; creativecommons.org; https?://(?:www\.)?creativecommons\.org/licenses/by-sa/4\.0
CC-BY-NC-4.0; 70; creativecommons.org; https?://(?:www\.)?creativecommons\.org/licenses/by-nc/4\.0
CC-BY-ND-4.0; 70; creativecommons.org; https?://(?:www\.)?creativecommons\.org/licenses/by-nd/4\.0
CC-BY-NC-SA-4.0; 70; creativecommons.org; https?://(?:www\.)?creativecommons\.org/licenses/by-nc-sa/4\.0
CC-BY-NC-ND-4.0; 70; creativecommons.org; https?://(?:www\.)?creativecommons\.org/licenses/by-nc-nd/4\.0
CC-BY-3.0; 70; creativecommons.org; https?://(?:www\.)?creativecommons\.org/licenses/by/3\.0
CC-BY-SA-3.0; 70; creativecommons.org; https?://(?:www\.)?creativecommons\.org/licenses/by-sa/3\.0
CC-BY-NC-3.0; 70; creativecommons.org; https?://(?:www\.)?creativecommons\.org/licenses/by-nc/3\.0
CC-BY-ND-3.0; 70; creativecommons.org; https?://(?:www\.)?creativecommons\.org/licenses/by-nd/3\.0
CC-BY-NC-SA-3.0; 70; creativecommons.org; https?://(?:www\.)?creativecommons\.org/licenses/by-nc-sa/3\.0
CC-BY-NC-ND-3.0; 70; creativecommons.org; https?://(?:www\.)?creativecommons\.org/licenses/by-nc-nd/3\.0
CC-BY-2.0; 70; creativecommons.org; https?://(?:www\.)?creativecommons\.org/licenses/by/2\.0
CC-BY-SA-2.0; 70; creativecommons.org; https?://(?:www\.)?creativecommons\.org/licenses/by-sa/2\.0
CC-BY-2.5; 70; creativecommons.org; https?://(?:www\.)?creativecommons\.org/licenses/by/2\.5
CC-BY-SA-2.5; 70; creativecommons.org; https?://(?:www\.)?creativecommons\.org/licenses/by-sa/2\.5
CC-BY-4.0; 60; cc; \bcc[- ]by[- ]4\.0\b
CC-BY-SA-4.0; 60; cc; \bcc[- ]by[- ]sa[- ]4\.0\b
CC-BY-NC-4.0; 60; cc; \bcc[- ]by[- ]nc[- ]4\.0\b
CC-BY-ND-4.0; 60; cc; \bcc[- ]by[- ]nd[- ]4\.0\b
CC-BY-NC-SA-4.0; 60; cc; \bcc[- ]by[- ]nc[- ]sa[- ]4\.0\b
CC-BY-NC-ND-4.0; 60; cc; \bcc[- ]by[- ]nc[- ]nd[- ]4\.0\b
CC-BY-3.0; 60; cc; \bcc[- ]by[- ]3\.0\b
CC-BY-SA-3.0; 60; cc; \bcc[- ]by[- ]sa[- ]3\.0\b
CC-BY-NC-3.0; 60; cc; \bcc[- ]by[- ]nc[- ]3\.0\b
CC-BY-ND-3.0; 60; cc; \bcc[- ]by[- ]nd[- ]3\.0\b
CC-BY-NC-SA-3.0; 60; cc; \bcc[- ]by[- ]nc[- ]sa[- ]3\.0\b
CC-BY-NC-ND-3.0; 60; cc; \bcc[- ]by[- ]nc[- ]nd[- ]3\.0\b
CC-BY-4.0; 60; creative commons; \bcreative commons attribution 4\.0\b
CC-BY-SA-4.0; 60; creative commons; \bcreative commons attribution[- ]share[- ]?alike 4\.0\b
CC-BY-NC-4.0; 60; creative commons; \bcreative commons attribution[- ]non[- ]?commercial 4\.0\b
CC-BY-ND-4.0; 60; creative commons; \bcreative commons attribution[- ]no[- ]?deriv(?:s|atives) 4\.0\b
CC-BY-NC-SA-4.0; 60; creative commons; \bcreative commons attribution[- ]non[- ]?commercial[- ]share[- ]?alike 4\.0\b
CC-BY-NC-ND-4.0; 60; creative commons; \bcreative commons attribution[- ]non[- ]?commercial[- ]no[- ]?deriv(?:s|atives) 4\.0\b
CC-BY-3.0; 60; creative commons; \bcreative commons attribution 3\.0\b
CC-BY-SA-3.0; 60; creative commons; \bcreative commons attribution[- ]share[- ]?alike 3\.0\b
CC-BY-NC-SA; 50; cc; \bcc[- ]by[- ]nc[- ]sa\b
CC-BY-NC-ND; 50; cc; \bcc[- ]by[- ]nc[- ]nd\b
CC-BY-NC; 50; cc; \bcc[- ]by[- ]nc\b
CC-BY-SA; 50; cc; \bcc[- ]by[- ]sa\b
CC-BY-ND; 50; cc; \bcc[- ]by[- ]nd\b
CC-BY; 40; cc; \bcc[- ]by\b
CC; 40; creative commons; \bcreative commons(?: [a-z-]+){0,4} licen[sc]e\b
Python-2.0; 80; spdx; spdx-license-identifier: *python-2\.0
PSF-2.0; 80; spdx; spdx-license-identifier: *psf-2\.0
PSF-2.0; 50; python software foundation; \bpython software foundation licen[sc]e(?: version 2)?\b
Python; 50; python license,python licence; \bpython licen[sc]e(?: 2\.0)?\b
PHP-3.01; 60; php license,php licence; \bphp licen[sc]e,?(?: version| v)? ?3\.01\b
PHP-3.0; 60; php license,php licence; \bphp licen[sc]e,?(?: version| v)? ?3\.0\b
Ruby; 50; ruby license,ruby licence; \bruby licen[sc]e\b
OpenSSL; 90; openssl; this product includes software developed by the openssl project
OpenSSL; 50; openssl; \bopenssl licen[sc]e\b
SSLeay; 90; eric young; this product includes cryptographic software written by eric young
OFL-1.1; 90; open font; this font software is licensed under the sil open font license, version 1\.1
OFL-1.1; 80; spdx; spdx-license-identifier: *ofl-1\.1
OFL-1.1; 70; scripts.sil.org; https?://scripts\.sil\.org/ofl\b
OFL-1.1; 50; open font; \bsil open font licen[sc]e\b
EUPL-1.2; 80; spdx; spdx-license-identifier: *eupl-1\.2
EUPL-1.1; 80; spdx; spdx-license-identifier: *eupl-1\.1
EUPL-1.2; 60; eupl; \beupl,?(?: version| v\.?)? ?1\.2\b
EUPL-1.1; 60; eupl; \beupl,?(?: version| v\.?)? ?1\.1\b
EUPL; 40; european union public; \beuropean union public licen[sc]e\b
MS-PL; 80; spdx; spdx-license-identifier: *ms-pl\b
MS-PL; 50; microsoft public; \bmicrosoft public licen[sc]e\b
MS-RL; 50; microsoft reciprocal; \bmicrosoft reciprocal licen[sc]e\b
NCSA; 80; spdx; spdx-license-identifier: *ncsa\b
NCSA; 50; ncsa; \b(?:university of illinois/)?ncsa open source licen[sc]e\b
PostgreSQL; 80; spdx; spdx-license-identifier: *postgresql\b
PostgreSQL; 50; postgresql; \bpostgresql licen[sc]e\b
curl; 80; spdx; spdx-license-identifier: *curl\b
ICU; 50; icu license,icu licence; \bicu licen[sc]e\b
W3C; 80; spdx; spdx-license-identifier: *w3c\b
W3C; 50; w3c; \bw3c software(?: notice and)? licen[sc]e\b
AFL-3.0; 80; spdx; spdx-license-identifier: *afl-3\.0
AFL-3.0; 60; academic free; \bacademic free licen[sc]e,?(?: version| v\.?)? ?3\.0\b
AFL-2.1; 60; academic free; \bacademic free licen[sc]e,?(?: version| v\.?)? ?2\.1\b
AFL; 40; academic free; \bacademic free licen[sc]e\b
OSL-3.0; 60; open software license; \bopen software licen[sc]e,?(?: version| v\.?)? ?3\.0\b
OSL-3.0; 80; spdx; spdx-license-identifier: *osl-3\.0
OSL; 40; open software license; \bopen software licen[sc]e\b
ECL-2.0; 60; educational community; \beducational community licen[sc]e,?(?: version| v\.?)? ?2\.0\b
QPL-1.0; 50; q public; \bq public licen[sc]e\b
Sleepycat; 50; sleepycat; \bsleepycat licen[sc]e\b
Vim; 50; vim license,vim licence; \bvim licen[sc]e\b
JSON; 90; for good, not evil; the software shall be used for good, not evil
Elastic-2.0; 60; elastic license; \belastic licen[sc]e,?(?: version| v)? ?2(?:\.0)?\b
Elastic; 40; elastic license; \belastic licen[sc]e\b
SSPL-1.0; 80; spdx; spdx-license-identifier: *sspl-1\.0
SSPL-1.0; 50; server side public; \bserver side public licen[sc]e\b
Commons-Clause; 60; commons clause; \bcommons clause(?: licen[sc]e condition)?(?: v?1\.0)?\b
PolyForm-Noncommercial-1.0.0; 60; polyform; \bpolyform noncommercial licen[sc]e(?: 1\.0\.0)?\b
PolyForm-Small-Business-1.0.0; 60; polyform; \bpolyform small business licen[sc]e(?: 1\.0\.0)?\b
LPPL-1.3c; 60; latex project public; \blatex project public licen[sc]e,?(?: version| v)? ?1\.3c?\b
LPPL; 40; latex project public; \blatex project public licen[sc]e\b
NASA-1.3; 50; nasa open source; \bnasa open source agreement\b
APSL-2.0; 60; apple public source; \bapple public source licen[sc]e,?(?: version| v)? ?2\.0\b
APSL; 40; apple public source; \bapple public source licen[sc]e\b
RPL-1.5; 50; reciprocal public; \breciprocal public licen[sc]e(?: 1\.5)?\b
Watcom-1.0; 50; watcom; \bsybase open watcom public licen[sc]e\b
ZPL-2.1; 50; zope public; \bzope public licen[sc]e(?:,? \(?(?:zpl\) )?(?:version )?2\.1)?\b
NPL-1.1; 50; netscape public; \bnetscape public licen[sc]e\b
SPL-1.0; 50; sun public; \bsun public licen[sc]e\b
SISSL; 50; sun industry standards; \bsun industry standards source licen[sc]e\b
RPSL-1.0; 50; realnetworks public; \brealnetworks public source licen[sc]e\b
Motosoto; 50; motosoto; \bmotosoto open source licen[sc]e\b
MulanPSL-2.0; 60; mulan; \bmulan (?:psl|permissive software licen[sc]e),? ?(?:v|version )?2\b
ODbL-1.0; 60; open database; \bopen (?:data commons open )?database licen[sc]e\b
ODC-By-1.0; 60; open data commons; \bopen data commons attribution licen[sc]e\b
PDDL-1.0; 60; open data commons; \bopen data commons public domain dedication\b
Hippocratic-2.1; 50; hippocratic; \bhippocratic licen[sc]e(?: 2\.1)?\b
RAIL; 50; rail; \b(?:open|creativeml|bigscience)[- ](?:open )?rail(?:[- ]?m|\+\+-m)?(?: licen[sc]e)?\b
Llama; 50; community license; \bllama ?[0-9.]* community licen[sc]e(?: agreement)?\b
public-domain; 60; public domain; \b(?:released|placed|dedicated|put|is) (?:in|into|to) the public domain\b
proprietary; 60; proprietary; \bproprietary and confidential\b
all-rights-reserved; 20; all rights reserved; \ball rights reserved\b
spdx-expression; 20; spdx; spdx-license-identifier: *[a-z0-9.+-]+
unnamed-license; 20; licensed under; \blicensed under the [a-z][a-z0-9.+ -]{1,60}? licen[sc]e\b
see-license-file; 20; license,licence; \bsee (?:the )?(?:file )?licen[sc]e(?:\.txt|\.md)?(?: file)? for (?:full |more |license )?(?:details|terms|information)
copyright; 20; copyright; \bcopyright (?:\(c\)|©)? ?(?:19|20)[0-9]{2}(?:[-,] ?(?:19|20)[0-9]{2})*\b
"""
