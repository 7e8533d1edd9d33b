"""Signature rules of license texts, written for normalised words: lower case, one space between words.

A rule is (label, priority, keyword, regex). The keyword occurs literally in every text the regex matches. Regexes are
kept to literals, optional words and bounded gaps. Order counts: of equal detections the earlier rule's stays.
"""

from __future__ import annotations

TAG, NOTICE, NAME, HINT = 3, 2, 1, 0
#: What a detection of each priority is worth as evidence.
EVIDENCE = {TAG: 1.0, NOTICE: 0.95, NAME: 0.8, HINT: 0.5}

#: Phrases and labels that count as base detections.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Identifiers as they follow `SPDX-License-Identifier:`, in words, and the label each stands for.
TAGS = {
    "mit": "mit", "mit 0": "mit-0", "apache 2 0": "apache-2", "apache 1 1": "apache-1.1", "apache 1 0": "apache-1.0",
    "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "bsd 4 clause": "bsd-4", "bsd 3 clause clear": "bsd-3-clear", "0bsd": "0bsd", "isc": "isc",
    "gpl 1 0 only": "gpl-1", "gpl 2 0 only": "gpl-2", "gpl 2 0 or later": "gpl-2-or-later", "gpl 3 0 only": "gpl-3", "gpl 3 0 or later": "gpl-3-or-later",
    "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 0 only": "lgpl-2", "lgpl 2 1 only": "lgpl-2.1", "lgpl 2 1 or later": "lgpl-2.1-or-later",
    "lgpl 2 1": "lgpl-2.1", "lgpl 3 0 only": "lgpl-3", "lgpl 3 0 or later": "lgpl-3-or-later", "lgpl 3 0": "lgpl-3",
    "agpl 3 0 only": "agpl-3", "agpl 3 0 or later": "agpl-3-or-later", "agpl 3 0": "agpl-3", "gfdl 1 3 only": "gfdl-1.3", "gfdl 1 2 only": "gfdl-1.2",
    "mpl 1 0": "mpl-1.0", "mpl 1 1": "mpl-1.1", "mpl 2 0": "mpl-2.0", "epl 1 0": "epl-1.0", "epl 2 0": "epl-2.0", "cddl 1 0": "cddl-1.0", "cddl 1 1": "cddl-1.1",
    "cpl 1 0": "cpl-1.0", "ipl 1 0": "ipl-1.0", "eupl 1 1": "eupl-1.1", "eupl 1 2": "eupl-1.2", "cecill 2 1": "cecill-2.1", "cecill b": "cecill-b", "cecill c": "cecill-c",
    "cc0 1 0": "cc0", "cc by 1 0": "cc-by", "cc by 2 0": "cc-by", "cc by 2 5": "cc-by", "cc by 3 0": "cc-by", "cc by 4 0": "cc-by",
    "cc by sa 2 0": "cc-by-sa", "cc by sa 3 0": "cc-by-sa", "cc by sa 4 0": "cc-by-sa", "cc by nd 4 0": "cc-by-nd", "cc by nc 3 0": "cc-by-nc", "cc by nc 4 0": "cc-by-nc",
    "cc by nc sa 3 0": "cc-by-nc-sa", "cc by nc sa 4 0": "cc-by-nc-sa", "cc by nc nd 3 0": "cc-by-nc-nd", "cc by nc nd 4 0": "cc-by-nc-nd",
    "unlicense": "unlicense", "wtfpl": "wtfpl", "zlib": "zlib", "libpng": "libpng", "libpng 2 0": "libpng", "bsl 1 0": "boost-1.0", "busl 1 1": "busl-1.1", "sspl 1 0": "sspl-1.0",
    "elastic 2 0": "elastic-2.0", "artistic 1 0": "artistic-1.0", "artistic 2 0": "artistic-2.0", "python 2 0": "python-2.0", "psf 2 0": "psf-2.0",
    "php 3 01": "php-3.01", "ruby": "ruby", "ms pl": "ms-pl", "ms rl": "ms-rl", "ofl 1 0": "ofl-1.0", "ofl 1 1": "ofl-1.1", "odbl 1 0": "odbl-1.0", "odc by 1 0": "odc-by-1.0",
    "pddl 1 0": "pddl-1.0", "postgresql": "postgresql", "openssl": "openssl", "vim": "vim", "w3c": "w3c", "x11": "x11", "ncsa": "ncsa", "upl 1 0": "upl-1.0", "osl 3 0": "osl-3.0",
    "afl 3 0": "afl-3.0", "mulanpsl 2 0": "mulan-2.0", "blueoak 1 0 0": "blueoak-1.0", "polyform noncommercial 1 0 0": "polyform-nc", "hippocratic 2 1": "hippocratic",
    "curl": "curl", "ftl": "freetype", "ijg": "ijg", "icu": "icu", "bzip2 1 0 6": "bzip2", "tcl": "tcl", "sleepycat": "sleepycat", "zpl 2 1": "zope-2.1", "unicode 3 0": "unicode",
}

#: (label, keyword, notices, names): longer statements first, then names and addresses.
SIGNATURES = [
    ("mit", " mit ", [
        "(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e",
        "governed by (?:the )?mit(?: style)? licen[cs]e", "subject to the (?:terms of the )?mit licen[cs]e",
        "mit licen[cs]e (?:that can be |which can be )?found in the licen[cs]e file"],
     ["(?:the )?mit licen[cs]e", "opensource org licen[cs]es mit", "licen[cs]ed? mit", "mit licen[cs]ed", "mit expat licen[cs]e"]),
    ("mit", "permission is hereby granted free of charge", [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
        "(?: the software)? to deal in the software without restriction"], []),
    ("mit", " expat ", [], ["expat licen[cs]e"]),
    ("x11", " x11 ", [], ["x11 licen[cs]e", "mit x11(?: licen[cs]e)?"]),
    ("apache-2", "apache", [
        "licensed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e",
        "(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e(?: version)? v?2(?: 0)?"],
     ["apache(?: software)? licen[cs]e(?: version)? v?2(?: 0)?", "apache 2 0 licen[cs]e", "apache2 licen[cs]e", "apache org licen[cs]es licen[cs]e 2 0",
      "opensource org licen[cs]es apache 2 0", "licen[cs]ed? apache 2(?: 0)?"]),
    ("apache-1.1", "apache", [], ["apache(?: software)? licen[cs]e(?: version)? v?1 1", "apache org licen[cs]es licen[cs]e 1 1"]),
    ("apache-1.0", "apache", [], ["apache(?: software)? licen[cs]e(?: version)? v?1 0", "apache org licen[cs]es licen[cs]e 1 0"]),
    ("apache", "apache", ["licensed to the apache software foundation(?: asf)? under one or more contributor licen[cs]e agreements"], ["apache(?: software)? licen[cs]e", "apache style licen[cs]e"]),
    ("bsd", "redistribution and use in source and binary forms", [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"], []),
    ("bsd-4", "acknowledg", ["all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"], []),
    ("bsd-3", "endorse or promote", [
        "neither the names? of (?:[^ ]+ ){1,12}?nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software"], []),
    ("bsd-2", "bsd", [], ["(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: style)? licen[cs]e", "opensource org licen[cs]es bsd 2 clause"]),
    ("bsd-3", "bsd", ["use of this source code is governed by a (?:3 clause )?bsd style licen[cs]e"],
     ["(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: style)? licen[cs]e", "opensource org licen[cs]es bsd 3 clause"]),
    ("bsd-4", "bsd", [], ["(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: style)? licen[cs]e"]),
    ("0bsd", "bsd", [], ["(?:zero clause bsd|bsd zero clause|0 clause bsd)(?: licen[cs]e)?", "0bsd licen[cs]e"]),
    ("bsd", "bsd", ["(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the |a )?bsd(?: style)? licen[cs]e"], ["(?:the )?bsd(?: style)? licen[cs]e", "bsd licen[cs]ed"]),
    ("isc", " isc ", ["(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?isc licen[cs]e"], ["(?:the )?isc licen[cs]e", "opensource org licen[cs]es isc"]),
    ("isc", "with or without fee", [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"], []),
    ("gpl-3-or-later", "general public licen", [
        "gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version",
        "gnu general public licen[cs]e(?: as published by the free software foundation)? version 3 or (?:at your option )?(?:any )?later"], []),
    ("gpl-3-or-later", "gpl", [], ["(?:gnu )?gpl ?(?:v|version )?3(?: 0)? or (?:any )?later"]),
    ("gpl-2-or-later", "gpl", [], ["(?:gnu )?gpl ?(?:v|version )?2(?: 0)? or (?:any )?later"]),
    ("gpl-2-or-later", "general public licen", [
        "gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version",
        "gnu general public licen[cs]e(?: as published by the free software foundation)? version 2 or (?:at your option )?(?:any )?later"], []),
    ("gpl-3", "general public licen", [
        "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?gnu general public licen[cs]e v(?:ersion )?3(?: 0)?"],
     ["(?:gnu )?general public licen[cs]e v(?:ersion )?3(?: 0)?", "general public licen[cs]e gpl v(?:ersion )?3(?: 0)?"]),
    ("gpl-2", "general public licen", [
        "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?gnu general public licen[cs]e v(?:ersion )?2(?: 0)?"],
     ["(?:gnu )?general public licen[cs]e v(?:ersion )?2(?: 0)?", "general public licen[cs]e gpl v(?:ersion )?2(?: 0)?"]),
    ("gpl-1", "general public licen", [], ["gnu general public licen[cs]e v(?:ersion )?1(?: 0)?"]),
    ("gpl", "general public licen", [
        "you should have received a copy of the gnu general public licen[cs]e along with this (?:program|software|library|package)",
        "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?gnu general public licen[cs]e"],
     ["(?:the )?gnu general public licen[cs]e"]),
    ("gpl-3", "gpl", [], ["(?:gnu )?gpl ?(?:v|version )?3(?: 0)?(?: only| licen[cs]e)?", "gplv3", "gnu org licen[cs]es gpl 3 0", "opensource org licen[cs]es gpl 3 0"]),
    ("gpl-2", "gpl", [], ["(?:gnu )?gpl ?(?:v|version )?2(?: 0)?(?: only| licen[cs]e)?", "gplv2", "gnu org licen[cs]es (?:old licen[cs]es )?gpl 2 0", "opensource org licen[cs]es gpl 2 0"]),
    ("gpl", "gpl", ["(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl"], ["gnu gpl", "gnu org licen[cs]es gpl"]),
    ("lgpl-2.1-or-later", "lesser general public licen", [
        "gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e or at your option any later version"], []),
    ("lgpl-3-or-later", "lesser general public licen", [
        "gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version"], []),
    ("lgpl-3", "lesser general public licen", [], ["(?:gnu )?lesser general public licen[cs]e v(?:ersion )?3(?: 0)?"]),
    ("lgpl-2.1", "lesser general public licen", [], ["(?:gnu )?lesser general public licen[cs]e v(?:ersion )?2 1"]),
    ("lgpl", "lesser general public licen", [
        "you should have received a copy of the gnu lesser general public licen[cs]e along with this (?:program|software|library|package)"], ["(?:the )?gnu lesser general public licen[cs]e"]),
    ("lgpl-2", "library general public licen", [], ["(?:gnu )?library general public licen[cs]e(?: v(?:ersion )?2(?: 0)?)?"]),
    ("lgpl-3", "lgpl", [], ["(?:gnu )?lgpl ?(?:v|version )?3(?: 0)?", "lgplv3", "gnu org licen[cs]es lgpl 3 0"]),
    ("lgpl-2.1", "lgpl", [], ["(?:gnu )?lgpl ?(?:v|version )?2 1", "lgplv2 1", "gnu org licen[cs]es (?:old licen[cs]es )?lgpl 2 1"]),
    ("lgpl", "lgpl", ["(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl"], ["gnu lgpl"]),
    ("agpl-3-or-later", "affero", [
        "gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version"], []),
    ("agpl-3", "affero", [], ["(?:gnu )?affero general public licen[cs]e(?: v(?:ersion )?3(?: 0)?)?", "affero gpl(?: v?3)?"]),
    ("agpl-3", "agpl", ["(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agpl(?: ?v?3(?: 0)?)?"], ["(?:gnu )?agpl ?(?:v|version )?3(?: 0)?", "agplv3", "gnu org licen[cs]es agpl 3 0"]),
    ("gfdl", "free documentation licen", ["permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"],
     ["gnu free documentation licen[cs]e(?: version 1 [123])?"]),
    ("mpl-2.0", "mozilla public licen", ["this source code form is subject to the terms of the mozilla public licen[cs]e (?:version |v ?)2 0"], ["mozilla public licen[cs]e(?: mpl)?(?: version | v ?| )2 0"]),
    ("mpl-1.1", "mozilla public licen", ["the contents of this file are subject to the mozilla public licen[cs]e version 1 1"], ["mozilla public licen[cs]e(?: mpl)?(?: version | v ?| )1 1"]),
    ("mpl", "mozilla public licen", [], ["mozilla public licen[cs]e"]),
    ("mpl-2.0", " mpl ", [], ["mpl (?:v|version )?2 0", "mozilla org mpl 2 0"]),
    ("epl-2.0", "eclipse", ["made available under the terms of the eclipse public licen[cs]e (?:v ?)?2 0"], ["eclipse public licen[cs]e(?: version | v ?| )2 0", "eclipse org legal epl v20", "eclipse org legal epl 2 0"]),
    ("epl-1.0", "eclipse", ["made available under the terms of the eclipse public licen[cs]e (?:v ?)?1 0"], ["eclipse public licen[cs]e(?: version | v ?| )1 0", "eclipse org legal epl v10"]),
    ("epl", "eclipse", [], ["eclipse public licen[cs]e"]),
    ("edl-1.0", "eclipse", [], ["eclipse distribution licen[cs]e(?: (?:version |v ?)1 0)?"]),
    ("cddl", "common development and distribution licen", [], ["common development and distribution licen[cs]e(?: cddl)?(?: version 1 [01])?"]),
    ("cpl-1.0", "common public licen", [], ["common public licen[cs]e(?: version 1 0)?"]),
    ("cpal-1.0", "common public attribution", [], ["common public attribution licen[cs]e(?: version 1 0)?"]),
    ("ipl-1.0", "ibm public licen", [], ["ibm public licen[cs]e(?: version 1 0)?"]),
    ("eupl", "european union public licen", ["licensed under the european union public licen[cs]e"], ["european union public licen[cs]e(?: version 1 [012])?"]),
    ("eupl", " eupl ", [], ["(?:licensed under the )?eupl (?:v|version )?1 [012]"]),
    ("cecill", "cecill", [], ["cecill(?: [abc])?(?: v2(?: [01])?)? (?:free software )?licen[cs]e", "cecill info licen[cs]es"]),
    ("cc0", "cc0", ["(?:released|available|licensed|published) under (?:the )?(?:creative commons )?cc0"], ["cc0 (?:v?1 0|universal|licen[cs]e|public domain dedication)(?: universal)?"]),
    ("cc0", "creativecommons", [], ["creativecommons org publicdomain zero 1 0"]),
    ("cc-pdm", "creativecommons", [], ["creativecommons org publicdomain mark 1 0"]),
    ("cc-by-nc-nd", " cc by nc nd ", ["(?:licensed|released|available|published) under (?:an? |the )?(?:creative commons )?cc by nc nd(?: [1234] [05])?"], ["cc by nc nd(?: [1234] [05])?"]),
    ("cc-by-nc-sa", " cc by nc sa ", ["(?:licensed|released|available|published) under (?:an? |the )?(?:creative commons )?cc by nc sa(?: [1234] [05])?"], ["cc by nc sa(?: [1234] [05])?"]),
    ("cc-by-nc", " cc by nc ", ["(?:licensed|released|available|published) under (?:an? |the )?(?:creative commons )?cc by nc(?: [1234] [05])?"], ["cc by nc(?: [1234] [05])?"]),
    ("cc-by-nd", " cc by nd ", ["(?:licensed|released|available|published) under (?:an? |the )?(?:creative commons )?cc by nd(?: [1234] [05])?"], ["cc by nd(?: [1234] [05])?"]),
    ("cc-by-sa", " cc by sa ", ["(?:licensed|released|available|published) under (?:an? |the )?(?:creative commons )?cc by sa(?: [1234] [05])?"], ["cc by sa(?: [1234] [05])?"]),
    ("cc-by", " cc by ", ["(?:licensed|released|available|published) under (?:an? |the )?(?:creative commons )?cc by(?: [1234] [05])?"], ["cc by [1234] [05]", "cc by licen[cs]e"]),
    ("cc-by-nc-nd", "creative commons attribution", [], ["creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?"]),
    ("cc-by-nc-sa", "creative commons attribution", [], ["creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?"]),
    ("cc-by-nc", "creative commons attribution", [], ["creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?"]),
    ("cc-by-nd", "creative commons attribution", [], ["creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?"]),
    ("cc-by-sa", "creative commons attribution", [], ["creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?"]),
    ("cc-by", "creative commons attribution", [], ["creative commons attribution(?: [1234] [05])?(?: international| unported| generic)? licen[cs]e", "creative commons attribution [1234] [05]"]),
    ("cc-by-nc-nd", "creativecommons", [], ["creativecommons org licen[cs]es by nc nd(?: [1234] [05])?"]),
    ("cc-by-nc-sa", "creativecommons", [], ["creativecommons org licen[cs]es by nc sa(?: [1234] [05])?"]),
    ("cc-by-nc", "creativecommons", [], ["creativecommons org licen[cs]es by nc(?: [1234] [05])?"]),
    ("cc-by-nd", "creativecommons", [], ["creativecommons org licen[cs]es by nd(?: [1234] [05])?"]),
    ("cc-by-sa", "creativecommons", [], ["creativecommons org licen[cs]es by sa(?: [1234] [05])?"]),
    ("cc-by", "creativecommons", [], ["creativecommons org licen[cs]es by(?: [1234] [05])?"]),
    ("creative-commons", "creative commons licen", [], ["(?:under a |under the )?creative commons licen[cs]e"]),
    ("public-domain", "public domain", [
        "(?:released|dedicated|placed|donated|put|contributed) (?:in|into|to) the public domain", "free and unencumbered software released into the public domain",
        "(?:is|are) (?:hereby )?in the public domain", "no copyright is claimed and (?:[^ ]+ ){0,6}?public domain"], ["public domain dedication"]),
    ("unlicense", "unlicen", ["free and unencumbered software released into the public domain (?:[^ ]+ ){0,80}?unlicen[cs]e org"], ["the unlicen[cs]e", "unlicen[cs]e org"]),
    ("wtfpl", "what the fuck you want to", [], ["do what the fuck you want to public licen[cs]e(?: version 2)?"]),
    ("wtfpl", "wtfpl", [], ["wtfpl(?: version 2| v2)?(?: licen[cs]e)?"]),
    ("zlib", "zlib", [], ["(?:the )?zlib(?: libpng)? licen[cs]e", "opensource org licen[cs]es zlib"]),
    ("zlib", "in no event will the authors be held liable", ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"], []),
    ("libpng", "libpng", [], ["libpng licen[cs]e"]),
    ("boost-1.0", "boost", ["distributed under the boost software licen[cs]e version 1 0"], ["boost software licen[cs]e(?: version 1 0)?", "boost org licen[cs]e 1 0 txt"]),
    ("busl-1.1", "business source licen", [], ["business source licen[cs]e(?: 1 1)?"]),
    ("sspl-1.0", "server side public licen", [], ["server side public licen[cs]e(?: version 1)?"]),
    ("elastic-2.0", "elastic licen", ["subject to the elastic licen[cs]e(?: 2 0)?"], ["elastic licen[cs]e(?: v?2 0| 2 0)?"]),
    ("artistic-2.0", "artistic licen", [], ["artistic licen[cs]e (?:version )?2 0"]),
    ("artistic", "artistic licen", ["under the same terms as perl itself (?:[^ ]+ ){0,8}?artistic licen[cs]e"], ["(?:perl )?artistic licen[cs]e"]),
    ("perl", "same terms as perl", ["under the same terms as perl(?: itself| 5)?"], []),
    ("psf-2.0", "python software foundation", [], ["python software foundation licen[cs]e(?: version 2)?"]),
    ("php", "php licen", [], ["php licen[cs]e(?: version 3(?: 01| 0)?)?"]),
    ("ruby", "ruby", [], ["ruby licen[cs]e", "same terms as ruby"]),
    ("ms-pl", "microsoft public licen", [], ["microsoft public licen[cs]e(?: ms pl)?"]),
    ("ms-rl", "microsoft reciprocal licen", [], ["microsoft reciprocal licen[cs]e(?: ms rl)?"]),
    ("ofl-1.1", "open font licen", ["this font software is licensed under the sil open font licen[cs]e(?: version 1 1)?"], ["(?:sil )?open font licen[cs]e(?: version 1 1)?"]),
    ("odbl-1.0", "open database licen", ["made available under the open database licen[cs]e"], ["open database licen[cs]e(?: odbl)?(?: v?1 0)?"]),
    ("odbl-1.0", "opendatacommons", [], ["opendatacommons org licen[cs]es odbl(?: 1 0)?"]),
    ("odc-by-1.0", "open data commons attribution", [], ["open data commons attribution licen[cs]e(?: v?1 0)?"]),
    ("pddl-1.0", "public domain dedication and licen", [], ["(?:open data commons )?public domain dedication and licen[cs]e(?: pddl)?"]),
    ("dbcl-1.0", "database contents licen", [], ["database contents licen[cs]e(?: v?1 0)?"]),
    ("ogl-3.0", "open government licen", ["contains public sector information licensed under the open government licen[cs]e(?: v3 0)?"], ["open government licen[cs]e(?: v[123] 0)?"]),
    ("etalab-2.0", "licence ouverte", [], ["licence ouverte(?: open licen[cs]e)?(?: version 2 0)?"]),
    ("dl-de", "datenlizenz deutschland", [], ["datenlizenz deutschland (?:namensnennung|zero)(?: version)?(?: 2 0)?"]),
    ("cdla-permissive", "community data licen", [], ["community data licen[cs]e agreement permissive(?: version)?(?: [12] 0)?"]),
    ("cdla-sharing", "community data licen", [], ["community data licen[cs]e agreement sharing(?: version)?(?: 1 0)?"]),
    ("postgresql", "postgresql licen", [], ["postgresql licen[cs]e"]),
    ("openssl", "openssl", ["this product includes software developed by the openssl project"], ["openssl licen[cs]e"]),
    ("vim", "vim licen", [], ["vim licen[cs]e"]),
    ("w3c", "w3c", [], ["w3c (?:software|document)(?: notice)?(?: and)? licen[cs]e"]),
    ("ncsa", "illinois", [], ["university of illinois(?: ncsa)? open source licen[cs]e", "illinois open source licen[cs]e"]),
    ("upl-1.0", "universal permissive licen", [], ["universal permissive licen[cs]e(?: upl)?(?: (?:version |v ?)1 0)?"]),
    ("osl-3.0", "open software licen", ["licensed under the open software licen[cs]e version 3 0"], ["open software licen[cs]e(?: osl)?(?: version | v ?| )3 0"]),
    ("afl-3.0", "academic free licen", ["licensed under the academic free licen[cs]e version (?:2 1|3 0)"], ["academic free licen[cs]e(?: afl)?(?: version | v ?| )(?:2 1|3 0)"]),
    ("mulan-2.0", "mulan", [], ["mulan (?:psl|permissive software licen[cs]e)(?: v2| version 2)?"]),
    ("blueoak-1.0", "blue oak", [], ["blue oak model licen[cs]e(?: 1 0 0)?"]),
    ("polyform", "polyform", [], ["polyform (?:noncommercial|shield|small business|perimeter|strict|internal use|free trial) licen[cs]e(?: 1 0 0)?"]),
    ("hippocratic", "hippocratic licen", [], ["hippocratic licen[cs]e(?: version)?(?: [123] [01])?"]),
    ("openrail", "rail", [], ["(?:creativeml |bigscience )?(?:open rail|openrail)(?: m)?(?: licen[cs]e)?", "bigscience rail licen[cs]e"]),
    ("llama", "llama", [], ["llama (?:[23] |3 [1-9] )?community licen[cs]e(?: agreement)?"]),
    ("gemma", "gemma terms of use", [], ["gemma terms of use"]),
    ("freetype", "freetype", ["distributed under the freetype project licen[cs]e"], ["freetype(?: project)? licen[cs]e"]),
    ("ijg", "independent jpeg group", ["this software is based in part on the work of the independent jpeg group"], ["independent jpeg group licen[cs]e"]),
    ("icu", "icu licen", [], ["icu licen[cs]e"]),
    ("unicode", "unicode", [], ["unicode licen[cs]e(?: agreement)?(?: data files and software)?", "unicode terms of use"]),
    ("sleepycat", "sleepycat", [], ["sleepycat licen[cs]e"]),
    ("zope-2.1", "zope public licen", [], ["zope public licen[cs]e(?: zpl)?(?: version 2 [01])?"]),
    ("beerware", "beer ware", [], ["beer ware licen[cs]e(?: revision 42)?"]),
    ("json", "shall be used for good not evil", ["the software shall be used for good not evil"], []),
    ("ssleay", "ssleay", [], ["ssleay licen[cs]e"]),
    ("bittorrent", "bittorrent open source", [], ["bittorrent open source licen[cs]e"]),
    ("qpl-1.0", "q public licen", [], ["q public licen[cs]e(?: version 1 0)?"]),
    ("apsl-2.0", "apple public source", [], ["apple public source licen[cs]e(?: version)?(?: 2 0)?"]),
    ("sun-bcl", "sun binary code", [], ["sun binary code licen[cs]e(?: agreement)?"]),
    ("nasa-1.3", "nasa open source", [], ["nasa open source agreement(?: version 1 3)?"]),
    ("lppl", "latex project public licen", ["under the conditions of the latex project public licen[cs]e"], ["latex project public licen[cs]e(?: version)?(?: 1 3c?)?"]),
    ("free-art", "free art licen", [], ["free art licen[cs]e(?: 1 3)?"]),
    ("free-art", "licence art libre", [], ["licence art libre"]),
    ("gutenberg", "project gutenberg", ["under the terms of the project gutenberg licen[cs]e"], ["project gutenberg (?:tm )?licen[cs]e"]),
    ("gpl-exception", "exception", [], ["classpath exception", "gcc runtime library exception", "linking exception to the gpl"]),
    ("eula", "licen", ["end user licen[cs]e agreement"], []),
    ("proprietary", "proprietary", ["(?:confidential and proprietary|proprietary and confidential)", "proprietary (?:software )?licen[cs]e", "unauthori[sz]ed copying of this file (?:[^ ]+ ){0,8}?proprietary"], []),
    ("non-commercial", "commercial use", ["for non ?commercial use only", "(?:no|not for|prohibits|without) commercial use", "commercial use (?:is )?(?:prohibited|not permitted|forbidden)"], []),
    ("research-only", "research", ["for (?:academic|non ?commercial)(?: and| or)? (?:academic |non ?commercial )?research (?:purposes|use) only", "for research (?:purposes|use) only"], []),
]

#: Words around a right that is claimed or granted without a named license.
HINTS = [
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("all-rights-reserved", "derechos reservados", "todos los derechos reservados"),
    ("all-rights-reserved", "droits", "tous droits réservés"),
    ("all-rights-reserved", "alle rechte vorbehalten", "alle rechte vorbehalten"),
    ("permission-required", "permission", "no part of this (?:publication|book|work|document) may be reproduced (?:[^ ]+ ){0,25}?permission"),
    ("see-license-file", "license", "see (?:the )?(?:accompanying )?license (?:txt |md )?(?:file )?for (?:more )?(?:details|information|the full license text)"),
]


def rules() -> list[tuple[str, int, str, str]]:
    out = [(label, TAG, "spdx license identifier", f"spdx license identifier {words}") for words, label in TAGS.items()]
    for label, keyword, notices, names in SIGNATURES:
        out += [(label, NOTICE, keyword, r) for r in notices] + [(label, NAME, keyword, r) for r in names]
    return out + [(label, HINT, keyword, r) for label, keyword, r in HINTS]
