r"""License scans by ordered signature rules; DataFrame operations only.

Rules are regular expressions over the text's words in lower case, parted by single spaces ("(c)" is read as ©).
Most are written by hand (SIGNATURES: titles, notices, bodies, glued names, copyright lines); the forms in which a license is
named (a tag, a grant, a name with its version, a name alone) are put together from the names in LICENSES. Each rule has a priority and a
keyword, a literal that stands at a word's beginning in whatever the rule can match. One expression over all keywords, as a tree of
prefixes, lets most texts go; on the rest, a keyword's rules are tried only if it stands there and one
expression over all its rules finds something. Detections that lie within another one of higher priority,
or of the same and longer or of an earlier rule, are suppressed. So a grant that is denied ("not released under the GPL") hides what it names. Names that are
words of their own (epl, mpl, apache) say nothing alone or before a lone number: a grant, "license", "version" or a whole number must stand by them.

Suppression is a fold over the detections by start and falling end: a detection lies within an earlier one of
at least its priority exactly if the furthest end met at that priority reaches its own. The state is one
number a priority and one entry a label, so the work is linear in the text.

Base phrases are found besides, at all places; their labels always stay.

Defined cases: null and empty texts have no words, no labels and score 0; rows are judged each by
itself, so null ids, repeated rows, empty tables and other columns need nothing.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.llm import shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words: everything in ASCII but letters and digits.
APART = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_L = "licen[cs]e"
#: label, versions, whether the name alone says enough, and names by the keyword that each of them holds.
LICENSES = (
    ("apache", ("1.0", "1.1", "2.0"), False, {"apache": f"apache(?: software)?(?: {_L})?"}),
    ("gpl", ("1.0", "2.0", "3.0"), True, {"gpl": "(?:gnu )?gpl", "gnu general public": f"gnu general public(?: {_L})?"}),
    ("lgpl", ("2.0", "2.1", "3.0"), True, {"lgpl": "(?:gnu )?lgpl", "lesser general public": f"(?:gnu )?lesser general public(?: {_L})?", "library general public": f"(?:gnu )?library general public(?: {_L})?"}),
    ("agpl", ("1.0", "3.0"), True, {"agpl": "(?:gnu )?agpl", "affero general public": f"(?:gnu )?affero general public(?: {_L})?"}),
    ("gfdl", ("1.1", "1.2", "1.3"), True, {"gfdl": "gfdl", "gnu free documentation": f"gnu free documentation {_L}"}),
    ("mit", (), True, {"mit licen": f"mit {_L}"}),
    ("expat", (), True, {"expat licen": f"expat {_L}"}),
    ("isc", (), True, {"isc licen": f"isc {_L}"}),
    ("bsd-2-clause", (), True, {"bsd 2 clause": f"bsd 2 clause(?: {_L})?", "2 clause bsd": f"2 clause bsd(?: {_L})?", "simplified bsd": f"simplified bsd(?: {_L})?", "freebsd licen": f"freebsd {_L}"}),
    ("bsd-3-clause", (), True, {"bsd 3 clause": f"bsd 3 clause(?: {_L})?", "3 clause bsd": f"3 clause bsd(?: {_L})?", "new bsd": f"new bsd {_L}", "modified bsd": f"modified bsd(?: {_L})?", "revised bsd": f"revised bsd(?: {_L})?"}),
    ("bsd-4-clause", (), True, {"bsd 4 clause": f"bsd 4 clause(?: {_L})?", "4 clause bsd": f"4 clause bsd(?: {_L})?", "original bsd": f"original bsd(?: {_L})?"}),
    ("bsd", (), True, {"bsd licen": f"bsd {_L}", "bsd style": f"bsd style(?: {_L})?"}),
    ("0bsd", (), True, {"0bsd": "0bsd", "zero clause bsd": "zero clause bsd"}),
    ("mpl", ("1.0", "1.1", "2.0"), False, {"mpl": "mpl", "mozilla public": f"mozilla public(?: {_L})?"}),
    ("epl", ("1.0", "2.0"), False, {"epl": "epl", "eclipse public": f"eclipse public {_L}"}),
    ("cpl", ("1.0",), True, {"common public licen": f"common public {_L}"}),
    ("cddl", ("1.0", "1.1"), True, {"cddl": "cddl", "common development and distribution": f"common development and distribution {_L}"}),
    ("eupl", ("1.0", "1.1", "1.2"), True, {"eupl": "eupl", "european union public": f"european union public {_L}"}),
    ("cecill", ("1.0", "2.0", "2.1"), True, {"cecill": f"cecill(?: {_L})?"}),
    ("artistic", ("1.0", "2.0"), True, {"artistic licen": f"artistic {_L}"}),
    ("afl", ("1.2", "2.0", "2.1", "3.0"), True, {"academic free licen": f"academic free {_L}"}),
    ("osl", ("1.0", "2.0", "2.1", "3.0"), True, {"open software licen": f"open software {_L}"}),
    ("ofl", ("1.0", "1.1"), True, {"sil open font": f"sil open font {_L}"}),
    ("bsl", ("1.0",), True, {"boost software licen": f"boost software {_L}"}),
    ("busl", ("1.0", "1.1"), True, {"business source licen": f"business source {_L}"}),
    ("sspl", ("1.0",), True, {"sspl": "sspl", "server side public": f"server side public {_L}"}),
    ("elastic", ("1.0", "2.0"), True, {"elastic licen": f"elastic {_L}"}),
    ("psf", ("1.0", "2.0"), True, {"psf licen": f"psf {_L}", "python software foundation licen": f"python software foundation {_L}"}),
    ("php", ("3.0", "3.01"), True, {"php licen": f"php {_L}"}),
    ("zlib", (), True, {"zlib": f"zlib(?: libpng)? {_L}"}),
    ("openssl", (), True, {"openssl licen": f"openssl {_L}"}),
    ("postgresql", (), True, {"postgresql licen": f"postgresql {_L}"}),
    ("ncsa", (), True, {"ncsa": f"ncsa(?: open source)? {_L}", "university of illinois": f"university of illinois(?: open source)? {_L}"}),
    ("w3c", (), True, {"w3c": f"w3c(?: software)? {_L}"}),
    ("ms-pl", (), True, {"microsoft public licen": f"microsoft public {_L}"}),
    ("ms-rl", (), True, {"microsoft reciprocal licen": f"microsoft reciprocal {_L}"}),
    ("unlicense", (), True, {"unlicense": "(?:the )?unlicense"}),
    ("wtfpl", (), True, {"wtfpl": "wtfpl"}),
    ("cc0", ("1.0",), True, {"cc0": "cc0", "creative commons zero": "creative commons zero"}),
    ("public-domain", (), True, {"the public domain": "(?:is|are|be|been|was|now|work|software|code|file|placed|put|released|dedicated|entered|enters|fell|falls|passed) (?:in|into|to) the public domain"}),
    ("odbl", ("1.0",), True, {"odbl": "odbl", "open database licen": f"open database {_L}"}),
    ("odc-by", ("1.0",), True, {"odc by": "odc by", "open data commons attribution": f"open data commons attribution {_L}"}),
    ("pddl", ("1.0",), True, {"pddl": "pddl", "public domain dedication and": f"public domain dedication and {_L}"}),
    ("cc-by", ("1.0", "2.0", "2.5", "3.0", "4.0"), True, {"cc by": "cc by", "creative commons attribution": "creative commons attribution"}),
    ("cc-by-sa", ("1.0", "2.0", "2.5", "3.0", "4.0"), True, {"cc by sa": "cc by sa", "creative commons attribution": "creative commons attribution share ?alike"}),
    ("cc-by-nd", ("1.0", "2.0", "2.5", "3.0", "4.0"), True, {"cc by nd": "cc by nd", "creative commons attribution": "creative commons attribution no ?deriv(?:ative)?s?"}),
    ("cc-by-nc", ("1.0", "2.0", "2.5", "3.0", "4.0"), True, {"cc by nc": "cc by nc", "creative commons attribution": "creative commons attribution non ?commercial"}),
    ("cc-by-nc-sa", ("1.0", "2.0", "2.5", "3.0", "4.0"), True, {"cc by nc sa": "cc by nc sa", "creative commons attribution": "creative commons attribution non ?commercial share ?alike"}),
    ("cc-by-nc-nd", ("1.0", "2.0", "2.5", "3.0", "4.0"), True, {"cc by nc nd": "cc by nc nd", "creative commons attribution": "creative commons attribution non ?commercial no ?deriv(?:ative)?s?"}),
)
NAME, GRANT, VERSION, VERSION_GRANT, BODY, TAG, NEGATION = PRIORITIES = (10, 20, 30, 40, 45, 50, 60)
_BY = "(?:(?:licen[cs]ed|released|distributed|available|published|covered|provided) under|covered by|governed by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
_NOT = "(?:not|never|neither|isn t|aren t|wasn t|weren t|no longer|cannot be|can t be) (?:yet |be |been |being )?"
#: Label of a negated grant: it keeps what lies within it from counting, and counts for nothing itself.
NEGATED = "negated"
_YEAR = "(?:19|20)[0-9]{2}"
_WHO = "[^ ©0-9]+"
#: Written by hand: label, priority, keyword, expression.
SIGNATURES = (
    # copyright lines
    ("copyright", NAME, "copyright", f"copyright (?:© )?{_YEAR}(?: (?:19|20)?[0-9]{{2}}){{0,9}}(?: by)?(?: {_WHO}){{1,3}}"),
    ("copyright", NAME, "copyright ©", f"copyright © (?:by )?(?:{_WHO} ){{1,4}}{_YEAR}"),
    ("copyright", NAME, "copyright by", f"copyright by (?:{_WHO} ){{1,4}}{_YEAR}"),
    ("copyright", NAME, "©", f"© (?:copyright )?{_YEAR}(?: (?:19|20)?[0-9]{{2}}){{0,9}}(?: by)?(?: {_WHO}){{1,3}}"),
    ("copyright", NAME, "©", f"© (?:copyright )?(?:by )?(?:{_WHO} ){{1,4}}{_YEAR}"),
    ("copyright", NAME, "spdx filecopyrighttext", f"spdx filecopyrighttext (?:© )?{_YEAR}(?: {_WHO}){{1,3}}"),
    ("reserved", NAME, "all rights reserved", "all rights reserved"),
    ("reserved", NAME, "alle rechte vorbehalten", "alle rechte vorbehalten"),
    ("reserved", NAME, "tous droits réservés", "tous droits réservés"),
    ("reserved", NAME, "todos los derechos reservados", "todos los derechos reservados"),
    ("proprietary", GRANT, "proprietary and confidential", "proprietary and confidential"),
    ("proprietary", GRANT, "confidential and proprietary", "confidential and proprietary"),
    ("proprietary", BODY, "unauthorized copying of this file", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", BODY, "no part of this", f"no part of this (?:publication|book|work|document|website) may be reproduced(?: {_WHO}){{0,20}} without (?:the )?(?:prior )?(?:written )?permission"),
    ("proprietary", GRANT, "do not distribute", "do not distribute without (?:prior )?(?:written )?(?:consent|permission)"),
    # MIT family
    ("mit", BODY, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", BODY, "the above copyright notice and this permission", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", VERSION, "mit x11", "mit x11(?: licen[cs]e)?"),
    ("mit", GRANT, "mit style", "mit style licen[cs]e"),
    ("mit-0", VERSION, "mit no attribution", "mit no attribution(?: licen[cs]e)?"),
    ("mit", GRANT, "opensource org licenses mit", "opensource org licenses mit(?: license)?(?: php)?"),
    ("no-warranty", NAME, "the software is provided as is", "the software is provided as is without warranty of any kind"),
    ("no-warranty", NAME, "this software is provided", "this software is provided (?:by the (?:copyright holders and contributors|regents and contributors|author) )?as is"),
    # ISC family
    ("isc", BODY, "permission to use copy modify and", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", BODY, "permission to use copy modify and", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("ntp", BODY, "permission to use copy modify and", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?with(?:out| or without) fee is hereby granted"),
    ("postgresql", BODY, "permission to use copy modify and", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    # BSD family
    ("bsd", BODY, "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2-clause", BODY, "redistributions in binary form must reproduce", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", BODY, "neither the name", f"neither the name of(?: {_WHO}){{1,8}} nor the names of (?:its|their|the) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", BODY, "the name of the author may not", "the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", BODY, "all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", GRANT, "bsd style licen", "governed by a bsd style licen[cs]e(?: that can be found in the licen[cs]e file)?"),
    ("bsd-source-code", BODY, "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice"),
    # Apache
    ("apache-2.0", BODY, "licensed under the apache", f"licensed under the apache {_L} version 2 0 the {_L} you may not use this file except in compliance with the {_L}"),
    ("apache-2.0", GRANT, "apache org licenses", "apache org licenses license 2 0(?: html| txt)?"),
    ("apache-2.0", BODY, "apache license version 2 0 january", "apache license version 2 0 january 2004"),
    ("apache-2.0", VERSION, "asl 2", "asl 2 0"),
    ("apache-1.1", BODY, "this product includes software developed by the apache", "this product includes software developed by the apache software foundation"),
    ("apache", GRANT, "licensed to the apache software", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    # GNU family
    ("gpl-2.0", BODY, "gnu general public license as published", "gnu general public license as published by the free software foundation(?: either)? version 2(?: of the license)?(?: or at your option any later version)?"),
    ("gpl-3.0", BODY, "gnu general public license as published", "gnu general public license as published by the free software foundation(?: either)? version 3(?: of the license)?(?: or at your option any later version)?"),
    ("gpl-2.0", BODY, "gnu general public license version 2 june", "gnu general public license version 2 june 1991"),
    ("gpl-3.0", BODY, "gnu general public license version 3 29", "gnu general public license version 3 29 june 2007"),
    ("lgpl-2.1", BODY, "gnu lesser general public license as", "gnu lesser general public license as published by the free software foundation(?: either)? version 2 1(?: of the license)?(?: or at your option any later version)?"),
    ("lgpl-3.0", BODY, "gnu lesser general public license as", "gnu lesser general public license as published by the free software foundation(?: either)? version 3(?: of the license)?(?: or at your option any later version)?"),
    ("lgpl-2.0", BODY, "gnu library general public license as", "gnu library general public license as published by the free software foundation(?: either)? version 2(?: of the license)?(?: or at your option any later version)?"),
    ("lgpl-2.1", BODY, "gnu lesser general public license version 2 1 february", "gnu lesser general public license version 2 1 february 1999"),
    ("agpl-3.0", BODY, "gnu affero general public license as", "gnu affero general public license as published by the free software foundation(?: either)? version 3(?: of the license)?(?: or at your option any later version)?"),
    ("gpl", BODY, "is free software you can redistribute", "is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", BODY, "is free software you can redistribute", "is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", BODY, "is free software you can redistribute", "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", GRANT, "you should have received a copy of the gnu", "you should have received a copy of the gnu general public license"),
    ("lgpl", GRANT, "you should have received a copy of the gnu", "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", GRANT, "you should have received a copy of the gnu", "you should have received a copy of the gnu affero general public license"),
    ("gfdl", BODY, "permission is granted to copy distribute", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl-classpath", VERSION, "classpath exception", "classpath exception"),
    ("gcc-exception", VERSION, "gcc runtime library exception", "gcc runtime library exception"),
    ("gpl-2.0", GRANT, "gnu org licenses", "gnu org licenses old licenses gpl 2 0(?: html| txt)?"),
    ("gpl", GRANT, "gnu org licenses gpl", "gnu org licenses gpl(?: 3 0)?(?: html| txt)?"),
    ("lgpl", GRANT, "gnu org licenses lgpl", "gnu org licenses lgpl(?: 3 0)?(?: html| txt)?"),
    ("gpl-fsf", NAME, "free software foundation", "free software foundation inc 5[19] (?:franklin|temple)"),
    ("copyleft", NAME, "copyleft", "copyleft"),
    # Mozilla, Eclipse and their like
    ("mpl-2.0", BODY, "this source code form is subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", BODY, "the contents of this file are subject", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", GRANT, "mozilla org mpl", "mozilla org mpl 2 0"),
    ("epl-2.0", BODY, "this program and the accompanying materials are made available", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("epl-1.0", BODY, "this program and the accompanying materials are made available", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("cddl", BODY, "the contents of this file are subject", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl-1.2", BODY, "licensed under the eupl", "licensed under the eupl (?:version )?1 2(?: or as soon they will be approved)?"),
    ("artistic-2.0", BODY, "everyone is permitted to copy", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("perl", GRANT, "same terms as perl", "(?:under the )?same terms as perl(?: itself)?"),
    ("python-2.0", GRANT, "python software foundation license version 2", "python software foundation license version 2"),
    ("zlib", BODY, "this software is provided as is without any express", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", BODY, "the origin of this software must not", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("bsl-1.0", BODY, "permission is hereby granted free of charge to any person or", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1.0", GRANT, "boost org license", "boost org license 1 0(?: txt)?"),
    ("openssl", BODY, "this product includes software developed by the openssl", "this product includes software developed by the openssl project(?: for use in the openssl toolkit)?"),
    ("ssleay", BODY, "this product includes cryptographic", "this product includes cryptographic software written by eric young"),
    ("curl", BODY, "permission to use copy modify and", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("x11", BODY, "except as contained in this notice", f"except as contained in this notice the name(?:s)? of(?: {_WHO}){{1,8}} shall not be used in advertising"),
    ("unicode", BODY, "unicode inc license agreement", "unicode inc license agreement data files and software"),
    ("ijg", BODY, "this software is based in part on the work of the independent", "this software is based in part on the work of the independent jpeg group"),
    ("freetype", GRANT, "freetype project licen", "freetype project licen[cs]e"),
    ("libpng", GRANT, "libpng licen", "libpng licen[cs]e"),
    ("json", BODY, "the software shall be used for good", "the software shall be used for good not evil"),
    ("beerware", BODY, "beer", "the beer ?ware licen[cs]e(?: revision 42)?"),
    ("beerware", NAME, "beerware", "beerware"),
    ("wtfpl", BODY, "do what the fuck you want", "do what the fuck you want to public license"),
    ("unlicense", BODY, "this is free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("unlicense", GRANT, "unlicense org", "unlicense org"),
    ("ofl-1.1", BODY, "this font software is licensed", "this font software is licensed under the sil open font license version 1 1"),
    ("ms-pl", GRANT, "ms pl", "ms pl"),
    ("busl-1.1", BODY, "the licensor hereby grants you the right to copy", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("commons-clause", VERSION, "commons clause", "commons clause(?: license condition)?(?: v1 0)?"),
    ("polyform", VERSION, "polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter|internal use|free trial) license(?: 1 0 0)?"),
    ("prosperity", VERSION, "prosperity public", "prosperity public license(?: 3 0 0)?"),
    ("llama", VERSION, "llama", "llama (?:2 |3 |3 [123] )?community license(?: agreement)?"),
    ("openrail", VERSION, "openrail", "openrail(?: ?m)?"),
    # Creative Commons and data
    ("cc-by", BODY, "this work is licensed under a creative commons attribution", "this work is licensed under a creative commons attribution (?:4 0 international|3 0 unported|3 0) license"),
    ("cc-by-sa", BODY, "this work is licensed under a creative commons attribution", "this work is licensed under a creative commons attribution share ?alike (?:4 0 international|3 0 unported|3 0) license"),
    ("cc-by-nc", BODY, "this work is licensed under a creative commons attribution", "this work is licensed under a creative commons attribution non ?commercial (?:4 0 international|3 0 unported|3 0) license"),
    ("cc-by", GRANT, "creativecommons org licenses", "creativecommons org licenses by [1234] [05]"),
    ("cc-by-sa", GRANT, "creativecommons org licenses", "creativecommons org licenses by sa [1234] [05]"),
    ("cc-by-nc", GRANT, "creativecommons org licenses", "creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nd", GRANT, "creativecommons org licenses", "creativecommons org licenses by nd [1234] [05]"),
    ("cc-by-nc-sa", GRANT, "creativecommons org licenses", "creativecommons org licenses by nc sa [1234] [05]"),
    ("cc-by-nc-nd", GRANT, "creativecommons org licenses", "creativecommons org licenses by nc nd [1234] [05]"),
    ("cc0-1.0", GRANT, "creativecommons org publicdomain zero", "creativecommons org publicdomain zero 1 0"),
    ("cc0", BODY, "to the extent possible under law", f"to the extent possible under law(?: {_WHO}){{1,8}} waived all copyright and related or neighboring rights"),
    ("cc", NAME, "some rights reserved", "some rights reserved"),
    ("odbl", BODY, "this database is made available under the open database", "this database is made available under the open database license"),
    ("ogl-3.0", VERSION, "open government licen", "open government licen[cs]e(?: v3 0)?"),
    ("public-domain", GRANT, "dedicated to the public domain", "dedicated to the public domain"),
    ("public-domain", GRANT, "public domain mark", "public domain mark(?: 1 0)?"),
    ("public-domain", GRANT, "united states government work", "united states government work"),
    ("fair-use", NAME, "fair use", "fair use (?:policy|notice|act|doctrine|disclaimer)"),
    ("non-commercial", GRANT, "for non commercial", "for non commercial (?:use|purposes) only"),
    ("non-commercial", GRANT, "for noncommercial", "for noncommercial (?:use|purposes) only"),
    ("research-only", GRANT, "for research purposes only", "for research purposes only"),
    ("eula", GRANT, "end user licen", "end user licen[cs]e agreement"),
    ("royalty-free", NAME, "royalty free", "royalty free (?:perpetual|non exclusive|irrevocable|worldwide)? ?licen[cs]e"),
    ("dual", GRANT, "dual licensed", "dual licensed under"),
    ("see-license", NAME, "see the license file", "see the license file(?: for details)?"),
    ("see-license", NAME, "see license", "see license(?: md| txt)? for (?:details|more information)"),
)


def rules() -> list[tuple[str, str, str, int]]:
    """keyword, expression, label, priority; in the order that settles ties."""
    out = [(word, expression, label, priority) for label, priority, word, expression in SIGNATURES]
    for label, versions, enough, names in LICENSES:
        plain = label.replace("-", " ")
        later = "(?: or (?:any )?later(?: version)?)?"
        for v in versions:
            whole = v.replace(".", " ")
            digits = whole if not v.endswith(".0") else f"{v[:-2]}(?: 0)?"
            tag = f"{label}-{v}"
            out.append((f"identifier {plain}", f"spdx {_L} identifier {plain} {whole}(?: (?:only|or later))?", tag, TAG))
            for word, name in names.items():
                told = f"(?: {_L}(?: version| ver| v)?| version| ver| v) v?{digits}"
                exact = f"{name}(?: {_L})?(?: version| ver| v)? v?{digits}" if enough else f"{name}(?:{told}| v?{whole}| v{digits})"
                if word == label:  # a name of one word has its version glued to it as well: gplv2, lgpl2.1
                    exact = f"(?:{exact}|{name}v?{digits if enough else whole}|{name}v{digits})"
                granted = exact if enough else f"{name}(?: {_L})?(?: version| ver| v)? v?{digits}"
                out.append((word, _BY + granted + f"(?: {_L})?" + later, tag, VERSION_GRANT))
                out.append((word, exact + later, tag, VERSION))
        out.append((f"identifier {plain}", f"spdx {_L} identifier {plain}", label, TAG))
        numbers = f"(?: {_L})?(?: version| ver| v)?(?: v?[0-9](?: [0-9])?)?(?: {_L})?" + later
        for word, name in names.items():
            out.append((word, _BY + name, label, GRANT))
            out.append((word, _NOT + _BY + name + numbers, NEGATED, NEGATION))
            if enough:
                out.append((word, name, label, NAME))
            else:
                out.append((word, f"{name} {_L}", label, NAME))
    return out


def prefixes(words: list[str]) -> str:
    """One expression that finds any of the words, as a tree: what begins alike is looked at once."""
    tree: dict = {}
    for word in words:
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def spelled(node: dict) -> str:
        if "" in node:
            return ""  # what is longer begins with it
        parts = [re.escape(c) + spelled(rest) for c, rest in sorted(node.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return spelled(tree)


def normal(text: Column) -> Column:
    """The words in lower case between single spaces, a space at either end; built-in string functions wherever runs of what parts words are short."""
    marked = F.replace(F.replace(text, F.lit("(c)"), F.lit(" © ")), F.lit("(C)"), F.lit(" © "))
    out = F.concat(F.lit(" "), F.translate(marked, UPPER + APART, LOWER + " " * len(APART)), F.lit(" "))
    for n in (8, 4, 2, 2, 2):
        out = F.replace(out, F.lit(" " * n), F.lit(" "))
    return out


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score, detections (label, priority, first, last, n)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = [c for c in docs.columns if c.lower() not in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")]
    norm, kws, acts, dets, fold, *base = shared.fresh([*docs.columns, "n_words", "detections"], "norm", "kws", "acts", "dets", "fold", *(f"base{k}" for k in range(len(BASE))))
    out = docs.withColumn(norm, normal(text))
    out = out.withColumn(norm, F.when(F.contains(F.col(norm), F.lit("  ")), F.regexp_replace(F.col(norm), " +", " ")).otherwise(F.col(norm)))
    out = out.withColumn("n_words", (_spaces(F.col(norm)) - 1).cast("long"))

    # base phrases: pieces between their places; first and last place from the outer pieces
    firsts, lasts, counts, names = [], [], [], []
    for (phrase, label), c in zip(BASE, base, strict=True):
        out = out.withColumn(c, F.when(F.contains(F.col(norm), F.lit(f" {phrase} ")), F.split(F.col(norm), f"(?<= ){phrase}(?= )", -1)))
        n = F.greatest(F.coalesce(F.size(c), F.lit(1)) - 1, F.lit(0))
        counts.append(n)
        firsts.append(F.when(n > 0, _spaces(F.element_at(c, 1)) - 1))
        lasts.append(F.when(n > 0, F.col("n_words") - (_spaces(F.element_at(c, -1)) - 1) - len(phrase.split())))
        names.append(F.when(n > 0, F.lit(label)))
    out = out.withColumns({"n_base": sum(counts[1:], counts[0]).cast("long"), "first_word": F.least(*firsts).cast("long"), "last_word": F.greatest(*lasts).cast("long")})
    found_base = F.array_sort(F.array_compact(F.array(*names)))

    table = rules()
    of_word: dict[str, list[str]] = {}
    for k, e, _, _ in table:
        of_word.setdefault(k, []).append(e)
    # the table is one literal, and the keywords' tests are one expression: some hundred calls for each rule would cost the driver seconds
    kinds = "array<struct<kw:string,re:string,label:string,prio:int,ord:int>>"
    literal = F.from_json(F.lit(json.dumps([{"kw": k, "re": f"(?<= )(?:{e})(?= )", "label": label, "prio": p, "ord": o} for o, (k, e, label, p) in enumerate(table)])), kinds)
    tests = ", ".join(f"CASE WHEN contains(`{norm}`, ' {k}') AND `{norm}` RLIKE '(?<= )(?:{'|'.join(es)})(?= )' THEN '{k}' END" for k, es in of_word.items())
    out = out.withColumn(kws, F.when(F.col(norm).rlike(" " + prefixes(list(of_word))), F.expr(f"array_compact(array({tests}))")))
    out = out.withColumn(acts, F.filter(F.when(F.size(kws) > 0, literal), lambda r: F.array_contains(F.col(kws), r["kw"]) & F.rlike(F.col(norm), r["re"])))

    def places(r: Column) -> Column:
        marked = F.split(F.trim(F.regexp_replace(F.col(norm), r["re"], F.lit("\u0001$0\u0002"))), " ")
        at = lambda mark, first: F.filter(F.transform(marked, lambda w, i: F.when(w.startswith(mark) if first else w.endswith(mark), i)), lambda i: i.isNotNull())
        both = F.arrays_zip(at("\u0001", True).alias("start"), at("\u0002", False).alias("end"))
        return F.transform(both, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("rend"), (-r["prio"]).alias("rprio"), r["ord"].alias("ord"), r["label"].alias("label")))

    out = out.withColumn(dets, F.array_sort(F.flatten(F.transform(F.col(acts), places))))
    start = F.struct(*[F.lit(-1).alias(f"e{p}") for p in PRIORITIES], F.lit(None).cast("array<struct<label:string,priority:int,first:int,last:int,n:int>>").alias("kept"))
    start = start.withField("kept", F.array().cast("array<struct<label:string,priority:int,first:int,last:int,n:int>>"))

    def step(acc: Column, d: Column) -> Column:
        prio, end = -d["rprio"], -d["rend"]
        reach = F.lit(None).cast("int")
        for p in PRIORITIES:
            reach = F.when(prio == p, acc[f"e{p}"]).otherwise(reach)
        free = reach < end
        one = F.struct(d["label"].alias("label"), prio.alias("priority"), d["start"].alias("first"), d["start"].alias("last"), F.lit(1).alias("n"))
        known = F.exists(acc["kept"], lambda k: k["label"] == d["label"])
        more = F.transform(acc["kept"], lambda k: F.when(k["label"] == d["label"], F.struct(k["label"].alias("label"), F.greatest(k["priority"], prio).alias("priority"), k["first"].alias("first"), d["start"].alias("last"), (k["n"] + 1).alias("n"))).otherwise(k))
        kept = F.when(~free, acc["kept"]).when(known, more).otherwise(F.concat(acc["kept"], F.array(one)))
        return F.struct(*[F.when(prio >= p, F.greatest(acc[f"e{p}"], end)).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in PRIORITIES], kept.alias("kept"))

    out = out.withColumn(fold, F.when(F.size(dets) > 0, F.aggregate(F.col(dets), start, step, lambda acc: acc["kept"])))
    detections = F.filter(F.coalesce(F.col(fold), F.array().cast("array<struct<label:string,priority:int,first:int,last:int,n:int>>")), lambda k: k["label"] != NEGATED)
    top = F.array_max(F.transform(detections, lambda k: k["priority"]))
    out = out.withColumns({
        "base_labels": F.array_join(found_base, ","),
        "labels": F.array_join(F.array_sort(F.array_union(found_base, F.transform(detections, lambda k: k["label"]))), ","),
        "score": F.greatest(F.coalesce(top, F.lit(0)) / TAG, F.when(F.col("n_base") > 0, F.lit(0.2)).otherwise(F.lit(0.0))),
        "detections": detections,
    })
    return out.select(*[F.col(f"`{c}`") for c in own], "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
