"""Signature rules of the licence scan.

A rule is a regular expression over a text's words, lower-cased and joined by single blanks.
``gate`` is a word every match contains: a rule is tried only on texts that hold it. Rules of
a lower ``priority`` number win where detections overlap; ``weight`` is how sure a match is.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    name: str
    gate: str
    pattern: str
    label: str
    priority: int
    weight: float


BASE, TEXT, NAMED, HINT = 0, 1, 2, 3

# The phrases every scan counts, all places.
BASE_RULES = [
    Rule("base-mit", "mit", "under the mit license", "mit", BASE, 0.95),
    Rule("base-apache-2", "apache", "apache license version 2", "apache-2", BASE, 0.95),
    Rule("base-cc-by-nc", "nc", "cc by nc", "cc-by-nc", BASE, 0.9),
]

# label, gate word, how the licence is called in running text
NAMES = [
    ("mit", "mit", r"mit"),
    ("mit-0", "mit", r"mit(?: 0| no attribution)"),
    ("x11", "x11", r"(?:mit )?x11"),
    ("isc", "isc", r"isc"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: version)? 1 1"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?(?: version| v)? 2(?: 0)?"),
    ("apache-2", "apache2", r"apache2(?: 0)?"),
    ("bsd-0", "0bsd", r"0bsd"),
    ("bsd-1", "bsd", r"(?:bsd 1 clause|1 clause bsd|one clause bsd)"),
    ("bsd-2", "bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd bsd)"),
    ("bsd-3", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|(?:new|modified|revised) bsd)"),
    ("bsd-4", "bsd", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)"),
    ("gpl-1", "gpl", r"(?:gnu )?gpl(?: version| v)? 1(?: 0)?(?: or later| only)?"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl(?: version| v)? 2(?: 0)?(?: or later| only)?"),
    ("gpl-2", "gplv2", r"(?:gnu )?gplv2(?: 0)?(?: or later| only)?"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl(?: version| v)? 3(?: 0)?(?: or later| only)?"),
    ("gpl-3", "gplv3", r"(?:gnu )?gplv3(?: 0)?(?: or later| only)?"),
    ("gpl-2", "gpl2", r"(?:gnu )?gpl2(?: 0)?(?: or later| only)?"),
    ("gpl-3", "gpl3", r"(?:gnu )?gpl3(?: 0)?(?: or later| only)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gpl", "gnu", r"gnu general public"),
    ("lgpl-2", "lgpl", r"(?:gnu )?lgpl(?: version| v)? 2(?: 0)?(?: or later| only)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?: version| v)? 2 1(?: or later| only)?"),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl(?: version| v)? 3(?: 0)?(?: or later| only)?"),
    ("lgpl-2.1", "lgplv2", r"(?:gnu )?lgplv2 1(?: or later| only)?"),
    ("lgpl-3", "lgplv3", r"(?:gnu )?lgplv3(?: 0)?(?: or later| only)?"),
    ("lgpl-3", "lgpl3", r"(?:gnu )?lgpl3(?: 0)?(?: or later| only)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public"),
    ("lgpl", "library", r"gnu library general public"),
    ("agpl-3", "agpl", r"(?:gnu )?agpl(?: version| v)? 3(?: 0)?(?: or later| only)?"),
    ("agpl-3", "agplv3", r"(?:gnu )?agplv3(?: 0)?(?: or later| only)?"),
    ("agpl-3", "agpl3", r"(?:gnu )?agpl3(?: 0)?(?: or later| only)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public"),
    ("fdl", "documentation", r"gnu free documentation"),
    ("mpl-1.1", "mozilla", r"mozilla public(?: license)?(?: version| v)? 1 1"),
    ("mpl-2", "mozilla", r"mozilla public(?: license)?(?: version| v)? 2(?: 0)?"),
    ("mpl-2", "mpl", r"mpl(?: version| v)? 2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public(?: license)?(?: version| v)? 1(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public(?: license)?(?: version| v)? 2(?: 0)?"),
    ("cddl-1", "cddl", r"cddl(?: version| v)? 1(?: 0)?"),
    ("cddl-1.1", "cddl", r"cddl(?: version| v)? 1 1"),
    ("cddl-1", "cddl1", r"cddl1(?: 0)?"),
    ("cddl-1.1", "cddl1", r"cddl1 1"),
    ("cddl", "distribution", r"common development and distribution"),
    ("cpl-1", "common", r"common public(?: license)?(?: version| v)? 1(?: 0)?"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("ms-rl", "microsoft", r"microsoft reciprocal"),
    ("boost-1", "boost", r"boost(?: software)?(?: version)?(?: 1 0)?"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("libpng", "libpng", r"libpng(?: version 2)?"),
    ("artistic-1", "artistic", r"artistic(?: license)?(?: version| v)? 1(?: 0)?"),
    ("artistic-2", "artistic", r"artistic(?: license)?(?: version| v)? 2(?: 0)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "attribution", r"creative commons attribution(?: [1-4] 0)?(?: international| unported| generic)?"),
    ("cc-by-sa", "sharealike", r"creative commons attribution sharealike(?: [1-4] 0)?(?: international| unported| generic)?"),
    ("cc-by-nc", "noncommercial", r"creative commons attribution noncommercial(?: [1-4] 0)?(?: international| unported| generic)?"),
    ("cc-by-nc-sa", "sharealike", r"creative commons attribution noncommercial sharealike(?: [1-4] 0)?(?: international| unported| generic)?"),
    ("cc-by-nd", "noderivatives", r"creative commons attribution noderivatives(?: [1-4] 0)?(?: international| unported| generic)?"),
    ("cc-by-nc-nd", "noderivatives", r"creative commons attribution noncommercial noderivatives(?: [1-4] 0)?(?: international| unported| generic)?"),
    ("odbl-1", "odbl", r"odbl(?: 1 0)?"),
    ("odbl-1", "database", r"open database"),
    ("odc-by-1", "odc", r"odc by(?: 1 0)?"),
    ("pddl-1", "pddl", r"pddl(?: 1 0)?"),
    ("ofl-1.1", "sil", r"sil open font(?: license)?(?: version)?(?: 1 1)?"),
    ("psf-2", "python", r"python software foundation(?: license)?(?: version)?(?: 2)?"),
    ("ruby", "ruby", r"ruby"),
    ("php-3", "php", r"php(?: license)?(?: version)? 3(?: 0[01])?"),
    ("openssl", "openssl", r"openssl"),
    ("postgresql", "postgresql", r"postgresql"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("eupl-1.2", "eupl", r"eupl(?: version| v)? 1 2"),
    ("eupl-1.2", "eupl1", r"eupl1 2"),
    ("upl-1", "permissive", r"universal permissive(?: license)?(?: version)?(?: 1 0)?"),
    ("sspl-1", "server", r"server side public(?: license)?(?: version)?(?: 1)?"),
    ("busl-1.1", "business", r"business source(?: license)?(?: version)?(?: 1 1)?"),
    ("elastic-2", "elastic", r"elastic(?: license)?(?: version)? 2(?: 0)?"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice)?"),
]

# how a notice speaks of the licence it names: name, words around it, priority, weight
FORMS = [
    ("under", r"under (?:the )?(?:terms of )?(?:the )?{0}(?: style)?(?: software| public)? licen[cs]e", TEXT, 0.95),
    ("licensed", r"(?:is |are )?licen[cs]ed under (?:the )?(?:terms of )?(?:the )?{0}", TEXT, 0.9),
    ("released", r"(?:released|distributed|published|available|provided|made available) under (?:the )?(?:terms of )?(?:the )?{0}", TEXT, 0.85),
    ("spdx", r"spdx licen[cs]e identifier {0}", TEXT, 1.0),
    ("field", r"licen[cs]e {0}", NAMED, 0.7),
    ("name", r"{0} licen[cs]e", NAMED, 0.6),
]

# notices and texts that are known by their own words
OWN_RULES = [
    Rule("mit-grant", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", "mit", TEXT, 1.0),
    Rule("mit-spirit", "permission", r"the above copyright notice and this permission notice shall be included", "mit", TEXT, 0.9),
    Rule("isc-grant", "permission", r"permission to use copy modify and (?:or )?distribute this software for any purpose", "isc", TEXT, 1.0),
    Rule("bsd-grant", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", "bsd-2", TEXT, 0.9),
    Rule("bsd-endorse", "endorse", r"neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse", "bsd-3", TEXT, 1.0),
    Rule("bsd-advert", "advertising", r"all advertising materials mentioning features or use of this software must display", "bsd-4", TEXT, 1.0),
    Rule("apache-you-may", "compliance", r"you may not use this file except in compliance with the license", "apache-2", TEXT, 0.9),
    Rule("apache-url", "apache", r"apache org licenses license 2 0", "apache-2", TEXT, 1.0),
    Rule("apache-long", "apache", r"apache license version 2 0 january 2004", "apache-2", TEXT, 1.0),
    Rule("apache-licensed", "apache", r"licensed to the apache software foundation", "apache-2", TEXT, 0.9),
    Rule("gpl-free", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", TEXT, 1.0),
    Rule("gpl-3-later", "version", r"gnu general public license as published by the free software foundation (?:either )?version 3", "gpl-3", TEXT, 1.0),
    Rule("gpl-2-later", "version", r"gnu general public license as published by the free software foundation (?:either )?version 2", "gpl-2", TEXT, 1.0),
    Rule("gpl-v2", "general", r"gnu general public license(?: version| v) ?2(?: 0)?", "gpl-2", TEXT, 0.95),
    Rule("gpl-v3", "general", r"gnu general public license(?: version| v) ?3(?: 0)?", "gpl-3", TEXT, 0.95),
    Rule("lgpl-v21", "lesser", r"gnu lesser general public license(?: version| v) ?2 1", "lgpl-2.1", TEXT, 0.95),
    Rule("lgpl-v3", "lesser", r"gnu lesser general public license(?: version| v) ?3(?: 0)?", "lgpl-3", TEXT, 0.95),
    Rule("agpl-v3", "affero", r"gnu affero general public license(?: version| v) ?3(?: 0)?", "agpl-3", TEXT, 0.95),
    Rule("gnu-url-gpl", "gnu", r"(?:www )?gnu org licenses gpl(?: [23] 0)?(?: html| txt)?", "gpl", TEXT, 0.8),
    Rule("gnu-url-lgpl", "gnu", r"(?:www )?gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?", "lgpl", TEXT, 0.8),
    Rule("mpl-notice", "mozilla", r"subject to the terms of the mozilla public license v 2 0", "mpl-2", TEXT, 1.0),
    Rule("mpl-url", "mozilla", r"mozilla org mpl 2 0", "mpl-2", TEXT, 1.0),
    Rule("epl-url", "eclipse", r"eclipse org legal epl v10", "epl-1", TEXT, 1.0),
    Rule("epl2-url", "eclipse", r"eclipse org legal epl 2 0", "epl-2", TEXT, 1.0),
    Rule("zlib-grant", "misrepresented", r"the origin of this software must not be misrepresented", "zlib", TEXT, 1.0),
    Rule("boost-grant", "boost", r"boost org license 1 0", "boost-1", TEXT, 1.0),
    Rule("unlicense-text", "unencumbered", r"this is free and unencumbered software released into the public domain", "unlicense", TEXT, 1.0),
    Rule("public-domain", "domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", "public-domain", TEXT, 0.8),
    Rule("wtfpl-text", "fuck", r"do what the fuck you want to public license", "wtfpl", TEXT, 1.0),
    Rule("ofl-text", "font", r"this font software is licensed under the sil open font license", "ofl-1.1", TEXT, 1.0),
    Rule("cc-url-by", "creativecommons", r"creativecommons org licenses by [1-4] 0", "cc-by", TEXT, 1.0),
    Rule("cc-url-by-sa", "creativecommons", r"creativecommons org licenses by sa [1-4] 0", "cc-by-sa", TEXT, 1.0),
    Rule("cc-url-by-nc", "creativecommons", r"creativecommons org licenses by nc [1-4] 0", "cc-by-nc", TEXT, 1.0),
    Rule("cc-url-by-nd", "creativecommons", r"creativecommons org licenses by nd [1-4] 0", "cc-by-nd", TEXT, 1.0),
    Rule("cc-url-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa [1-4] 0", "cc-by-nc-sa", TEXT, 1.0),
    Rule("cc-url-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd [1-4] 0", "cc-by-nc-nd", TEXT, 1.0),
    Rule("cc-url-zero", "creativecommons", r"creativecommons org publicdomain zero 1 0", "cc0", TEXT, 1.0),
    Rule("cc-by-version", "cc", r"cc by [1-4] 0", "cc-by", TEXT, 0.9),
    Rule("cc-by-sa-short", "cc", r"cc by sa(?: [1-4] 0)?", "cc-by-sa", TEXT, 0.9),
    Rule("cc-by-nd-short", "cc", r"cc by nd(?: [1-4] 0)?", "cc-by-nd", TEXT, 0.9),
    Rule("cc-by-nc-sa-short", "cc", r"cc by nc sa(?: [1-4] 0)?", "cc-by-nc-sa", TEXT, 0.95),
    Rule("cc-by-nc-nd-short", "cc", r"cc by nc nd(?: [1-4] 0)?", "cc-by-nc-nd", TEXT, 0.95),
    Rule("all-rights", "rights", r"all rights reserved", "all-rights-reserved", HINT, 0.4),
    Rule("proprietary", "proprietary", r"proprietary and confidential", "proprietary", HINT, 0.6),
    Rule("unauthorised", "unauthorized", r"unauthorized (?:copying|use|distribution) (?:of this file )?is (?:strictly )?prohibited", "proprietary", HINT, 0.6),
    Rule("see-license", "license", r"see (?:the )?license(?: file| txt| md)? for (?:more )?(?:details|information)", "unknown-license", HINT, 0.3),
    Rule("license-file", "license", r"license that can be found in the license file", "unknown-license", HINT, 0.3),
    Rule("dual", "licensed", r"(?:dual|triple|multi) licensed", "unknown-license", HINT, 0.3),
]


def all_rules() -> list[Rule]:
    """Every rule: the base phrases, each licence name in each form, and the texts known by their words."""
    named = [
        Rule(f"{label}-{gate}-{form}-{number}", gate, around.format(f"(?:{name})"), label, priority, weight)
        for number, (label, gate, name) in enumerate(NAMES)
        for form, around, priority, weight in FORMS
    ]
    return BASE_RULES + OWN_RULES + named
