"""The licenses looked for: whole texts (packaged files), notices, and the words of license lines and tags."""

from __future__ import annotations

from importlib import resources
from itertools import product

# Notices of source files, without names, years and addresses that differ from work to work.
NOTICES = {
    "GPL-2.0 notice": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License version 2 as published by the Free Software Foundation."],
    "GPL-3.0 notice": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."],
    "LGPL-2.1 notice": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version."],
    "LGPL-3.0 notice": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version."],
    "AGPL-3.0 notice": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version."],
    "GFDL notice": [
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation "
        "License, Version 1.3 or any later version published by the Free Software Foundation"],
    "MPL-2.0 notice": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at"],
    "EPL-2.0 notice": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at"],
    "EPL-1.0 notice": [
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse "
        "Public License v1.0 which accompanies this distribution, and is available at"],
    "BSL-1.0 notice": ["Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at"],
    "BSD notice": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "MIT notice": [
        "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file"],
    "ASF notice": [
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE "
        "file distributed with this work for additional information regarding copyright ownership. The ASF licenses this "
        "file to You under the Apache License, Version 2.0"],
}

# Words before the name of a license: "under the terms of the MIT license".
LEADS = [f"under {of}{article}" for of in ("", "terms of ", "the terms of ", "the terms and conditions of ")
         for article in ("", "the ", "a ", "an ")]
# Names as they stand after "license:" and "under", with and without the word license behind them.
_LICENSE = (" license", " licence")


def _versions(names: list[str], version: str) -> list[str]:
    """Names with a version number in its usual forms: 3, v3, 3.0, version 3, version 3.0, v 3."""
    short = version.removesuffix(".0")
    numbers = dict.fromkeys(f"{word}{n}" for n in (short, version) for word in ("", "v", "v ", "v. ", "version "))
    return [f"{a} {n}" for a, n in product(names, numbers)]


_GPL = ["GNU General Public License", "GNU GPL", "GPL", "General Public License"]
_LGPL = ["GNU Lesser General Public License", "GNU LGPL", "LGPL", "Lesser General Public License"]
_AGPL = ["GNU Affero General Public License", "GNU AGPL", "AGPL", "Affero General Public License"]
_APACHE = ["Apache", "Apache License", "Apache Software License", "Apache Public License", "ASL"]

# License to names that say which one is meant without the word license behind them.
NAMES = {
    "Apache-2.0": _versions(_APACHE, "2.0"),
    "GPL-1.0": _versions(_GPL, "1.0"),
    "GPL-2.0": [*_versions(_GPL, "2.0"), "GPLv2", "GNU GPLv2"],
    "GPL-3.0": [*_versions(_GPL, "3.0"), "GPLv3", "GNU GPLv3"],
    "GPL": _GPL,
    "LGPL-2.0": [*_versions(["GNU Library General Public License"], "2.0"), *_versions(_LGPL, "2.0")],
    "LGPL-2.1": [*_versions(_LGPL, "2.1"), "LGPLv2.1", "GNU LGPLv2.1"],
    "LGPL-3.0": [*_versions(_LGPL, "3.0"), "LGPLv3", "GNU LGPLv3"],
    "LGPL": _LGPL,
    "AGPL-3.0": [*_versions(_AGPL, "3.0"), "AGPLv3", "GNU AGPLv3"],
    "AGPL": _AGPL,
    "GFDL": ["GNU Free Documentation License", "GFDL", "GNU FDL"],
    "MPL-1.1": _versions(["Mozilla Public License", "MPL"], "1.1"),
    "MPL-2.0": _versions(["Mozilla Public License", "MPL"], "2.0"),
    "MPL": ["Mozilla Public License"],
    "EPL-1.0": _versions(["Eclipse Public License", "EPL"], "1.0"),
    "EPL-2.0": _versions(["Eclipse Public License", "EPL"], "2.0"),
    "EPL": ["Eclipse Public License"],
    "CDDL-1.0": [*_versions(["Common Development and Distribution License", "CDDL"], "1.0"),
                 "Common Development and Distribution License"],
    "BSL-1.0": [*_versions(["Boost Software License"], "1.0"), "Boost Software License"],
    "OFL-1.1": [*_versions(["SIL Open Font License", "OFL"], "1.1"), "SIL Open Font License"],
    "PSF-2.0": ["Python Software Foundation License", "PSF License"],
    "Artistic-2.0": [*_versions(["Artistic License"], "2.0")],
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero", "Creative Commons CC0"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL"],
    "BSD-2-Clause": ["BSD 2-Clause", "2-clause BSD", "Simplified BSD", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause", "3-clause BSD", "New BSD", "Modified BSD", "Revised BSD"],
    "BSD-4-Clause": ["BSD 4-Clause", "4-clause BSD"],
    **{f"CC-{code}-{v}": [*(f"{a} {code} {v}" for a in ("CC", "Creative Commons")),
                          *(f"Creative Commons {words}{mid}{v}{tail}" for mid in (" ", " License ")
                            for tail in ("", " International", " Unported", " International License"))]
       for code, words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
                           ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                           ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
       for v in ("2.0", "2.5", "3.0", "4.0")},
}
# Names that are common words: counted with the word license behind them, or before them with a colon or "licensed".
PLAIN = {"MIT": ["MIT", "Expat", "MIT/X11", "MIT/Expat", "X11"], "BSD": ["BSD", "BSD-style"], "ISC": ["ISC"], "Zlib": ["zlib", "zlib/libpng"],
         "Apache": ["Apache", "Apache Software"], "Artistic": ["Artistic"], "Unlicense": ["Unlicense"], "MIT-0": ["MIT-0", "MIT No Attribution"],
         "0BSD": ["0BSD", "Zero-Clause BSD"]}
# Identifiers after "SPDX-License-Identifier:" and "License:" besides the keys of NAMES and PLAIN.
IDENTIFIERS = ["GFDL-1.2", "GFDL-1.3", "Artistic-1.0-Perl", "CC0-1.0", "EUPL-1.2", "MS-PL", "PostgreSQL", "Python-2.0", "NCSA", "OSL-3.0",
               "AFL-3.0", "CECILL-2.1", "OpenSSL", "curl", "ICU", "W3C", "Unicode-3.0", "LPPL-1.3c", "ODbL-1.0", "BUSL-1.1", "SSPL-1.0"]


def texts() -> dict[str, list[str]]:
    """Template name to whole text, read by the driver from the package."""
    folder = resources.files(__package__) / "license_texts"
    return {f"{f.name.removesuffix('.txt')} text": [f.read_text(encoding="utf-8")]
            for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


def lines() -> dict[str, str]:
    """Phrase to template name. A phrase is matched whole, word by word, without case and punctuation."""
    out: dict[str, str] = {}

    def put(name: str, phrases) -> None:
        for p in phrases:
            out.setdefault(p, name)

    for license_, names in NAMES.items():
        ends = [n + e for n in names for e in ("", *_LICENSE)]
        put(f"{license_} line", (f"{lead}{n}" for lead in LEADS for n in ends))
        put(f"{license_} line", (f"{a}{n}" for a in ("license: ", "licence: ", "licensed ", "licenced ") for n in names))
    for license_, names in PLAIN.items():
        ends = [n + e for n in names for e in _LICENSE]
        put(f"{license_} line", (f"{lead}{n}" for lead in LEADS for n in ends))
        put(f"{license_} line", (f"{n} {d}" for n in names for d in ("licensed", "licenced")))
        put(f"{license_} line", (f"{a}{n}" for a in ("license: ", "licence: ") for n in names))
    for license_ in [*NAMES, *PLAIN, *IDENTIFIERS]:
        forms = [license_ + e for e in ("", "-only", "-or-later", "+")]
        put(f"{license_} tag", (f"SPDX-License-Identifier: {f}" for f in forms))
        put(f"{license_} line", (f"license: {f}" for f in forms))
    return out
