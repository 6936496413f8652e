"""License texts, headers, titles and common wordings: (license, wording), a license in many forms.

MIT and Zlib stand here whole; ISC, BSD and Unlicense up to a part of their disclaimers or grounds.  Of the long ones (Apache, GNU, Mozilla, Creative Commons) there are
the headers that their texts prescribe and the title lines that begin the texts.
"""

from __future__ import annotations

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."""

_GNU = {
    "GPL": ("GNU General Public License", {"2": "June 1991", "3": "29 June 2007"}),
    "LGPL": ("GNU Lesser General Public License", {"2.1": "February 1999", "3": "29 June 2007"}),
    "AGPL": ("GNU Affero General Public License", {"3": "19 November 2007"}),
}
_CC = {
    "CC-BY": "Attribution", "CC-BY-SA": "Attribution-ShareAlike", "CC-BY-NC": "Attribution-NonCommercial",
    "CC-BY-ND": "Attribution-NoDerivatives", "CC-BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "CC-BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_NAMES = [
    ("MIT", "MIT License"), ("ISC", "ISC License"), ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache 2.0 License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("MPL-2.0", "Mozilla Public License 2.0"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
]

# Names that need no "License" after them, and what they stand for.
SHORT_NAMES = {
    "MIT": "MIT", "ISC": "ISC", "Apache 2.0": "Apache-2.0", "Apache-2.0": "Apache-2.0", "BSD 3-Clause": "BSD-3-Clause",
    "BSD-3-Clause": "BSD-3-Clause", "BSD 2-Clause": "BSD-2-Clause", "BSD-2-Clause": "BSD-2-Clause", "GPLv2": "GPL-2.0",
    "GPLv3": "GPL-3.0", "LGPLv3": "LGPL-3.0", "AGPLv3": "AGPL-3.0", "MPL 2.0": "MPL-2.0", "MPL-2.0": "MPL-2.0",
}


def _forms() -> list[tuple[str, str]]:
    out = [
        ("MIT", _MIT), ("ISC", _ISC), ("BSD-2-Clause", _BSD_HEAD + _BSD_END), ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_END),
        ("Zlib", _ZLIB), ("Unlicense", _UNLICENSE), ("Apache-2.0", _APACHE), ("MPL-2.0", _MPL),
        ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("MPL-2.0", "Mozilla Public License Version 2.0"),
        ("CC0-1.0", "CC0 1.0 Universal"),
    ]
    names = list(_NAMES)
    for short, (name, versions) in _GNU.items():
        for version, date in versions.items():
            known = f"{short}-{version if '.' in version else version + '.0'}"
            out.append((known, f"{name} Version {version}, {date}"))
            out.append((known, f"under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."))
            out.append((known, f"under the terms of the {name} as published by the Free Software Foundation; version {version} of the License."))
            names += [(known, f"{name}, version {version}"), (known, f"{name} v{version}"), (known, f"{short} v{version}"), (known, f"{short}v{version}")]
    for verb in ("licensed under the", "released under the", "distributed under the", "available under the", "under the terms of the"):
        out += [(known, f"{verb} {name}") for known, name in names]
    for short, known in SHORT_NAMES.items():
        out += [(known, f"licensed under {short}"), (known, f"License: {short}"), (known, f"{short} licensed")]
    for short, name in _CC.items():
        for version in ("4.0", "3.0"):
            out.append((f"{short}-{version}", f"Creative Commons {name} {version}"))
            out.append((f"{short}-{version}", f"under {short[:2]} {short[3:]} {version}"))
    return out


FORMS = tuple(_forms())
# SPDX identifiers whose license goes by a shorter name here.
SPDX_SUFFIX = ("-only", "-or-later", "+")
# Words of the licenses' names: where a form writes them with a capital, they must stand as they are.
NAME_WORDS = frozenset(
    word.lower()
    for name in [*(n for _, n in _NAMES), *(n for n, _ in _GNU.values()), *_GNU, *_CC, *_CC.values(), *SHORT_NAMES, "Creative Commons", "CC0 Universal"]
    for word in name.replace(",", "").split()
) - {"license", "version"}
# SPDX identifiers that are confirmed besides those of the forms (fixed values).
OTHER_IDENTIFIERS = (
    "0BSD", "AFL-3.0", "Artistic-2.0", "BSD-4-Clause", "BSL-1.0", "CDDL-1.0", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2",
    "GFDL-1.3", "GPL-1.0", "LGPL-2.0", "LPPL-1.3c", "MIT-0", "MPL-1.1", "MS-PL", "MS-RL", "NCSA", "ODbL-1.0", "OFL-1.1",
    "OSL-3.0", "PostgreSQL", "PSF-2.0", "Python-2.0", "UPL-1.0", "WTFPL", "X11", "ZPL-2.1", "curl",
)
