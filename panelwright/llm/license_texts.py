"""Public licence texts and notices that are looked up by digest, and words with equivalent spellings.

Long texts are files of the folder licences; the driver reads them when this module is loaded.
"""

from __future__ import annotations

import re
from pathlib import Path

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: Whole texts, by the name of the licence.
FILES = {p.name: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licences").iterdir()) if p.is_file()}

#: Addresses of the Free Software Foundation that copies of its older licences bear.
_ADDRESS = re.compile(r"51\s+Franklin\s+(?:Street|St),\s+Fifth\s+Floor,\s+Boston,?\s+MA\s+02110-1301,?\s+USA")
_ADDRESSES = ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301, USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA", "675 Mass Ave, Cambridge, MA 02139, USA", "<https://fsf.org/>")
#: Where the terms end and instructions begin; either part may be left out of a copy.
_END = re.compile(r"END OF TERMS AND CONDITIONS|(?m:^ADDENDUM: How to use)|(?m:^Exhibit A - Source Code Form)|(?m:^EXHIBIT A -Mozilla)")


def _versions(text: str) -> set[str]:
    """A whole text with and without instructions, with the addresses it is spread with, and with longer lines.

    The canonical form drops lines of copyright, so it is not the same where lines are joined.
    """
    out = {text}
    if end := _END.search(text):
        out |= {text[: end.start()]} | ({text[: end.end()]} if end[0].startswith("END") else set())
    joined = {re.sub(r"(?<=\S)[ \t]*\n[ \t]*(?=\S)", " ", t) for t in out} | {" ".join(t.split()) for t in out}
    out |= {_ADDRESS.sub(a, t) for t in out for a in _ADDRESSES} | joined
    return out | {t.replace("http://", "https://") for t in out}


def _notice(text: str, first: str, last: str) -> str:
    """The standard notice that a licence's instructions give, from the words first to last."""
    at = text.rindex(first)
    return text[at : text.index(last, at) + len(last)]


def _notices() -> list[tuple[str, str]]:
    out = [("MPL-2.0", _notice(FILES["MPL-2.0"], "This Source Code Form is subject", "mozilla.org/MPL/2.0/."))]
    ends = {"GPL-2.0": "USA.", "GPL-3.0": "licenses/>.", "LGPL-2.0": "USA", "LGPL-2.1": "USA"}
    for name, last in ends.items():
        kind = "library" if name[0] == "L" else "program"
        out.append((name, _notice(FILES[name], f"This {kind} is free software", last)))
    out.append(("AGPL-3.0", re.sub("General Public", "Affero General Public", out[2][1])))
    out.append(("LGPL-3.0", re.sub(r"General(\s+)Public", r"Lesser General\1Public", out[2][1])))
    for name, notice in tuple(out):
        out += [(name, v) for v in _versions(notice)]
        if "free software" in notice:  # its first sentence alone
            out.append((name, notice[: notice.index("any later version.") + len("any later version.")]))
    return out


def _names() -> list[tuple[str, str]]:
    """(licence, name) as they are called in lines."""
    out = [(n, n) for n in (*FILES, "0BSD", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "EPL-2.0", "ISC", "MIT", "Unlicense", "Zlib")]
    out += [("MIT", "MIT License"), ("ISC", "ISC License"), ("Zlib", "zlib License"), ("Unlicense", "The Unlicense"), ("0BSD", "BSD Zero Clause License"), ("BSL-1.0", "Boost Software License"), ("BSL-1.0", "Boost Software License, Version 1.0")]
    out += [("Apache-2.0", f"Apache {n}") for n in ("License, Version 2.0", "License 2.0", "2.0", "2.0 License", "License v2.0", "Software License, Version 2.0")]
    out += [(f"BSD-{n}-Clause", f"{k} {x}") for n, words in ((2, ("Simplified",)), (3, ("New", "Modified"))) for k in (f"BSD {n}-Clause", f"{n}-Clause BSD", *(f"{w} BSD" for w in words)) for x in ("", "License")]
    gnu = {"GPL": "General", "LGPL": "Lesser General", "AGPL": "Affero General"}
    for name in (*FILES, "AGPL-3.0"):
        kind, _, version = name.partition("-")
        if kind in gnu:
            called = "Library General" if name == "LGPL-2.0" else gnu[kind]
            short = version.removesuffix(".0")
            out += [(name, f"{name}{x}") for x in ("-only", "-or-later")]
            out += [(name, f"{g}{called} Public License{x}") for g in ("GNU ", "") for v in {version, short} for x in (f", version {v}", f" v{v}", f" {v}", f", version {v} or later", f" v{v} or later", f", version {v} only", f", version {v} or (at your option) any later version")]
            out += [(name, f"{g}{kind}{x}{y}") for g in ("GNU ", "") for v in {version, short} for x in (f"v{v}", f" v{v}", f" {v}", f" version {v}") for y in ("", " or later", " License")]
    out += [(f"MPL-{v}", f"{k} {x}{v}") for v in ("1.1", "2.0") for k in ("Mozilla Public License", "MPL") for x in ("", "v. ", "v", "Version ")]
    out += [(f"EPL-{v}", f"{k} {x}{v}") for v in ("1.0", "2.0") for k in ("Eclipse Public License", "EPL") for x in ("", "v. ", "v", "- v ", "Version ")]
    out += [(f"GFDL-{v}", f"{k} {x}{v}") for v in ("1.2", "1.3") for k in ("GNU Free Documentation License,", "GFDL") for x in ("", "v", "Version ")]
    out += [("CC0-1.0", n) for n in ("CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal License")]
    out += [("PSF-2.0", "Python Software Foundation License Version 2"), ("PSF-2.0", "PSF License Version 2"), ("Artistic-1.0-Perl", "Artistic License 1.0 (Perl)")]
    parts = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
    for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
        for version, where in (("4.0", "International"), ("3.0", "Unported")):
            name = f"CC-{kind}-{version}"
            words = "-".join(parts[k] for k in kind.split("-"))
            spelt = {words, words.replace("NonCommercial", "Non-Commercial").replace("ShareAlike", "Share Alike").replace("NoDerivatives", "NoDerivs")}
            out += [(name, n) for n in (name, f"CC {kind} {version}", f"{name} License", f"CC {kind} {version} License")]
            out += [(name, f"Creative Commons {w} {version}{x}{y}") for w in spelt for x in ("", f" {where}") for y in ("", " License", " Public License")]
    return out


def _lines() -> list[tuple[str, str]]:
    """Lines that state a licence by its name."""
    names = {re.sub(r"[\W_]+", " ", name.lower()).strip(): (licence, name) for licence, name in reversed(_names())}
    heads = [f"{thing}{done} under" for thing, done in (("", "Licensed"), ("", "Released"), ("", "Distributed"), *((f"This {x} is ", "licensed") for x in ("work", "software", "program", "project", "file")))]
    out = []
    for licence, name in names.values():
        out += [(licence, f"{head}{name}") for head in ("SPDX-License-Identifier: ", "License: ")]
        articles = ("", "the ", "a ") if name.startswith("Creative") else ("", "the ", "the terms of the ")
        out += [(licence, f"{head} {article}{name}") for head in heads for article in articles]
    return out


_FULL = [(name, version) for name, text in FILES.items() for version in sorted(_versions(text))]

#: (licence, text) of whole licences; a licence may have several texts.
WHOLE = (
    *_FULL,
    ("0BSD", ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License\n" + MIT),
    ("Unlicense", UNLICENSE),
    ("Zlib", ZLIB),
)

#: (licence, text) of notices and lines that state a licence without being its text.
STATEMENTS = (
    *_notices(),
    *_lines(),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
)
TEXTS = (*WHOLE, *STATEMENTS)

#: (variant, word): spellings that licence matching treats as equal, in lower case.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
