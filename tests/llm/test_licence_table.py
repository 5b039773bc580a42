"""Whole licences and lines that name one are found, beyond those of the test documents."""

from __future__ import annotations

import re

import pytest

from panelwright.llm import license_scan
from panelwright.llm.license_texts import APACHE_NOTICE, FILES

LINES = {
    "SPDX-License-Identifier: AGPL-3.0-or-later": "AGPL-3.0", "This program is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1", "Released under the GPLv3": "GPL-3.0", "# License: Apache License 2.0": "Apache-2.0",
    "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0", "Licensed under the Mozilla Public License 2.0": "MPL-2.0",
    "This project is licensed under the 3-Clause BSD License.": "BSD-3-Clause", "Licensed under a permit.": "", "Licensed under the MIT": "MIT",
    'Licensed under the Apache License, Version 2.0 (the "License").': "Apache-2.0", "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT", "// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) AND MIT */": "GPL-2.0,MIT",
    "This project is licensed under the MIT License - see LICENSE.md": "MIT", "Licensed under the MIT License, please see the [LICENSE](LICENSE) file for details.": "MIT", "SPDX-License-Identifier: AGPL-3.0-only": "AGPL-3.0", "SPDX-License-Identifier: NONE OR ()": "",
}


def without_end(text: str, end: str) -> str:
    return text[: text.index(end)] if end in text else text


@pytest.fixture(scope="module")
def found(spark):
    rows = {}
    for name, text in FILES.items():
        rows[f"{name} whole"] = (name, "Copyright (c) 2024 A. Author\n" + text)
        rows[f"{name} on one line"] = (name, " ".join(text.split()).upper())
        rows[f"{name} by paragraphs"] = (name, "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", text)))
        rows[f"{name} terms"] = (name, without_end(text, "END OF TERMS AND CONDITIONS"))
        rows[f"{name} changed"] = (None, text + "\nAnd no more than that.")
    docs = spark.createDataFrame([(k, t) for k, (_, t) in rows.items()] + list(zip(LINES, LINES, strict=True)), "doc_id string, text string")
    return rows, {r.doc_id: r for r in license_scan.scan_licences(docs).collect()}


def test_whole_licences(found):
    rows, got = found
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Artistic-1.0-Perl", "EPL-1.0"} <= set(FILES)
    assert {k: got[k].licence for k in rows} == {k: name for k, (name, _) in rows.items()}


def test_lines_that_name_a_licence(found):
    _, got = found
    assert {k: got[k].notices for k in LINES} == LINES


def test_what_states_a_licence_is_not_its_text(found):
    _, got = found
    assert {got[k].licence for k in LINES} == {None}


def test_a_wrapped_notice_alone_is_a_statement(spark):
    wrapped = APACHE_NOTICE.replace(", ", ",\n")
    row = license_scan.scan_licences(spark.createDataFrame([(1, wrapped)], "doc_id long, text string")).first()
    assert row.licence is None and row.notices == "Apache-2.0"
