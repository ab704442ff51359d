import re
import textwrap

import pytest

from lexispan.llm import license_scan as scan


def brute(text):
    known = {t: name for name, texts in scan.SENTENCES.items() for t in texts}
    flat = "\n" + (text or "").lower()
    for pattern, new in scan.UNWRAPPED:
        flat = re.sub(pattern, new, flat)
    normal = lambda s: re.sub(r"^[ .]+|[ .]+$", "", re.sub(r"[^a-z0-9.]+", " ", s))
    pieces = [x for s in re.split(scan.SENTENCE_END, flat) for x in ([s] if normal(s) in known else s.split("\n"))]
    marks = "".join(f"<{known[normal(s)]}>" for s in pieces if normal(s) in known)
    names, rest = [], marks
    for name, sequence in scan.RULES:
        p = "".join(f"<{x}>" for x in sequence)
        if p in rest and name not in names:
            names.append(name)
        rest = rest.replace(p, "#")
    return marks[1:-1].replace("><", ","), ",".join(names)


#: Licence texts as they stand in files, one paragraph to a line.
OFFICIAL = {
    "MIT": """The MIT License (MIT)
Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "Apache-2.0": """Copyright 2019 Some One

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.
""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.
""",
    "BSD-3-Clause": """Copyright (c) 2015, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.
""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
""",
}
FORMS = {"one line": "{}", "wrapped": "{}", "hash": "# {}", "star": " * {}", "slashes": "// {}", "dashes": "-- {}", "spaces": "    {}"}


def in_form(text, form, width=78):
    lines = text.split("\n") if form == "one line" else [w for line in text.split("\n") for w in textwrap.wrap(line, width) or [""]]
    body = "\n".join(FORMS[form].format(line).rstrip() for line in lines)
    return f"/*\n{body}\n */\nint x;" if form == "star" else body


def test_official_texts_in_all_forms(spark):
    cases = [(name, form, width) for name in OFFICIAL for form in FORMS for width in (50, 78)]
    texts = [in_form(OFFICIAL[n], f, w) for n, f, w in cases] + ["\r\n".join(in_form(OFFICIAL["MIT"], "wrapped").split("\n"))]
    rows = scan.recognise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r["doc_id"]: r for r in rows}
    for i, (name, form, width) in enumerate([*cases, ("MIT", "crlf", 78)]):
        names = found[i]["licenses"].split(",")
        assert names[0] == name and set(names) <= {name, "All-Rights-Reserved"}, (name, form, width, found[i])
        assert (found[i]["sentence_ids"], found[i]["licenses"]) == brute(texts[i])


@pytest.mark.parametrize("name", ["Apache-2.0", "MIT", "GPL-2.0-only", "BSD-3-Clause"])
def test_tags(spark, name):
    row = scan.recognise(spark.createDataFrame([(1, f"// SPDX-License-Identifier: {name}\nint main() {{}}")], "doc_id long, text string")).first()
    assert row["licenses"] == name


def test_own_rules(spark):
    docs = spark.createDataFrame([(1, "Use it as you like.\n\nBut give credit.")], "doc_id long, text string")
    row = scan.recognise(docs, sentences={"like": ("use it as you like",), "credit": ("but give credit",)}, rules=(("Own", ("like", "credit")),), quick=("use it", "credit")).first()
    assert (row["sentence_ids"], row["licenses"]) == ("like,credit", "Own")


MIT = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."


@pytest.mark.parametrize(
    "text, ids, names",
    [
        ("Hello. Released under the MIT License. Bye.", "mit-released", "MIT"),
        ("Licensed under the Apache License, Version 2.0.", "apache-2-licensed", "Apache-2.0"),
        ("x\nLicensed under CC BY-NC 4.0.\ny", "cc-by-nc-licensed", "CC-BY-NC-4.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3-licensed", "GPL-3.0-only"),
        (MIT, "mit-title,mit-grant,mit-notice", "MIT"),
        ("All rights reserved. Released under the MIT license.", "reserved,mit-released", "MIT,All-Rights-Reserved"),
        ("a license is a license", "", ""),
        (None, "", ""),
    ],
)
def test_rules(spark, text, ids, names):
    row = scan.recognise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["sentence_ids"], row["licenses"]) == (ids, names) == brute(text)
    assert row["n_licenses"] == len([n for n in names.split(",") if n])


def test_every_known_sentence_is_found_by_the_quick_words():
    for texts in scan.SENTENCES.values():
        for t in texts:
            assert any(w in t for w in scan.QUICK), t


def test_edges(edge, none):
    rows = scan.recognise(edge).collect()
    assert len(rows) == 13 and {r["licenses"] for r in rows} == {""}
    assert scan.recognise(none).count() == 0
