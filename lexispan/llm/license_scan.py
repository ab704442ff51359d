"""Licence scans: normalised sentences become identifiers, and identifier sequences match ordered licence rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known licence sentences, normalised (lower case, runs of other characters than letters, digits and
#: dots as one space, no space or dot at the ends), by identifier.
SENTENCES = {
    "mit-released": ("released under the mit license", "licensed under the mit license", "this software is licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license"),
    "mit-title": ("mit license", "the mit license", "the mit license mit"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit-notice-next": ("the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software",),
    "as-is": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "as-is-liability": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "mit-0-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    "0bsd-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "isc-disclaimer": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "isc-title": ("isc license", "the isc license"),
    "apache-2-licensed": ("licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license", "released under the apache license version 2.0", "this work is licensed under the apache license version 2.0"),
    "apache-2-header": ("licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    "apache-2-asf": ("the asf licenses this file to you under the apache license version 2.0 the license you may not use this file except in compliance with the license",),
    "apache-2-title": ("apache license version 2.0", "apache license", "apache license version 2.0 january 2004", "apache license version 2.0 january 2004 http www.apache.org licenses"),
    "apache-2-comply": ("you may not use this file except in compliance with the license",),
    "apache-2-copy": ("you may obtain a copy of the license at", "you may obtain a copy of the license at http www.apache.org licenses license 2.0", "you may obtain a copy of the license at https www.apache.org licenses license 2.0"),
    "apache-2-basis": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "gpl-3-licensed": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"),
    "gpl-2-licensed": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2"),
    "gpl-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "gpl-2-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "gpl-2-only-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license"),
    "gpl-3-only-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license",),
    "gpl-hope": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "gpl-see": ("see the gnu general public license for more details",),
    "gpl-copy": ("you should have received a copy of the gnu general public license along with this program", "you should have received a copy of the gnu general public license along with this program if not see http www.gnu.org licenses", "you should have received a copy of the gnu general public license along with this program if not see https www.gnu.org licenses"),
    "lgpl-3-licensed": ("licensed under the gnu lesser general public license version 3",),
    "lgpl-3-free": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    "lgpl-2.1-free": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",),
    "lgpl-hope": ("this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "agpl-3-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation version 3 of the license or at your option any later version"),
    "mpl-2-licensed": ("this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0"),
    "mpl-2-copy": ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    "bsd-redistribute": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-advertise": ("all advertising materials mentioning features or use of this software must display the following acknowledgement",),
    "bsd-endorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd-as-is": ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "bsd-licensed": ("licensed under the bsd license", "released under the bsd license"),
    "zlib-as-is": ("this software is provided as is without any express or implied warranty",),
    "zlib-grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "boost-title": ("boost software license version 1.0", "boost software license version 1.0 august 17th 2003", "distributed under the boost software license version 1.0"),
    "unlicense-free": ("this is free and unencumbered software released into the public domain",),
    "cc0-dedicated": ("to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "licensed under cc0 1.0"),
    "cc-by-licensed": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    "cc-by-sa-licensed": ("licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    "cc-by-nc-licensed": ("licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    "epl-2-licensed": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0",),
    "reserved": ("all rights reserved",),
}
#: Names behind a licence tag of a source file, which is a sentence of its own.
TAGGED = ("MIT", "MIT-0", "ISC", "0BSD", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "MPL-2.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
SENTENCES |= {f"tag-{name.lower()}": (f"spdx license identifier {name.lower().replace('-', ' ')}",) for name in TAGGED}
#: Rules in the order in which they claim identifiers; longer sequences come first.
RULES = (
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "as-is", "as-is-liability")),
    ("MIT", ("mit-grant", "mit-notice", "as-is", "as-is-liability")),
    ("MIT", ("mit-grant", "mit-notice-next", "as-is", "as-is-liability")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice-next", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT-0", ("mit-0-grant", "as-is")),
    ("ISC", ("isc-title", "isc-grant", "isc-disclaimer")),
    ("ISC", ("isc-grant", "isc-disclaimer")),
    ("0BSD", ("0bsd-grant", "isc-disclaimer")),
    ("Apache-2.0", ("apache-2-header", "apache-2-asf", "apache-2-copy", "apache-2-basis")),
    ("Apache-2.0", ("apache-2-header", "apache-2-copy", "apache-2-basis")),
    ("Apache-2.0", ("apache-2-asf", "apache-2-copy", "apache-2-basis")),
    ("Apache-2.0", ("apache-2-licensed", "apache-2-comply", "apache-2-copy", "apache-2-basis")),
    ("Apache-2.0", ("apache-2-licensed", "apache-2-comply")),
    ("AGPL-3.0-or-later", ("agpl-3-free", "gpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl-3-free", "lgpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl-2.1-free", "lgpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl-2-free", "gpl-hope", "gpl-see", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-2-free", "gpl-hope")),
    ("GPL-3.0-only", ("gpl-3-only-free", "gpl-hope")),
    ("GPL-2.0-only", ("gpl-2-only-free", "gpl-hope")),
    ("MPL-2.0", ("mpl-2-licensed", "mpl-2-copy")),
    ("BSD-4-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-advertise")),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    *((name, (f"tag-{name.lower()}",)) for name in TAGGED),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-title",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-title",)),
    ("Apache-2.0", ("apache-2-header",)),
    ("Apache-2.0", ("apache-2-asf",)),
    ("Apache-2.0", ("apache-2-licensed",)),
    ("Apache-2.0", ("apache-2-title",)),
    ("GPL-3.0-only", ("gpl-3-licensed",)),
    ("GPL-2.0-only", ("gpl-2-licensed",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl-2-free",)),
    ("GPL-3.0-only", ("gpl-3-only-free",)),
    ("GPL-2.0-only", ("gpl-2-only-free",)),
    ("AGPL-3.0-or-later", ("agpl-3-free",)),
    ("LGPL-3.0-only", ("lgpl-3-licensed",)),
    ("LGPL-3.0-or-later", ("lgpl-3-free",)),
    ("LGPL-2.1-or-later", ("lgpl-2.1-free",)),
    ("MPL-2.0", ("mpl-2-licensed",)),
    ("BSD-2-Clause", ("bsd-redistribute",)),
    ("BSD", ("bsd-licensed",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-title",)),
    ("Unlicense", ("unlicense-free",)),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("EPL-2.0", ("epl-2-licensed",)),
    ("CC-BY-4.0", ("cc-by-licensed",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-licensed",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-licensed",)),
    ("All-Rights-Reserved", ("reserved",)),
)
#: Rewriting before sentences are cut, in order; Java and RE2 read it alike. Line ends become one; marks of
#: comments and quotes go from the front of lines, and those that close a comment from their ends; lines of a copyright, a
#: licence tag or a title stand alone; the point of a short "v." goes.
UNWRAPPED = (
    (r"\r\n?", "\n"),
    (r"\n[ \t]*(?:/\*+|//+|#+|\*+|;+|--+|%+|>+|<!--|dnl |rem )?[ \t]*", "\n"),
    (r"[ \t]*(?:\*+/|-->)", ""),
    (r"\n((?:copyright[ \t]+(?:\(c\)|©|[0-9]{4})|\(c\) |©|spdx-license-identifier:|all rights reserved)[^\n]*)", "\n\n\\1\n\n"),
    (r"\n((?:the )?(?:mit|isc|apache) license(?: \(mit\))?)[ \t]*\n", "\n\n\\1\n\n"),
    (r"(copyright[^\n.]*[0-9][^\n.]*?)\.? (all rights reserved)", "\\1\n\n\\2\n\n"),
    (r"([ \n]v)\.[ \n]*([0-9])", "\\1 \\2"),
)
#: A sentence ends at these marks before white space, at blank lines, and at a colon or semicolon before a line end or a list's mark.
SENTENCE_END = r"[.!?]+[ \t\n]+|\n\n+|[:;][ \t]*\n+|[:;][ \t\n]+[(]?[0-9a-z]{1,2}[.)][ \t]+"
#: Every known sentence has one of these; other texts hold no identifier.
QUICK = ("licens", "permission", "copyright", "warrant", "redistrib", "rights reserved", "neither the name", "you may", "unless required", "free software", "public domain", "distributed", "advertising")


def recognise(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sentences: dict[str, tuple[str, ...]] = SENTENCES, rules: tuple = RULES, quick: tuple[str, ...] = QUICK) -> DataFrame:
    """(id, sentence_ids, licenses, n_licenses) for every whole text.

    Sentences may be wrapped over lines and stand in comments; where a sentence isn't known, each
    of its lines may be one. `sentence_ids` lists the
    identifiers in the order of the text; `licenses` those of the rules that matched, in the
    rules' order, each once. A rule matches where its identifiers follow each other, and
    takes them away from later rules. `sentences` (normalised), `rules` and `quick` (of which each sentence
    must hold one) can be replaced. Null and empty texts give empty strings and 0; repeated
    rows and null ids give a row each; other columns don't matter; an empty table gives no
    rows. No row leaves its task: there is no shuffle.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    likely = F.lit(False)
    for word in quick:
        likely = likely | low.contains(word)
    flat = F.concat(F.lit("\n"), low)
    for pattern, new in UNWRAPPED:
        flat = F.regexp_replace(flat, pattern, new.replace("\\1", "$1").replace("\\2", "$2"))
    normal = lambda s: F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9.]+", " "), r"^[ .]+|[ .]+$", "")
    by_name = F.create_map(*[F.lit(x) for name, texts in sentences.items() for t in texts for x in (t, f"<{name}>")])
    known = lambda s: F.try_element_at(by_name, normal(s))
    found = F.flatten(F.transform(F.split(flat, SENTENCE_END), lambda s: F.when(known(s).isNotNull(), F.array(known(s))).otherwise(F.transform(F.split(s, "\n"), known))))
    marks = F.filter(found, lambda x: x.isNotNull())
    found = docs.select(F.col(id_col), F.when(likely, F.array_join(marks, "")).otherwise("").alias("marks"))
    # rules claim identifiers in turn: what a rule takes is cut out of the rest, and its name is noted
    claims = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{x}>" for x in sequence)).alias("of")) for name, sequence in rules])
    start = F.struct(F.col("marks").alias("rest"), F.array().cast("array<string>").alias("names"))

    def claim(state, rule):
        hit = F.contains(state["rest"], rule["of"])
        return F.when(hit, F.struct(F.replace(state["rest"], rule["of"], F.lit("#")).alias("rest"), F.array_append(state["names"], rule["name"]).alias("names"))).otherwise(state)

    names = F.when(F.col("marks") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.aggregate(claims, start, claim, lambda s: s["names"])))
    out = found.select(id_col, F.translate(F.regexp_replace("marks", "><", ","), "<>", "").alias("sentence_ids"), names.alias("names"))
    return out.select(id_col, "sentence_ids", F.array_join("names", ",").alias("licenses"), F.size("names").alias("n_licenses"))


def recognise_sql() -> str:
    """DuckDB SQL for `recognise` over `documents`."""
    quick = " OR ".join(f"contains(low, '{w}')" for w in QUICK)
    known = ", ".join(f"'{t}': '<{name}>'" for name, texts in SENTENCES.items() for t in texts)
    mark = f"MAP {{{{{known}}}}}[regexp_replace(regexp_replace({{0}}, '[^a-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')]"
    flat = "chr(10) || low"
    for pattern, new in UNWRAPPED:
        flat = "regexp_replace({}, '{}', '{}', 'g')".format(flat, pattern, new)
    stages, at = [], "marked"
    for i, (_, sequence) in enumerate(RULES):
        p = "".join(f"<{x}>" for x in sequence)
        stages.append(f"r{i} AS (SELECT * EXCLUDE (marks), contains(marks, '{p}') AS hit{i}, replace(marks, '{p}', '#') AS marks FROM {at})")
        at = f"r{i}"
    hits = ", ".join(f"CASE WHEN hit{i} THEN '{name}' END" for i, (name, _) in enumerate(RULES))
    return f"""
WITH lowered AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents),
flat AS (SELECT doc_id, low, {flat} AS flat FROM lowered),
marked AS (SELECT doc_id, CASE WHEN {quick} THEN array_to_string(list_filter(flatten(list_transform(regexp_split_to_array(flat, '{SENTENCE_END}'),
    lambda s: CASE WHEN {mark.format('s')} IS NOT NULL THEN [{mark.format('s')}] ELSE list_transform(string_split(s, chr(10)), lambda l: {mark.format('l')}) END)), lambda x: x IS NOT NULL), '') ELSE '' END AS marks FROM flat),
named AS (SELECT *, replace(replace(replace(marks, '><', ','), '<', ''), '>', '') AS sentence_ids FROM marked),
{', '.join(s.replace('FROM marked)', 'FROM named)') for s in stages)},
found AS (SELECT doc_id, sentence_ids, list_filter([{hits}], lambda x: x IS NOT NULL) AS names FROM {at}),
once AS (SELECT doc_id, sentence_ids, list_filter(names, lambda x, i: list_position(names, x) = i) AS names FROM found)
SELECT doc_id, sentence_ids, coalesce(array_to_string(names, ','), '') AS licenses, CAST(len(names) AS INTEGER) AS n_licenses FROM once"""
