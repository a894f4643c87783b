"""Licence scans by sentence rules, in native expressions.

A text is cut into sentences; those with a licence keyword are normalised and
looked up in a fixed table of known licence sentences. The identifiers, in text
order, form a sequence on which ordered rules are matched: a rule's identifiers
must all occur in its order, other licence sentences may stand between. The
sentence table is a constant of this module, so no shuffle or join is needed:
one pass over each text.

A known sentence is also found where single line breaks (and the comment marks of
the next line) wrap it, or where a mark such as 'v. 2.0' would cut it: it stands
between the same cuts as any sentence and is then looked up whole. All other text
is cut at every line break.

Defined cases: a null or empty text has no sentences and no licence; repeated
rows each get their result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentence -> identifier.
SENTENCES = {
    "licensed under the apache license, version 2.0": "apache2",
    "licensed under the apache license, version 2.0 (the license)": "apache2grant",
    "you may not use this file except in compliance with the license": "apache2comply",
    "you may obtain a copy of the license at": "apache2copy",
    "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis": "apache2asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2see",
    "released under the mit license": "mitref",
    "licensed under the mit license": "mitref",
    "this project is licensed under the mit license": "mitref",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mitgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mitnotice",
    "the software is provided as is, without warranty of any kind, express or implied": "mitwarranty",
    "this work is licensed under the gnu general public license, version 3": "gpl3",
    "licensed under the gnu general public license, version 3": "gpl3",
    "licensed under the gnu general public license, version 2": "gpl2",
    "licensed under the gnu lesser general public license, version 2.1": "lgpl21",
    "licensed under the gnu affero general public license, version 3": "agpl3",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "gpl3grant",
    "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version": "gpl2grant",
    "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose": "gplwarranty",
    "see the gnu general public license for more details": "gplsee",
    "you should have received a copy of the gnu general public license along with this program": "gplcopy",
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsdgrant",
    "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "bsdsource",
    "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation": "bsdbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsdendorse",
    "licensed under the bsd license": "bsdref",
    "this source code form is subject to the terms of the mozilla public license, v. 2.0": "mpl2",
    "licensed under the mozilla public license, version 2.0": "mpl2",
    "licensed under cc by 4.0": "ccby4",
    "licensed under cc by-sa 4.0": "ccbysa4",
    "licensed under cc by-nc 4.0": "ccbync4",
    "licensed under cc by-nd 4.0": "ccbynd4",
    "licensed under cc by-nc-sa 4.0": "ccbyncsa4",
    "licensed under cc by-nc-nd 4.0": "ccbyncnd4",
    "this work is licensed under a creative commons attribution 4.0 international license": "ccby4",
    "dedicated to the public domain under cc0 1.0": "cc01",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "iscgrant",
    "all rights reserved": "reserved",
}

# Licence -> the ordered identifiers, any one list suffices.
RULES = {
    "Apache-2.0": [["apache2"], ["apache2grant", "apache2comply", "apache2copy"]],
    "MIT": [["mitref"], ["mitgrant", "mitnotice", "mitwarranty"]],
    "GPL-3.0": [["gpl3"], ["gpl3grant", "gplwarranty"]],
    "GPL-2.0": [["gpl2"], ["gpl2grant", "gplwarranty"]],
    "LGPL-2.1": [["lgpl21"]],
    "AGPL-3.0": [["agpl3"]],
    "BSD-3-Clause": [["bsdgrant", "bsdsource", "bsdbinary", "bsdendorse"]],
    "BSD": [["bsdref"]],
    "MPL-2.0": [["mpl2"]],
    "CC-BY-4.0": [["ccby4"]],
    "CC-BY-SA-4.0": [["ccbysa4"]],
    "CC-BY-NC-4.0": [["ccbync4"]],
    "CC-BY-ND-4.0": [["ccbynd4"]],
    "CC-BY-NC-SA-4.0": [["ccbyncsa4"]],
    "CC-BY-NC-ND-4.0": [["ccbyncnd4"]],
    "CC0-1.0": [["cc01"]],
    "ISC": [["iscgrant", "mitwarranty"]],
    "Proprietary": [["reserved"]],
}

# The sentences of whole licence texts, as SENTENCES; and more lists as in RULES.
COMPLETE = {
    "licensed under the apache license, version 2.0 (the license); you may not use this file except in compliance with the license": "apache2full",
    "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied": "apache2asis",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions": "mitgrant",
    "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement": "mitwarranty",
    "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "bsdbinary",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "iscgrant",
    "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "iscgrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "iscwarranty",
}
MORE_COMPLETE = {
    "if a copy of the mpl was not distributed with this file, you can obtain one at": "mplcopy",
    "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version": "lgpl21grant",
    "this library is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "lgpl3grant",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "lgpl3grant",
    "this library is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose": "gplwarranty",
    "licensed under the gnu lesser general public license, version 3": "lgpl3",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "agpl3grant",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "distributed under the boost software license, version 1.0": "boostref",
    "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the software) to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following": "boostgrant",
    "this software is provided as-is, without any express or implied warranty": "zlibwarranty",
    "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions": "zlibgrant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at": "epl2",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsdwarranty",
    "licensed under the bsd 2-clause license": "bsd2ref",
    "licensed under the bsd 3-clause license": "bsd3ref",
    "licensed under the isc license": "iscref",
    "licensed under the apache license 2.0": "apache2",
}
MORE_RULES = {
    "Apache-2.0": [["apache2full", "apache2copy"]],
    "ISC": [["iscgrant", "iscwarranty"], ["iscref"]],
    "LGPL-2.1": [["lgpl21grant", "gplwarranty"]],
    "AGPL-3.0": [["agpl3grant", "gplwarranty"]],
    "BSD-3-Clause": [["bsd3ref"]],
    "BSD-2-Clause": [["bsdgrant", "bsdsource", "bsdbinary"], ["bsd2ref"]],
    "LGPL-3.0": [["lgpl3"], ["lgpl3grant"]],
    "Unlicense": [["unlicense"]],
    "BSL-1.0": [["boostref"], ["boostgrant"]],
    "Zlib": [["zlibwarranty", "zlibgrant"]],
    "EPL-2.0": [["epl2"]],
}
#: A licence whose sentences are all in another one counts only without that.
UNLESS = {"BSD-2-Clause": "BSD-3-Clause"}


def tags() -> dict[str, str]:
    """Licence tags as sentences, one identifier for each licence."""
    spelt = lambda k: [k, f"{k}-only", f"{k}-or-later", f"{k}+"] if "GPL" in k else [k]
    return {f"spdx-license-identifier: {t.lower()}": f"tag{n}" for n, k in enumerate(all_rules()) if k not in ("BSD", "Proprietary") for t in spelt(k)}


def all_rules() -> dict[str, list[list[str]]]:
    return {k: RULES.get(k, []) + MORE_RULES.get(k, []) for k in dict.fromkeys([*RULES, *MORE_RULES])}


ALL_RULES = {k: [*lists, [f"tag{n}"]] for n, (k, lists) in enumerate(all_rules().items())}
KNOWN_SENTENCES = {**SENTENCES, **COMPLETE, **MORE_COMPLETE, **tags()}

# Fixed patterns. Every known sentence holds a keyword.
KEYWORD = "licen[sc]e|copyright|redistribut|permission|warrant|public domain|all rights reserved|\\bmpl\\b"
_ENDS = r"([.!?:])[ \t\r\n]+"
_BREAKS = "\n+"
_JUNK = r"""["'`*#/]+"""
_BLANK = "[ \t\r]+"
_EDGE = " .,;:!?-"


def normalized(sentence: Column) -> Column:
    """Lower case, without quotes and comment marks, single blanks, bare edges."""
    x = F.regexp_replace(F.lower(sentence), _JUNK, "")
    return F.btrim(F.regexp_replace(x, _BLANK, " "), F.lit(_EDGE))


def table_key(sentence: str) -> str:
    """normalized() of a constant."""
    return re.sub(_BLANK, " ", re.sub(_JUNK, "", sentence.lower())).strip(_EDGE)


def known_pattern() -> str:
    """One regex for all known sentences between two cuts, wrapped or not, the longest first."""
    junk = r"""["'`*#/]"""
    gap = rf"""(?:["'`*#/ \t\r]++(?:\n{_MARKS})?+|\n{_MARKS})"""
    word = lambda w: "".join(f"{junk}*+" if c == "/" else c if c.isalnum() else rf"{junk}*+\{c}" for c in w)
    listed = sorted(KNOWN_SENTENCES, key=lambda s: (-len(s), s))
    edge = r"""["'`*#/ \t\r.,;:!?-]"""
    # a break is looked for from the first sign of a run only, so runs of signs cost their length
    return rf"(?:^|\n|(?<!{edge})(?>{edge}*?[.!?:][ \t\r\n])){edge}*+(?i:" + "|".join(gap.join(map(word, s.split(" "))) for s in listed) + rf")(?={edge}*+(?:\n|\z)|{edge}*?[.!?:][ \t\r\n])"


_MARKS = r"""["'`*#/ \t\r;%-]*+"""
KNOWN = known_pattern()


def licence_sentences(text: Column) -> Column:
    """Normalised sentences that hold a licence keyword, in text order."""
    none = F.array().cast("array<string>")
    parts = F.arrays_zip(F.split(text, KNOWN, -1).alias("rest"), F.regexp_extract_all(text, F.lit(KNOWN), F.lit(0)).alias("known"))
    cut = lambda x: F.split(F.regexp_replace(x, _ENDS, "$1\n"), _BREAKS, -1)
    whole = lambda x: F.when(x.isNotNull(), F.array(F.regexp_replace(x, rf"\n{_MARKS}", " "))).otherwise(none)
    kept = F.filter(F.flatten(F.transform(parts, lambda p: F.concat(cut(p["rest"]), whole(p["known"])))), lambda s: F.lower(s).rlike(KEYWORD))
    return F.when(F.lower(text).rlike(f"{KEYWORD}|public|reserved"), F.transform(kept, normalized)).otherwise(none)


def identifiers(sentences: Column) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in KNOWN_SENTENCES.items() for x in (table_key(k), v)])
    return F.filter(F.transform(sentences, lambda s: F.element_at(known, s)), lambda i: i.isNotNull())


def rules_met(ids: Column) -> Column:
    """For each alternative of each licence whether its identifiers occur in order.

    One pass over the identifiers: each alternative counts how many of its own it
    has met so far, so a text of any length costs no recursion.
    """
    listed = [x for lists in ALL_RULES.values() for x in lists]
    wanted = F.array(*[F.array(*map(F.lit, x)) for x in listed])
    step = lambda met, i: F.zip_with(met, wanted, lambda n, x: F.when(F.get(x, n) == i, n + 1).otherwise(n))
    return F.zip_with(F.aggregate(ids, F.array_repeat(F.lit(0), len(listed)), step), wanted, lambda n, x: n == F.size(x))


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (with a keyword), n_unknown, sequence, licences."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), licence_sentences(text).alias("s"))
    found = found.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), identifiers(F.col("s")).alias("ids"))
    sequence = F.when(F.size("ids") > 0, F.concat(F.lit(";"), F.concat_ws(";", "ids"), F.lit(";"))).otherwise(F.lit(""))
    met = F.when(F.size("ids") > 0, rules_met(F.col("ids"))).alias("met")
    found = found.select("doc_id", "n_sentences", (F.col("n_sentences") - F.size("ids")).cast("bigint").alias("n_unknown"), sequence.alias("sequence"), met)
    at, whole = 0, {}
    for k, lists in ALL_RULES.items():
        whole[k] = F.exists(F.slice("met", at + 1, len(lists)), lambda x: x)
        at += len(lists)
    names = [F.when(whole[k] & ~whole[UNLESS[k]] if k in UNLESS else whole[k], F.lit(k)) for k in whole]
    return found.withColumn("licences", F.concat_ws(",", *names)).drop("met")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return scan_licences(table(spark, sf_dir, "documents"))


def rule_pattern(lists: list[list[str]]) -> str:
    """For the twin: one regex on ';a;b;c;' for a licence's alternatives."""
    return "|".join(";" + ";([a-z0-9]+;)*".join(ids) + ";" for ids in lists)


def oracle() -> str:
    """The query in DuckDB."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    names = ", ".join(f"CASE WHEN regexp_matches(sequence, {q(rule_pattern(v))}) THEN {q(k)} END" for k, v in RULES.items())
    table = ", ".join(f"({q(k)}, {q(v)})" for k, v in SENTENCES.items())
    norm = f"trim(regexp_replace(regexp_replace(lower(x), {q(_JUNK)}, '', 'g'), '[ \\t\\r]+', ' ', 'g'), {q(_EDGE)})"
    return f"""
WITH known(sentence, id) AS (VALUES {table}),
cut AS (SELECT doc_id, rowid AS r, unnest(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?:])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), '\\n+')) AS x,
               generate_subscripts(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?:])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), '\\n+'), 1) AS pos
        FROM (SELECT doc_id, text, row_number() OVER () AS rowid FROM documents)),
hits AS (SELECT r, pos, {norm} AS sentence FROM cut WHERE regexp_matches(lower(x), {q(KEYWORD)})),
per AS (SELECT r, count(*) AS n_sentences, count(*) - count(id) AS n_unknown,
               coalesce(';' || string_agg(id, ';' ORDER BY pos) || ';', '') AS sequence
        FROM hits LEFT JOIN known USING (sentence) GROUP BY r),
seqs AS (SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_unknown, 0) AS n_unknown, coalesce(sequence, '') AS sequence
         FROM (SELECT doc_id, row_number() OVER () AS r FROM documents) d LEFT JOIN per USING (r))
SELECT doc_id, n_sentences, n_unknown, sequence, concat_ws(',', {names}) AS licences FROM seqs"""
