"""Licence scans by sentences, in DataFrame operations only.

A text is cut into sentences twice: line by line, and with the lines of a paragraph joined, for wrapped licence texts.
Each sentence is normalised: lower case, runs of anything but letters and digits become one space. A sentence that is
known has an identifier. The identifiers of a text, in order, are matched against rules: a licence is found if the
identifiers of one of its rules occur in this order, with others between them or not. A rule whose identifiers are a
part of those of a longer rule that was found too isn't listed.

Lines with an SPDX identifier or expression (``SPDX-License-Identifier: (MIT OR Apache-2.0) AND ISC``) give all its
licences, known or not; exceptions after WITH are no licences. Of the GNU licences ``-only`` is left out, and ``+`` is
``-or-later``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from returns_risk.llm.common import documents

#: Known licence sentences by identifier.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "apache-license": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-obtain": "You may obtain a copy of the License at",
    "mit-short": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-title": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl2-clause": "either version 2 of the License, or (at your option) any later version",
    "gpl-clause": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc0": "Released under CC0 1.0",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
}
#: Rules: licence, and identifiers in order.
RULES = (
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("apache-license", "apache-comply", "apache-obtain")),
    ("Apache-2.0", ("spdx-apache",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-title", "mit-grant")),
    ("MIT", ("spdx-mit",)),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-3.0", ("spdx-gpl3",)),
    ("GPL-3.0-or-later", ("gpl3-later", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl-clause", "gpl2-clause", "gpl-warranty")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("MPL-2.0", ("mpl2",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC0-1.0", ("cc0",)),
)
#: Of the LGPL 2.1, whose notice is cut at its semicolons.
SENTENCES |= {
    "lgpl-clause": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl21-clause": "either version 2.1 of the License, or (at your option) any later version",
}
RULES += (("LGPL-2.1-or-later", ("lgpl-clause", "lgpl21-clause")),)
#: More notices, with a rule each: identifier, licence, sentence.
NOTICES = (
    ("lgpl3-later", "LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("agpl3-later", "AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl2-only", "GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant-and", "ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense-text", "Unlicense", "This is free and unencumbered software released into the public domain"),
    ("epl2-terms", "EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("bsl1-grant", "BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("zlib-grant", "Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)
#: Names of licences, each known in all of ``PHRASES``.
TITLES = {
    "MIT": ("MIT License", "Expat License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License version 2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License v1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "ISC": ("ISC License",),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "CC0-1.0": ("CC0 1.0 Universal License",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License",),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License",),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License",),
}
PHRASES = (
    "Licensed under the {}", "Released under the {}", "Distributed under the {}", "This file is licensed under the {}",
    "This project is licensed under the {}", "This software is licensed under the {}", "This program is licensed under the {}",
    "This work is licensed under the {}", "This code is licensed under the {}", "License: {}", "This work is licensed under a {}",
)


def _widened() -> tuple[dict[str, str], tuple]:
    """The sentences and rules with the notices and titles; no form twice, the first one stays."""
    form = lambda text: re.sub(r"[\W_]+", " ", text.lower()).strip()
    sentences, rules = dict(SENTENCES), list(RULES)
    known = {form(text) for text in sentences.values()}
    titles = [(f"{form(t.format(title)).replace(' ', '-')}", name, t.format(title)) for name, all_ in TITLES.items() for title in all_ for t in PHRASES]
    for key, name, text in [*NOTICES, *titles]:
        if form(text) not in known:
            known.add(form(text))
            sentences[key] = text
            rules.append((name, (key,)))
    return sentences, tuple(rules)


SENTENCES, RULES = _widened()
#: Every known sentence holds one of these; texts without any need no cutting.
HINTS = "licen|permission|redistribut|warranty|copyright|cc0|unencumbered|distributed under|released under"
_SPDX_ID = r"\(*[A-Za-z0-9][A-Za-z0-9.+-]*+\)*"
SPDX = (
    rf"(?m)SPDX-License-Identifier:[\x20\t]*+({_SPDX_ID}(?:[\x20\t]+(?:AND|OR|WITH)[\x20\t]+{_SPDX_ID})*+)"
    r"[\x20\t.]*+(?:\*/|-->|\*\))?[\x20\t\r]*$"
)
#: Spelling of SPDX identifiers, which are the same in any case.
SPELLED = {name.lower(): name for name, _ in RULES}


def _known() -> str:
    """SQL map from normal forms to identifiers. The known sentences go through the same expression as the texts."""
    pairs = ", ".join(f"{_normal(f"'{text}'")}, '{name}'" for name, text in SENTENCES.items())
    return f"map({pairs})"


def _normal(sentence: str) -> str:
    return f"trim(regexp_replace(lower({sentence}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))"


def _identifiers(text: str) -> str:
    """SQL: identifiers of the known sentences of a text, in order. Sentences end at a line's end, at ; ! ? and at a
    point before a space or the end."""
    cut = f"split({text}, '[\\n\\r;!?]+|\\\\.[ \\t]+|\\\\.$')"
    return f"filter(transform({cut}, s -> element_at({_known()}, {_normal('s')})), s -> s IS NOT NULL)"


def _spdx() -> str:
    """SQL: the licences named by SPDX lines of ``text``."""
    pattern = "'" + SPDX.replace("\\", "\\\\") + "'"
    lines = f"transform(regexp_extract_all(text, {pattern}, 1), x -> split(regexp_replace(x, '[()]|[ \\t]WITH[ \\t]+[^ \\t()]+', ''), '[ \\t]+'))"
    name = "regexp_replace(rtrim('.', x), '(?i)^((?:A|L)?GPL-[0-9.]+)-only$', '$1')"
    name = f"regexp_replace({name}, '(?i)^((?:A|L)?GPL-[0-9.]+)[+]$', '$1-or-later')"
    spelled = ", ".join(f"'{low}', '{is_}'" for low, is_ in SPELLED.items())
    named = f"transform(filter(flatten({lines}), x -> x NOT IN ('', 'AND', 'OR')), x -> {name})"
    return f"transform({named}, x -> coalesce(element_at(map({spelled}), lower(x)), x))"


def _occurs(ids: tuple[str, ...]) -> str:
    """SQL: the identifiers occur in this order in ``lined`` or ``joined``."""
    pattern = "%" + "%".join(f"<{name}>" for name in ids) + "%"
    return f"(lined LIKE '{pattern}' OR joined LIKE '{pattern}')"


def _within(short: tuple[str, ...], long: tuple[str, ...]) -> bool:
    left = iter(long)
    return len(short) < len(long) and all(name in left for name in short)


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, licenses (sorted array), sentences (identifiers line by line, in order).

    Null and empty texts have neither. Rows without an id and repeated rows are treated like others; other columns are
    left out.
    """
    rows = docs.selectExpr(f"cast({id_col} AS bigint) AS doc_id", f"coalesce({text_col}, '') AS text")
    none = "cast(array() AS array<string>)"
    unwrapped = "regexp_replace(regexp_replace(text, '\\\\n[ \\t\\r]*\\\\n', ';'), '[\\n\\r]+', ' ')"
    hinted = f"lower(text) RLIKE '{HINTS}'"
    rows = rows.selectExpr(
        "doc_id",
        f"CASE WHEN {hinted} THEN {_identifiers('text')} ELSE {none} END AS sentences",
        f"CASE WHEN {hinted} THEN {_identifiers(unwrapped)} ELSE {none} END AS unwrapped",
        f"CASE WHEN instr(text, 'SPDX-License-Identifier:') > 0 THEN {_spdx()} ELSE {none} END AS spdx",
    )
    tagged = "array_join(transform({0}, s -> concat('<', s, '>')), '')"
    rows = rows.selectExpr("doc_id", "sentences", "spdx", f"{tagged.format('sentences')} AS lined", f"{tagged.format('unwrapped')} AS joined")
    found = []
    for name, ids in RULES:
        longer = [other for _, other in RULES if _within(ids, other)]
        unless = "".join(f" AND NOT {_occurs(other)}" for other in longer)
        found.append(f"CASE WHEN {_occurs(ids)}{unless} THEN '{name}' END")
    found = f"array_compact(array({', '.join(found)}))"
    return rows.selectExpr("doc_id", f"array_sort(array_distinct(concat({found}, spdx))) AS licenses", "sentences")


def op8_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    """All of ``documents``: doc_id, licenses, n_sentences, sentences, both comma-joined."""
    return licenses(documents(spark, folder)).selectExpr(
        "doc_id", "array_join(licenses, ',') AS licenses", "cast(size(sentences) AS bigint) AS n_sentences",
        "array_join(sentences, ',') AS sentences",
    )
