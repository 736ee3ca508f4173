"""Licence scans by sentence rules.

A text is split into sentences and lines; each is normalised and looked up in a
table of known licence sentences, which gives it an identifier. A known sentence
is also found where line breaks wrap it, with or without comment leaders, but
not across a blank line. The sequence of
a document's identifiers is then matched against ordered rules: the first rules
are the longest licences, and what a rule matches is used up. Everything is a
projection of native expressions over the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends a sentence (dots inside numbers do not), and a line of one that is wrapped.
STOP, LINE = r"[.!?;]+[\x20\x09-\x0D]+", r"\r\n|[\n\r]"
#: A sentence with one of these that is not known is reported.
TELLS = r"\b(licen[cs]e|licensed|sublicen[cs]e|spdx)\b"

# Normalised licence sentences and their identifiers (one letter or digit each).
SENTENCES = {
    "licensed under the apache license version 2 0": "A",
    "licensed under the apache license version 2 0 the license": "A",
    "you may not use this file except in compliance with the license": "B",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "C",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "D",
    "released under the mit license": "M",
    "licensed under the mit license": "M",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "N",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "O",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "P",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "Q",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "R",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "S",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "T",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "U",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "V",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "W",
    "see the license for the specific language governing permissions and limitations under the license": "E",
    "this work is licensed under the gnu general public license version 3": "G",
    "licensed under the gnu general public license version 3": "G",
    "licensed under the gnu general public license version 2": "H",
    "licensed under the gnu lesser general public license version 3": "L",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "I",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "J",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "K",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "F",
    "this program is distributed in the hope that it will be useful but without any warranty": "g",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "h",
    "see the gnu general public license for more details": "i",
    "see the gnu affero general public license for more details": "i",
    "licensed under cc by nc 4 0": "X",
    "licensed under cc by 4 0": "Y",
    "licensed under cc by sa 4 0": "Z",
    "this work is dedicated to the public domain": "0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "a",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "t",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "b",
    "this is free and unencumbered software released into the public domain": "c",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "d",
    "this software is provided as is without any express or implied warranty": "e",
    "in no event will the authors be held liable for any damages arising from the use of this software": "j",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "f",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "k",
    "distributed under the boost software license version 1 0": "k",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "l",
    "subject to the terms of the mozilla public license v 2 0": "6",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "6",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "m",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "m",
    "spdx license identifier mit": "1",
    "spdx license identifier apache 2 0": "2",
    "spdx license identifier gpl 3 0 only": "3",
    "spdx license identifier bsd 3 clause": "4",
    "spdx license identifier bsd 2 clause": "5",
    "spdx license identifier gpl 2 0 only": "7",
    "spdx license identifier gpl 3 0 or later": "8",
    "spdx license identifier mpl 2 0": "9",
    "spdx license identifier isc": "n",
    "spdx license identifier agpl 3 0 or later": "o",
    "spdx license identifier lgpl 2 1 or later": "p",
    "spdx license identifier unlicense": "q",
    "spdx license identifier cc0 1 0": "r",
    "spdx license identifier bsl 1 0": "s",
}
# Ordered rules over identifier sequences; earlier rules win.
RULES = (
    ("MIT", "NO?P?Q?"),
    ("BSD-3-Clause", "RSTUV?W?"),
    ("BSD-2-Clause", "RSTV?W?"),
    ("Apache-2.0", "AB?C?D?E?"),
    ("MIT", "M"),
    ("GPL-3.0-or-later", "Ig?h?i?"),
    ("GPL-2.0-or-later", "Jg?h?i?"),
    ("LGPL-2.1-or-later", "Kg?h?i?"),
    ("AGPL-3.0-or-later", "Fg?h?i?"),
    ("GPL-3.0", "G"),
    ("GPL-2.0", "H"),
    ("LGPL-3.0", "L"),
    ("CC-BY-NC-4.0", "X"),
    ("CC-BY-SA-4.0", "Z"),
    ("CC-BY-4.0", "Y"),
    ("CC0-1.0", "[0r]"),
    ("ISC", "ab?|n"),
    ("0BSD", "tb?"),
    ("Unlicense", "cd?|q"),
    ("Zlib", "e?j?f"),
    ("BSL-1.0", "k|s"),
    ("EPL-2.0", "l"),
    ("MPL-2.0", "6m?|9"),
    ("MIT", "1"),
    ("Apache-2.0", "2"),
    ("GPL-3.0", "3"),
    ("GPL-3.0-or-later", "8"),
    ("GPL-2.0", "7"),
    ("AGPL-3.0-or-later", "o"),
    ("LGPL-2.1-or-later", "p"),
    ("BSD-3-Clause", "4"),
    ("BSD-2-Clause", "5"),
)


def hints(sentences: Mapping[str, str]) -> str:
    """A pattern of words of which every known sentence, and every one that names a licence, has at least one."""
    words = ["license", "licence", "licensed", "spdx", "copyright", "software", "warranty", "redistribut"]
    for text in sentences:
        if not any(w in text for w in words):
            words.append(max(text.split(), key=len))
    return "|".join(words)


def normalise(sentence: Column) -> Column:
    """Lower-case letters and digits, everything else one space."""
    return F.trim(F.regexp_replace(sentence, "[^a-z0-9]+", " "))


def _unwrapped(sentence: Column, sentences: Mapping[str, str]) -> Column:
    """The normalised lines of a sentence between bars; ``#`` and its identifier for a known one on several lines."""
    plain = F.regexp_replace(F.regexp_replace(sentence, LINE, "\n"), r"[^a-z0-9\n]+", " ")
    plain = F.trim(F.regexp_replace(plain, r" ?\n ?", "|"))
    known: dict[str, list[str]] = {}
    for text, name in sentences.items():
        known.setdefault(name, []).append(text.replace(" ", "[ |]"))
    wrapped = plain
    for name, texts in known.items():
        wrapped = F.regexp_replace(wrapped, rf"(?<![^|])(?:{'|'.join(texts)})(?![^|])", f"#{name}")
    return F.when(plain.contains("|"), wrapped).otherwise(plain)


def scan(docs: DataFrame, sentences: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``doc_id, sentence_ids, licences, n_unknown`` for every row of ``docs``.

    ``sentence_ids`` is the sequence of identifiers in text order, ``licences``
    the names of matched rules without repeats in rule order, joined by a
    comma, ``n_unknown`` the number of sentences that name a licence and are
    not known. Identifiers that no rule takes match nothing. Null and empty
    texts have none of these. Repeated rows stay; other columns are ignored.
    """
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    hinted = F.filter(F.split(low, STOP), lambda s: s.rlike(hints(sentences)))
    lines = F.flatten(F.transform(hinted, lambda s: F.split(_unwrapped(s, sentences), r"\|")))
    code = lambda s: F.when(s.startswith("#"), F.substring(s, 2, 1)).otherwise(F.coalesce(F.element_at(known, s), F.when(s.rlike(TELLS), F.lit("?")).otherwise(F.lit(""))))
    found = docs.select("doc_id", F.transform(lines, code).alias("ids"))
    found = found.select("doc_id", F.array_join("ids", "").alias("ids"))
    found = found.select("doc_id", F.regexp_replace("ids", r"\?", "").alias("ids"), (F.length("ids") - F.length(F.regexp_replace("ids", r"\?", ""))).cast("long").alias("n_unknown"))
    rest, names = F.col("ids"), []
    for name, pattern in rules:
        names.append(F.when(rest.rlike(pattern), F.lit(name)))
        rest = F.regexp_replace(rest, pattern, "-")
    matched = F.when(F.col("ids") == "", F.lit("")).otherwise(F.array_join(F.array_distinct(F.array_compact(F.array(*names))), ","))
    return found.select("doc_id", F.col("ids").alias("sentence_ids"), matched.alias("licences"), "n_unknown")
