"""Licence scans by sentence rules.

A text is cut into lines and sentences, which are normalised (lower case, runs of anything but letters and digits to one
blank). A known sentence counts where it begins and ends at a cut. It may run over line ends and over a ':' or ';', whatever
comment signs the lines begin with, but not over a blank line or over a '.', '!' or '?' that a blank follows. A number or
letter of a list may stand before it. Of known sentences that begin at one place the longest counts; what lies inside it
does not count again. A document's identifiers, in their order, are then matched against rules: each rule is an ordered
sequence of identifiers that must follow each other (other sentences, which have no identifier, may stand between).

Known sentences are those of licence texts (SENTENCES), titles that stand alone (TITLES), and references: 'This project is
licensed under the terms of the MIT License, see the LICENSE file for details.' is a verb and a name of a licence (NAMES), with
a subject before and a hint where to read on behind, or without. SPDX tags count too, with each identifier of their expression;
their identifiers follow those of the sentences. All of it is built-in expressions in one projection: no shuffle, no Python, and whatever the number of documents, only the fixed
rules are sent.

Defined cases: null and empty texts have no sentences and no licences; repeated rows are scanned each; a sentence that
occurs more often counts at each place; texts and lines of any length are scanned whole. A text of the three-clause BSD
licence also meets the rule of the two-clause one, and 'All rights reserved.' that of proprietary texts. Only id and text
are read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def plain(text: str) -> str:
    """A sentence as texts are compared: lower case, one blank for each run of other signs."""
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


_CC = {"by": "attribution", "by-sa": "attribution sharealike", "by-nc": "attribution noncommercial", "by-nd": "attribution noderivatives", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
_GNU = {"gpl": "general", "lgpl": "lesser general", "agpl": "affero general"}
_GNU_VERSIONS = (("gpl", "2"), ("gpl", "3"), ("lgpl", "2.1"), ("lgpl", "3"), ("agpl", "3"))


def _names() -> dict[str, str]:
    """Names in references, normalised, and their identifiers."""
    # What licences are called, beside those families that are made by rule.
    called = {
        "mit-ref": ["MIT license", "MIT"], "apache2-ref": ["Apache license version 2.0", "Apache license 2.0", "Apache license v2.0", "Apache 2.0 license", "Apache 2.0", "Apache-2.0 license"],
        "bsd2-ref": ["BSD 2-clause license", "2-clause BSD license", "simplified BSD license", "BSD-2-Clause license"], "bsd3-ref": ["BSD 3-clause license", "3-clause BSD license", "new BSD license", "modified BSD license", "BSD-3-Clause license"],
        "isc-ref": ["ISC license", "ISC"], "mpl2-ref": ["Mozilla Public License version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0 license"], "epl2-ref": ["Eclipse Public License version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL 2.0"],
        "epl1-ref": ["Eclipse Public License version 1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0", "EPL 1.0"], "unlicense-ref": ["Unlicense", "Unlicense license"], "bsl1-ref": ["Boost Software License version 1.0", "Boost Software License 1.0", "Boost Software License", "BSL 1.0"],
        "zlib-ref": ["zlib license", "zlib"], "wtfpl-ref": ["WTFPL", "WTFPL license"], "cc0-ref": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero", "Creative Commons CC0 1.0 Universal"], "postgresql-ref": ["PostgreSQL license"],
        "artistic2-ref": ["Artistic License 2.0", "Artistic License version 2.0"], "cddl1-ref": ["Common Development and Distribution License", "CDDL 1.0", "Common Development and Distribution License version 1.0"], "eupl12-ref": ["European Union Public Licence 1.2", "EUPL 1.2", "EUPL version 1.2", "EUPL"],
        "mspl-ref": ["Microsoft Public License", "MS-PL"], "ofl11-ref": ["SIL Open Font License version 1.1", "SIL Open Font License 1.1", "Open Font License", "OFL 1.1"], "python2-ref": ["Python Software Foundation License", "PSF license"], "ncsa-ref": ["University of Illinois NCSA Open Source License", "NCSA license"],
    }
    for kind, version in _GNU_VERSIONS:
        full, digits = f"GNU {_GNU[kind]} public license", plain(version).replace(" ", "")
        short = [f"{kind} {version}", f"{kind} v{version}", f"{kind}v{version}", f"gnu {kind} v{version}", f"gnu {kind}v{version}", f"gnu {kind} {version}", f"gnu {kind} version {version}", f"{kind} version {version}"]
        longer = [f"{full} version {version}", f"{full} v{version}", f"{full} {version}"]
        called[f"{kind}{digits}-ref"] = [x + y for x in short + longer for y in ("", " or later", " license")] + ([x + ".0" for x in short + longer] if "." not in version else [])
    for parts, words in _CC.items():
        for version in ("2.0", "2.5", "3.0", "4.0"):
            key = f"cc-{parts}-{version.removesuffix('.0').replace('.', '')}-ref"
            wide = " international" if version == "4.0" else " unported"
            called[key] = [f"cc {parts} {version}", f"cc {parts} {version} license", *(f"creative commons {words} {version}{y}" for y in ("", wide, " license", f"{wide} license"))]
    return {plain(name): key for key, names in called.items() for name in names}


NAMES = _names()


def _sentences() -> dict[str, str]:
    """Sentences of licence texts, normalised, and their identifiers."""
    # Sentences of the licences' public texts and of the notices that they ask for.
    said = {
        "mit-ref": ["The MIT License"],
        "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'],
        "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
        "apache2-use": ["You may not use this file except in compliance with the License"],
        "apache2-copy": ["You may obtain a copy of the License at"],
        "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
        "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
        "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
        "bsd-name": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
        "bsd-advert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
        "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
        "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
        "mpl2-form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v"],  # the '.' behind, with its blank, is a cut
        "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
        "epl2-form": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
        "unlicense-free": ["This is free and unencumbered software released into the public domain"],
        "unlicense-grant": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
        "bsl1-grant": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following'],
        "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
        "zlib-notice": ["This notice may not be removed or altered from any source distribution"],
        "wtfpl-copy": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"],
        "postgresql-grant": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"],
        "reserved": ["All rights reserved", "Unauthorized copying of this file, via any medium, is strictly prohibited"],
    }
    free = "this {} is free software you can redistribute it and or modify it under the terms of the gnu {} public license as published by the free software foundation {}version {} of the license{}"
    for kind, version in _GNU_VERSIONS:
        key = f"{kind}{plain(version).replace(' ', '')}"
        for subject in ("program", "library", "file", "package", "software"):
            said.setdefault(f"{key}-grant", []).append(free.format(subject, _GNU[kind], "either ", version, " or at your option any later version"))
            said.setdefault(f"{key}-grant", []).append(free.format(subject, _GNU[kind], "", version, ""))
    return {plain(text): key for key, texts in said.items() for text in texts}


SENTENCES = _sentences()
#: Titles of licence texts, which stand alone on their lines.
TITLES = {"mit license": "mit-ref", "the mit license mit": "mit-ref"} | {title: key for title, key in NAMES.items() if title.endswith(" license")}
# The words around a licence's name in a reference.
SUBJECTS = ["work", "project", "software", "program", "library", "package", "file", "code", "repository", "module", "document", "source code", "font software"]
VERBS = ["licensed", "released", "distributed", "published", "provided", "available", "made available"]
TAILS = ["the license", "see license", "see license for details", "see the license file", "see the license file for details", "see license for more information", "see the license file for more information", "see license file for details"]


def _reference() -> str:
    """A pattern of references whose first group is the name."""
    longest = lambda words: "|".join(sorted(words, key=len, reverse=True))
    return rf"(?:(?:this|the) (?:{longest(SUBJECTS)}) is )?(?:{longest(VERBS)}) under (?:the terms of )?(?:the |a |an )?({longest(NAMES)})(?: (?:{longest(TAILS)}))?"


REFERENCE = _reference()
# Rules, each an ordered sequence of sentence identifiers; those made by rule follow below.
RULES = {
    "MIT": [["mit-grant", "mit-notice"], ["mit-ref"]],
    "Apache-2.0": [["apache2-ref", "apache2-use", "apache2-copy"], ["apache2-ref"]],
    "GPL-3.0": [["gpl3-grant"], ["gpl3-ref"]],
    "CC-BY-NC-4.0": [["cc-by-nc-4-ref"]],
    "CC-BY-4.0": [["cc-by-4-ref"]],
    "CC-BY-SA-4.0": [["cc-by-sa-4-ref"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"], ["bsd3-ref"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"], ["bsd2-ref"]],
    "BSD-4-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert"]],
    "ISC": [["isc-grant"], ["isc-ref"]],
    "0BSD": [["0bsd-grant"]],
    "MPL-2.0": [["mpl2-form"], ["mpl2-ref"]],
    "EPL-2.0": [["epl2-form"], ["epl2-ref"]],
    "EPL-1.0": [["epl1-ref"]],
    "Unlicense": [["unlicense-free"], ["unlicense-grant"], ["unlicense-ref"]],
    "BSL-1.0": [["bsl1-grant"], ["bsl1-ref"]],
    "Zlib": [["zlib-grant"], ["zlib-ref"]],
    "WTFPL": [["wtfpl-copy"], ["wtfpl-ref"]],
    "PostgreSQL": [["postgresql-grant"], ["postgresql-ref"]],
    "CC0-1.0": [["cc0-ref"]],
    "Artistic-2.0": [["artistic2-ref"]],
    "CDDL-1.0": [["cddl1-ref"]],
    "EUPL-1.2": [["eupl12-ref"]],
    "MS-PL": [["mspl-ref"]],
    "OFL-1.1": [["ofl11-ref"]],
    "Python-2.0": [["python2-ref"]],
    "NCSA": [["ncsa-ref"]],
}
RULES |= {f"{kind.upper()}-{v if '.' in v else v + '.0'}": [[f"{kind}{plain(v).replace(' ', '')}-grant"], [f"{kind}{plain(v).replace(' ', '')}-ref"]] for kind, v in _GNU_VERSIONS if (kind, v) != ("gpl", "3")}
RULES |= {f"CC-{parts.upper()}-{v}": [[f"cc-{parts}-{v.removesuffix('.0').replace('.', '')}-ref"]] for parts in _CC for v in ("2.0", "2.5", "3.0", "4.0") if f"CC-{parts.upper()}-{v}" not in RULES}
RULES |= {"proprietary": [["reserved"]]}
#: SPDX identifiers in lower case, and their licences: a GNU licence has forms for itself alone and with later versions.
SPDX = {name.lower() + form: name for name in RULES if name != "proprietary" for form in (("", "+", "-only", "-or-later") if "GPL" in name else ("",))}
for _name in set(SPDX.values()):
    RULES[_name] = [*RULES[_name], [f"spdx:{_name}"]]
TAG = r"spdx-license-identifier:[ \t]*([a-z0-9.+() \t-]+)"
#: Every known sentence holds one of these.
HINTS = ("licen", "permi", "copy", "redistribut", "neither", "rights", "free software", "advertising", "public domain", "ed under", "able under", "source distribution")
# What _cut() replaces, in order: '|' where every sentence ends, '/' where one may go on.
CUTS = (
    (r"\n[^a-z0-9\n]*\n", "|"),  # blank lines, or lines of comment signs
    (r"[.!?][ \t\n]", "|"),
    (r"[;:][ \t]|\n", "/"),
    (r"[^a-z0-9|/]+", " "),
    (r" ?/[ /]*", "/"),
    (r" ?/?\|[ /|]*", "|"),
)


def whole_sentences(cut: str = "/") -> str:
    """A pattern of all known sentences, longest first, that may run over a soft cut: the first alternative that ends at a cut is taken."""
    over = lambda pattern: pattern.replace(" ", f"(?: |{cut})")
    known = sorted(SENTENCES | TITLES, key=len, reverse=True)
    reference = over(REFERENCE.replace("(", "(?:").replace("(?:?:", "(?:"))
    return f"{'|'.join(map(over, known))}|{reference}"


def _cut(low):
    """The normalised text, of one in lower case, with '|' where every sentence ends and '/' where one may go on, and one of them at each end."""
    t = F.translate(F.replace(low, F.lit("\r\n"), F.lit("\n")), "\r|/", "\n--")
    for found, by in CUTS:
        t = F.regexp_replace(t, found, by)
    return F.concat(F.lit("|"), F.trim(t), F.lit("|"))


def _map(entries: dict[str, str]):
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, sentence_ids (joined by blanks, in order, then tags), licences (joined by commas), n_licences."""
    base, low = docs.select(F.col(id_col).alias("_id"), F.lower(text_col).alias("_low")), F.col("_low")
    places = F.regexp_extract_all(_cut(low), F.lit(rf"(?<=[|/])(?:(?:[0-9]{{1,2}}|[a-z]) )?({whole_sentences()})(?=[|/])"), 1)
    hinted = reduce(lambda x, y: x | y, (F.contains(low, F.lit(h)) for h in HINTS))
    none = F.array().cast("array<string>")
    known, names, tags = _map(SENTENCES | TITLES), _map(NAMES), _map(SPDX)

    def identifier(found):
        said = F.translate(found, "/", " ")
        return F.coalesce(F.try_element_at(known, said), F.try_element_at(names, F.regexp_extract(said, f"^{REFERENCE}$", 1)))

    sentences = F.transform(F.when(hinted, places).otherwise(none), identifier)
    expressions = F.when(F.contains(low, F.lit("spdx-license-identifier:")), F.regexp_extract_all(low, F.lit(TAG), 1)).otherwise(none)
    tagged = F.filter(F.transform(F.split(F.concat_ws(" ", expressions), r"[() \t]+"), lambda x: F.try_element_at(tags, x)), lambda x: x.isNotNull())
    ids = F.array_join(F.concat(sentences, F.transform(tagged, lambda x: F.concat(F.lit("spdx:"), x))), " ")
    out = base.select(F.col("_id").alias(id_col), ids.alias("sentence_ids"))
    rules = F.array(*(F.struct(F.lit(f" {' '.join(rule)} ").alias("ids"), F.lit(name).alias("name")) for name, some in RULES.items() for rule in some))
    spaced = F.concat(F.lit(" "), F.col("sentence_ids"), F.lit(" "))
    met = F.array_distinct(F.filter(rules, lambda r: F.contains(spaced, r["ids"]))["name"])
    out = out.withColumn("licences", F.when(F.col("sentence_ids") == "", "").otherwise(F.array_join(met, ",")))
    return out.withColumn("n_licences", F.when(F.col("licences") == "", 0).otherwise(F.size(F.split("licences", ","))))
