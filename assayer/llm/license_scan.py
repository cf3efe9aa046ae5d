"""Licence statements by sentences and ordered rules over them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.frames import columns_of, small_batches, text_key

# Sentences of public licence texts and notices, lower-cased, with one space for each run of
# other characters than letters and digits.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files the software to deal in the software without restriction including without limitation the"
    " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
    " persons to whom the software is furnished to do so subject to the following conditions": "MIT-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of"
    " the software": "MIT-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the"
    " warranties of merchantability fitness for a particular purpose and noninfringement": "MIT-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in"
    " an action of contract tort or otherwise arising from out of or in connection with the software or the use or"
    " other dealings in the software": "MIT-liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
    " granted provided that the above copyright notice and this permission notice appear in all copies": "ISC-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the"
    " following conditions are met": "BSD-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following"
    " disclaimer": "BSD-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
    " following disclaimer in the documentation and or other materials provided with the distribution": "BSD-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission": "BSD-endorse",
    "all advertising materials mentioning features or use of this software must display the following"
    " acknowledgement": "BSD-advertise",
    "licensed under the apache license version 2 0 the license": "Apache-2-header",
    "you may not use this file except in compliance with the license": "Apache-2-use",
    "you may obtain a copy of the license at": "Apache-2-copy",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
    " license as published by the free software foundation either version 2 of the license or at your option any"
    " later version": "GPL-2-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
    " license as published by the free software foundation either version 3 of the license or at your option any"
    " later version": "GPL-3-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied"
    " warranty of merchantability or fitness for a particular purpose": "GPL-hope",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general"
    " public license as published by the free software foundation either version 2 1 of the license or at your option"
    " any later version": "LGPL-21-later",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
    " granted": "0BSD-grant",
    "this program is distributed in the hope that it will be useful but without any warranty": "GNU-hope",
    "this library is distributed in the hope that it will be useful but without any warranty": "GNU-hope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "GNU-implied",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL-2-subject",
    "this is free and unencumbered software released into the public domain": "Unlicense-head",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or"
    " as a compiled binary for any purpose commercial or non commercial and by any means": "Unlicense-grant",
}

# Names of licences in statements, normalised in the same way.
NAMES = {
    "mit": "MIT",
    "apache license version 2 0": "Apache-2.0",
    "apache license 2 0": "Apache-2.0",
    "apache 2 0": "Apache-2.0",
    "gnu general public license version 2": "GPL-2.0-only",
    "gnu general public license v2": "GPL-2.0-only",
    "gpl 2 0": "GPL-2.0-only",
    "gnu general public license version 3": "GPL-3.0-only",
    "gnu general public license v3": "GPL-3.0-only",
    "gpl 3 0": "GPL-3.0-only",
    "gplv3": "GPL-3.0-only",
    "gnu lesser general public license version 3": "LGPL-3.0-only",
    "gnu affero general public license version 3": "AGPL-3.0-only",
    "mozilla public license 2 0": "MPL-2.0",
    "mozilla public license version 2 0": "MPL-2.0",
    "bsd 2 clause": "BSD-2-Clause",
    "bsd 3 clause": "BSD-3-Clause",
    "isc": "ISC",
    "cc0 1 0": "CC0-1.0",
    "cc by 4 0": "CC-BY-4.0",
    "cc by sa 4 0": "CC-BY-SA-4.0",
    "cc by nc 4 0": "CC-BY-NC-4.0",
    "cc by nd 4 0": "CC-BY-ND-4.0",
    "cc by nc sa 4 0": "CC-BY-NC-SA-4.0",
    "creative commons attribution 4 0 international": "CC-BY-4.0",
    "creative commons attribution sharealike 4 0 international": "CC-BY-SA-4.0",
    "creative commons attribution noncommercial 4 0 international": "CC-BY-NC-4.0",
}

# Versions of licences that are named with one.
_VERSIONS = {
    "GPL": ("1.0", "2.0", "3.0"),
    "LGPL": ("2.0", "2.1", "3.0"),
    "AGPL": ("1.0", "3.0"),
    "Apache": ("1.0", "1.1", "2.0"),
    "MPL": ("1.0", "1.1", "2.0"),
    "EPL": ("1.0", "2.0"),
    "CDDL": ("1.0", "1.1"),
    "EUPL": ("1.0", "1.1", "1.2"),
    "BSL": ("1.0",),
    "Artistic": ("1.0", "2.0"),
    "OFL": ("1.0", "1.1"),
    "CC": ("1.0", "2.0", "2.5", "3.0", "4.0"),
}
_V = r" ?(?:v|version )? ?(?P<version>\d(?: \d)?)"
_LATER = r"(?: or (?:at your option )?(?:any )?(?:later|newer))(?: versions?)?(?: at your option)?"
_GNU = rf"(?:gnu )?(?P<kind>(?:(?:affero|lesser|library) )?(?:general )?public license|[al]?gpl)(?: [al]?gpl)?(?: license)?"
_BY = r"(?:by|attribution)(?P<parts>(?: (?:nc|nd|sa|non ?commercial|no ?deriv(?:ative)?s?(?: works)?|share ?alike))*)"
_NAMED = [
    ("GNU", rf"{_GNU}{_V}(?P<later>{_LATER})?(?: only)?"),
    ("GNU", rf"version (?P<version>\d(?: \d)?)(?P<later>{_LATER})? of the {_GNU}"),
    ("Apache", rf"apache(?: software| public)?(?: license)?{_V}"),
    ("MPL", rf"(?:mozilla public license|mpl)(?: mpl)?{_V}"),
    ("EPL", rf"(?:eclipse public license|epl)(?: epl)?{_V}"),
    ("CDDL", rf"(?:common development and distribution license|cddl)(?: cddl)?{_V}"),
    ("EUPL", rf"(?:european union public license|eupl)(?: eupl)?{_V}"),
    ("BSL", rf"(?:boost software license|boost|bsl){_V}"),
    ("Artistic", rf"artistic(?: license)?{_V}"),
    ("OFL", rf"(?:(?:sil )?open font license|ofl)(?: ofl)?{_V}"),
    ("CC", rf"(?:creative commons|cc) {_BY}(?: license)?{_V}(?: (?:international|unported|generic))?(?: public)?(?: license)?(?: cc by[a-z ]* \d \d)?"),
    ("CC0-1.0", r"(?:creative commons )?(?:cc0|zero|cc zero)(?: v?1 0)?(?: universal)?(?: public domain dedication)?"),
    ("MIT", r"(?:mit|expat|mit expat)"),
    ("0BSD", r"(?:0bsd|(?:0|zero) clause bsd|bsd (?:0|zero) clause)"),
    ("BSD-2-Clause", r"(?:(?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd|freebsd)"),
    ("BSD-3-Clause", r"(?:(?:3|three) clause bsd|bsd (?:3|three) clause|(?:new|modified|revised) bsd)"),
    ("BSD-4-Clause", r"(?:(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd)"),
    ("ISC", "isc"),
    ("Zlib", "zlib"),
    ("Unlicense", "unlicense"),
    ("WTFPL", "wtfpl"),
]
_NAMED = [(licence, re.compile(rf"{name}(?: license)?")) for licence, name in _NAMED]
_MOST_WORDS = 24  # no name above has more


def licence_named(name: str) -> str | None:
    """SPDX identifier of a normalised name."""
    if found := NAMES.get(name) or NAMES.get(name.removesuffix(" license")) or NAMES.get(name + " license"):
        return found
    for licence, pattern in _NAMED:
        if not (m := pattern.fullmatch(name)):
            continue
        said = m.groupdict()
        if "version" not in said:
            return licence
        version = said["version"].replace(" ", ".") if " " in said["version"] else said["version"] + ".0"
        if licence == "GNU":
            licence = _gnu_kind(said["kind"])
        if version not in _VERSIONS.get(licence, ()):
            return None
        if licence in ("GPL", "LGPL", "AGPL"):
            return f"{licence}-{version}-{'or-later' if said['later'] else 'only'}"
        if licence == "CC":
            parts = said["parts"].replace(" ", "")
            has = [x for x, words in (("NC", "nc|non"), ("ND", "nd|noder"), ("SA", "sa|share")) if re.search(words, parts)]
            return None if has[-2:] == ["ND", "SA"] else "-".join(["CC-BY", *has, version])
        return f"{licence}-{version}"
    return None


def _gnu_kind(name: str) -> str:
    for short, words in (("LGPL", ("lesser", "library", "lgpl")), ("AGPL", ("affero", "agpl")), ("GPL", ("general", "gpl"))):
        if name.startswith(words):
            return short
    return ""


_BEFORE = re.compile(r"(?:(?:and or|and|or|either|both|any|one|of|the|a|an) )+")
_AFTER = re.compile(r"(?: (?:at your option|at your choice|respectively))+")


def licences_named(names: str) -> list[str]:
    """SPDX identifiers of one normalised name, or of several with and, or or a comma between them; [] if any is unknown."""
    left, found = _AFTER.sub("", names) if names.endswith(("option", "choice", "respectively")) else names, []
    if one := licence_named(names):
        return [one]
    while left:
        left = left[m.end() :] if (m := _BEFORE.match(left)) else left
        words = left.split(" ", _MOST_WORDS)
        for n in range(min(len(words), _MOST_WORDS), 0, -1):
            if one := licence_named(" ".join(words[:n])):
                break
        else:
            return []
        found.append(one)
        left = " ".join(words[n:])
    return list(dict.fromkeys(found))


# Ordered: the first rule that fits at a place wins, so longer sequences stand before their parts.
RULES = (
    ("MIT", ("MIT-grant", "MIT-notice", "MIT-warranty", "MIT-liability")),
    ("MIT", ("MIT-grant", "MIT-notice", "MIT-warranty")),
    ("MIT", ("MIT-grant", "MIT-notice")),
    ("ISC", ("ISC-grant",)),
    ("0BSD", ("0BSD-grant",)),
    ("BSD-4-Clause", ("BSD-grant", "BSD-source", "BSD-binary", "BSD-advertise", "BSD-endorse")),
    ("BSD-4-Clause", ("BSD-grant", "BSD-source", "BSD-binary", "BSD-advertise")),
    ("BSD-3-Clause", ("BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse")),
    ("BSD-2-Clause", ("BSD-grant", "BSD-source", "BSD-binary")),
    ("Apache-2.0", ("Apache-2-header", "Apache-2-use", "Apache-2-copy")),
    ("Apache-2.0", ("Apache-2-header",)),
    ("GPL-2.0-or-later", ("GPL-2-later", "GPL-hope")),
    ("GPL-2.0-or-later", ("GPL-2-later",)),
    ("GPL-3.0-or-later", ("GPL-3-later", "GPL-hope")),
    ("GPL-3.0-or-later", ("GPL-3-later",)),
    ("LGPL-2.1-or-later", ("LGPL-21-later",)),
    ("MPL-2.0", ("MPL-2-subject",)),
    ("Unlicense", ("Unlicense-head", "Unlicense-grant")),
    ("Unlicense", ("Unlicense-head",)),
) + tuple(
    (f"{kind}-{version}-{which}", head + tail)
    for kind in ("GPL", "LGPL", "AGPL")
    for version in _VERSIONS[kind]
    for which in ("or-later", "only")
    for head in ((f"{kind}-{version}-{which}-notice",), (f"{kind}-notice", f"version-{version}-{which}"))
    for tail in (("GNU-hope", "GNU-implied"), ("GPL-hope",), ("GNU-hope",), ())
)

# Sentences with a slot: the holder, or the kind and version of a GNU licence. Their notices are cut where a
# colon or semicolon stands, which differs between them.
_ENDORSE = re.compile(
    r"(?:(?:.+ )?nor the names of (?:its|their|any|other|the) contributors may"
    r"|the names? of .+ may not) be used to endorse or promote products derived from this software without specific"
    r" prior written permission"
)
_WHICH = r"(?:either )?version (?P<version>\d(?: \d)?)(?: of the license)?(?P<only> only)?(?P<later> or at your option any later version)?"
_WHICH_PART = re.compile(_WHICH)
_NOTICE = re.compile(
    r"(?:.+ is free software )?you (?:can|may) redistribute it and or modify it under the terms of the gnu"
    r" (?P<kind>(?:(?:affero|lesser|library) )?general public license)"
    rf"(?: (?:{_WHICH.replace('P<', 'P<early_')} )?as published by the free software foundation)(?: {_WHICH})?"
)


def _slot_id(plain: str) -> str | None:
    if plain.endswith("written permission"):
        return "BSD-endorse" if _ENDORSE.fullmatch(plain) else None
    if m := _WHICH_PART.fullmatch(plain):
        start = "version-"
    elif "redistribute it and or modify it under" in plain and (m := _NOTICE.fullmatch(plain)):
        start = _gnu_kind(m["kind"]) + "-"
    else:
        return None
    said = {k.removeprefix("early_"): v for k, v in m.groupdict().items() if v}
    if "version" not in said:
        return start + "notice"
    version = said["version"].replace(" ", ".") if " " in said["version"] else said["version"] + ".0"
    return f"{start}{version}-{'or-later' if 'later' in said else 'only'}" + ("" if start == "version-" else "-notice")


_STATEMENT = re.compile(
    r"(?:except where otherwise (?:noted|indicated|stated) )?(?:(?:(?:this|the|all|these) (?:\w+ ){1,3}?|content on this site |it )"
    r"(?:is|are) )?(?:(?:dual|dually|double|triple|tri|multi) )?(?:made )?(?:licensed|released|distributed|published|provided|available)"
    r" under (?:(?:the|an?) )?(?:(?:terms|conditions|terms and conditions) of (?:(?:the|an?) )?)?(.+?)(?: licen[sc]es?)?"
)
_SPDX = re.compile(r"[^a-z0-9]*spdx-license-identifier:\s*([a-z0-9(][a-z0-9.+:()\s-]*)\W*", re.I)
_PLUS = re.compile(r"(?<=\w)\+(?!\w)")
_END = re.compile(r"(?<=[.;:!?])\s+")
_OTHER = re.compile(r"[\W_]+")
_LIST_MARK = re.compile(r"(?:\d{1,2}|[a-z]|i{1,3}) ")


def normalise(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


def spdx_licences(line: str) -> list[str]:
    """Licences of a line with an SPDX expression, in its order; an exception stays with its licence."""
    m = _SPDX.fullmatch(line)
    tokens = re.findall(r"[()]|[^\s()]+", m[1].rstrip(" \t\r\n-.:")) if m else []
    found, depth, name = [], 0, True  # whether a name is due
    for token in tokens:
        word = token.lower()
        if name and token == "(":
            depth += 1
        elif name and token != ")" and word not in ("and", "or", "with"):
            if found and found[-1].endswith(" WITH "):
                found[-1] += token
            else:
                found.append(token)
            name = False
        elif not name and token == ")" and depth:
            depth -= 1
        elif not name and word in ("and", "or", "with"):
            found[-1] += " WITH " if word == "with" else ""
            name = True
        else:
            return []
    return [] if name or depth else list(dict.fromkeys(found))


def sentence_id(sentence: str) -> str | None:
    """Identifier of a known sentence: of the table, a statement of licences' names, or an SPDX line."""
    if spdx := spdx_licences(sentence.strip()):
        return "names " + ", ".join(spdx)
    plain = normalise(sentence)
    bare = _LIST_MARK.sub("", plain, count=1) if _LIST_MARK.match(plain) else ""
    found = SENTENCES.get(plain) or SENTENCES.get(bare) or _slot_id(plain) or (_slot_id(bare) if bare else None)
    if found is None and " under " in plain:
        if "+" in sentence:
            plain = normalise(_PLUS.sub(" or later ", sentence))
        if said := _STATEMENT.fullmatch(plain.replace("licence", "license")):
            names = licences_named(said[1]) or licences_named(said[1] + " license")
            found = "names " + ", ".join(names) if names else None
    return found


def _sentences(text: str) -> Iterator[str]:
    """Sentences in order. Lines of a paragraph are joined, but a line of known sentences stands for itself."""
    waiting: list[str] = []

    def flush() -> Iterator[str]:
        if waiting:
            yield from _END.split(" ".join(waiting))
            waiting.clear()

    for line in text.split("\n"):
        line = line.strip(" \t\r*#/;|-")
        if not line:
            yield from flush()
            continue
        parts = [line] if spdx_licences(line) else _END.split(line)
        if all(map(sentence_id, parts)):
            yield from flush()
            yield from parts
        else:
            waiting.append(line)
    yield from flush()


@dataclass(frozen=True)
class LicenseScan:
    max_gap: int = 2  # unknown sentences that may stand between two sentences of a rule


def recognise(text: str, options: LicenseScan = LicenseScan()) -> list[tuple[str, int, int, list[str]]]:
    """Licence, number of the first and of the last sentence, and identifiers, for each rule that fits."""
    known = [(i, name) for i, s in enumerate(_sentences(text)) if (name := sentence_id(s))]
    out, k = [], 0
    while k < len(known):
        at, name = known[k]
        size = 1
        if name.startswith("names "):
            out += [(licence, at, at, [name]) for licence in name.removeprefix("names ").split(", ")]
        else:
            for licence, rule in RULES:
                part = known[k : k + len(rule)]
                gaps = (b[0] - a[0] - 1 <= options.max_gap for a, b in zip(part, part[1:]))
                if tuple(n for _, n in part) == rule and all(gaps):
                    out.append((licence, at, part[-1][0], list(rule)))
                    size = len(rule)
                    break
        k += size
    return out


_SCHEMA = "doc_id long, text_key long, licence string, first_sentence int, last_sentence int, sentences array<string>"


def scan_licenses(
    docs: DataFrame, options: LicenseScan = LicenseScan(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Licences that texts state: doc_id, text_key, licence (SPDX name), first_sentence, last_sentence, sentences.

    Sentences are normalised and mapped to identifiers; sequences of identifiers are matched against the
    ordered rules, each identifier being used once. One row per match, in the order of the text, and one per
    licence of a statement or SPDX expression that names several; a document without a licence has no row.
    A licence that has versions is recognised only with its version. A sentence may run over lines; a line of known sentences needs no
    punctuation around it.

    Null and empty texts match nothing. Repeated rows give repeated matches, rows without id keep null as id.
    An empty table gives an empty result, other columns are ignored. Texts are scanned whole. No shuffle.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())]
        for batch in batches:
            ids, keys = batch["doc_id"].to_pylist(), batch["text_key"].to_pylist()
            out = [
                (ids[i], keys[i], *found)
                for i, text in enumerate(batch["text"])
                for found in recognise(text.as_py() or "", options)
            ]
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _SCHEMA.split(", ")]
            )

    given = columns_of(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("long"), "text", text_key("text").alias("text_key")
    )
    return given.mapInArrow(run, _SCHEMA)
