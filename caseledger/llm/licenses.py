"""Operator 2: licence scans by canonical digests.

Case, punctuation, copyright lines and equivalent spellings are normalised away; what is left of an entire
text is hashed and joined with the digests of known licences: whole texts (the folder license_texts) and notices. The unit is a
whole document and each of its lines, so that a licence notice on a line of its own is found too.
"""

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

#: Lines that name a holder, not terms: removed before the comparison.
COPYRIGHT_LINE = (
    r"(?i)^[^\p{L}\p{N}(©]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|by\b|:)|\(c\)[ \t]*(copyright|[0-9]{4})|©|all rights reserved\.?[ \t\r]*$).*$"
)
#: Spellings that count as equal, after lower-casing and with punctuation already turned into spaces. Fixed values.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("centre", "center"), ("copyright holder", "copyright owner"), ("emphasised", "emphasized"),
    ("favour", "favor"), ("fulfil ", "fulfill "), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)
#: What stands above the terms of a licence file, where anything does. The longer licences have their title in the text.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "This software is released under the MIT license:"),
    "ISC": ("ISC License", "The ISC License", "The ISC License (ISC)", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", "The BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "The BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "Zlib": ("zlib License", "The zlib License"),
}
#: How a notice names a licence, after "the" or not. Fixed values.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache License, Version 2.0 (the \"License\")"),
    "MIT": ("MIT License", "MIT", "MIT License (MIT)"),
    "ISC": ("ISC License", "ISC"),
    "0BSD": ("Zero-Clause BSD License", "BSD Zero Clause License", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL, version 2", "GPLv2", "GNU GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL, version 3", "GPLv3", "GNU GPLv3", "GNU General Public License v3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1", "GNU LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3", "GNU LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3", "GNU AGPLv3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    **{
        f"CC-{x}-4.0": (f"CC {x} 4.0", f"Creative Commons {n} 4.0 International License", f"Creative Commons {n} 4.0 License")
        for x, n in (
            ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
    },
}
#: Notices around a name. Fixed values.
FRAMES = (
    "Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This project is licensed under {}.",
    "This software is licensed under {}.", "This software is released under {}.",
)
#: Notices in words of their own. Fixed values, public texts.
NOTICES = (
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
)
#: One short notice or beginning per licence. The SQL twin, which takes one text per id, holds these only. Fixed values, public texts.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
)


def _whole_texts() -> list[tuple[str, str]]:
    """Whole licences, each with and without its titles, its closing instructions and the s of https.

    A file of license_texts is named by the licence and a number: the wordings that are in use.
    """
    out = []
    for file in sorted((files(__package__) / "license_texts").iterdir(), key=lambda x: x.name):
        name, text = file.name.split("~")[0], file.read_text(encoding="utf-8")
        terms = re.split(r"(?<=END OF TERMS AND CONDITIONS)\W*\n", text, maxsplit=1)[0]
        for body in dict.fromkeys((text, terms)):
            for form in dict.fromkeys((body, body.replace("https://", "http://"), re.sub(r"http://", "https://", body))):
                out += [(name, f"{title}\n\n{form}" if title else form) for title in ("", *TITLES.get(name, ()))]
    return out


def _notices() -> list[tuple[str, str]]:
    out = []
    for name, names in NAMES.items():
        versions = (name, f"{name}-only", f"{name}-or-later") if "GPL" in name else (name,)
        out += [(name, f"SPDX-License-Identifier: {v}") for v in versions]
        out += [(name, frame.format(the + n)) for n in names for frame in FRAMES for the in ("", "the ")]
    return out


def all_known() -> list[tuple[str, str]]:
    """Whole texts and, as a second kind, notices: license_id and text."""
    return [*_whole_texts(), *_notices(), *NOTICES, *KNOWN]


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(all_known(), "license_id string, text string")


def _line(line: Column) -> Column:
    bare = F.lower(F.regexp_replace(line, COPYRIGHT_LINE, ""))
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def _spelled(text: Column) -> Column:
    """One spelling for each of the equivalents, which are looked for at the start of words only."""
    padded = F.concat(F.lit(" "), text)
    out = padded
    for one, other in EQUIVALENT:
        out = F.replace(out, F.lit(f" {one}"), F.lit(f" {other}"))
    some = F.lit(" (?:" + "|".join(one for one, _ in EQUIVALENT) + ")")
    return F.when(F.rlike(padded, some), F.ltrim(out)).otherwise(text)


def canonical_units(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, whole, digest) of each entire text and of each of its lines. What has nothing left has no digest."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), _line), lambda x: x != "")
    units = F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), F.array_join("lines", " ").alias("t"))),
        F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), x.alias("t"))),
    )
    return (
        texts.filter(F.col(text).isNotNull())
        .select(F.col(key).alias(key), lines.alias("lines"))
        .select(key, F.explode(units).alias("unit"))
        .select(key, F.col("unit.whole").alias("whole"), F.col("unit.t").alias("t"))
        .filter("t <> ''")
        .select(key, "whole", F.sha2(_spelled(F.col("t")), 256).alias("digest"))
    )


def license_scan(
    docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, license_id of the entire text (null: none known) and line_licenses, the sorted ids found on single lines.

    `known` has license_id and text; where texts have equal digests, the smallest id wins. Null and empty texts, and texts
    of copyright lines only, have no digest. Rows with equal ids, null ones too, share what is found. Other columns
    are not read. With a small table of known texts, lines are joined where they are read and only matches are shuffled.
    """
    # Stored, so that Spark knows the size and sends a small table to the texts instead of their lines to it.
    digests = stored(
        canonical_units(known, "license_id", "text").filter("whole")
        .groupBy("digest").agg(F.min("license_id").alias("license_id")),
        "licenses",
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    units = canonical_units(texts, "id", "text")
    found = units.join(digests, "digest").groupBy("id").agg(
        F.min(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"),
        F.array_join(F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))), ",").alias("line_licenses"),
    )
    out = docs.select(F.col(id_col).alias("id")).join(found.withColumnRenamed("id", "id_"), F.col("id").eqNullSafe(F.col("id_")), "left")
    return out.select(
        F.col("id").alias(id_col), "license_id", F.when(F.col("line_licenses") != "", F.col("line_licenses")).alias("line_licenses")
    )
