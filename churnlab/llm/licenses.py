"""9. License scans: canonical digest lookup.

A text is brought into canonical form (lower case, equivalent spellings made one,
copyright lines dropped, punctuation and white space made single blanks) and its
digest is hash-joined to the digests of the known licence texts: the notices below and
the whole texts in ``license_texts``.  Looked up are
the whole text, every paragraph and every line of a document, each as an entire
text of its own: a licence notice may stand alone or inside a longer document.

Everything runs in DataFrame functions.  Null and empty texts have no unit and
match nothing.  A repeated line counts once per place.  Columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlab.llm.common import table

# Public licence notices and texts.
KNOWN = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice-2": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}
# Spellings that licence matching treats as the same word.
EQUIVALENT = {
    "licence": "license",
    "licenced": "licensed",
    "sub-license": "sublicense",
    "organisation": "organization",
    "authorised": "authorized",
    "favour": "favor",
    "merchantability and fitness": "merchantability or fitness",
    "copyright holder": "copyright owner",
    "https://": "http://",
    "percent": "per cent",
}
# What follows "copyright" at the start of a line of prose, other than a holder or year.
PROSE = (
    "notices?|licen[sc]es?|owners?|holders?|laws?|like|and|or|on|in|of|to|for|is|as|are|with|under|from|that|also|which|may|shall|"
    "interests?|protection|statements?|disclaimers?|permissions?|treaty|treaties|rights?|related|resulting|line|act|infringement|status|"
    "doctrines?|patents?|trademarks?|the +(library|software|program|work|code|document)"
)
COPYRIGHT_LINE = rf"(?m)^[^a-z0-9\n]*(\(c\) *(copyright\b|[0-9]{{4}})|©|copyright\b(?!,|[^\p{{L}}\p{{N}}\n©]*($|({PROSE})\b)))[^\n]*$"
#: the first words of a whole text without its title, copyright lines and reservation
BEGINNINGS = ("Permission is hereby granted, free", "Redistribution and use in source and binary")


def _replaced(c: Column) -> Column:
    for a, b in EQUIVALENT.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def canonical(text: Column) -> Column:
    """Lower case, copyright lines dropped, equivalent spellings; other than letters,
    digits and line ends only blanks are left."""
    c = F.replace(F.replace(F.lower(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(_replaced(F.regexp_replace(c, COPYRIGHT_LINE, "")), r"[^\p{L}\p{N}\n]+", " ")


def digest(c: Column) -> Column:
    c = F.trim(F.regexp_replace(c, r"[ \n]+", " "))
    for a, b in EQUIVALENT.items():
        if " " in a:  # there may have been a line end between its words
            c = F.replace(c, F.lit(a), F.lit(b))
    return F.md5(c)


def whole_texts() -> list[tuple[str, str]]:
    """(license_id, text) of the whole licences, those of ``BEGINNINGS`` also without what is before."""
    out = []
    for file in sorted(files("churnlab.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name):
        name, text = file.name.removesuffix(".txt") + "-text", file.read_text(encoding="utf-8")
        out += [(name, text), *((name, text[text.index(b) :]) for b in BEGINNINGS if b in text)]
    return out


def known_digests(spark: SparkSession, known: dict[str, str] = KNOWN) -> DataFrame:
    """(license_id, digest) of the known texts; among equal digests the first id."""
    rows = spark.createDataFrame([*known.items(), *whole_texts()], "license_id string, body string")
    rows = rows.select("license_id", digest(canonical(F.col("body"))).alias("digest"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, unit, license_id, n_units): the units (document, paragraph or line) of
    each document whose canonical digest is a known one, counted."""
    # the canonical form is made once for the three kinds of unit
    text = docs.filter("text is not null").select("doc_id", canonical(F.col("text")).alias("body"))

    def units(name: str, pattern: str) -> Column:
        return F.transform(F.split("body", pattern), lambda b: F.struct(F.lit(name).alias("unit"), b.alias("body")))

    whole = F.array(F.struct(F.lit("document").alias("unit"), F.col("body").alias("body")))
    parts = text.select("doc_id", F.inline(F.concat(whole, units("paragraph", r"\n *\n"), units("line", r"\n"))))
    parts = parts.filter(F.trim(F.replace("body", F.lit("\n"), F.lit(" "))) != "")
    # never null, so that the join needn't make each digest once more to see that
    parts = parts.select("doc_id", "unit", F.coalesce(digest(F.col("body")), F.lit("")).alias("digest"))
    # the known texts are a parameter of a few rows
    return parts.join(F.broadcast(known), "digest").groupBy("doc_id", "unit", "license_id").agg(F.count("*").alias("n_units"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_digests(spark))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _oracle() -> str:
    canon = r"replace(replace(lower(text), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    canon = rf"regexp_replace({canon}, '(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*$', '', 'g')"
    for a, b in EQUIVALENT.items():
        canon = f"replace({canon}, {_sql_text(a)}, {_sql_text(b)})"
    canon = rf"regexp_replace({canon}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    md5 = r"md5(trim(regexp_replace(body, '[ \n]+', ' ', 'g')))"
    known = ", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in KNOWN.items())
    return rf"""
    WITH registry AS (SELECT digest, min(license_id) AS license_id FROM (
        SELECT license_id, {md5} AS digest FROM (
          SELECT license_id, {canon} AS body FROM (VALUES {known}) v(license_id, text))) GROUP BY digest),
    docs AS (SELECT doc_id, {canon} AS body FROM documents WHERE text IS NOT NULL),
    units AS (
        SELECT doc_id, 'document' AS unit, body FROM docs
        UNION ALL SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(body, '\n *\n')) FROM docs
        UNION ALL SELECT doc_id, 'line', unnest(string_split(body, chr(10))) FROM docs)
    SELECT doc_id, unit, license_id, count(*) AS n_units
    FROM (SELECT doc_id, unit, {md5} AS digest FROM units WHERE trim(replace(body, chr(10), ' ')) <> '') u
    JOIN registry USING (digest) GROUP BY doc_id, unit, license_id"""


ORACLE_SQL = _oracle()
