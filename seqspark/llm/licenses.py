"""License scans: MinHash bands over text windows retrieve templates, exact containment verifies them.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import compute_once, keep

WORDS = 5
CONTAINMENT = 0.75
BANDS, ROWS = 32, 2

# Wording of public licenses and of common references to them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
    "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
    "specific language governing permissions and limitations under the License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
    "and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
    "later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
    "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def with_shingles(df: DataFrame, text: str) -> DataFrame:
    """Add __s: hashes of the 5-word shingles of a text in order; words are runs of letters and digits, in lower case."""
    split = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda x: x != "")
    grams = F.transform(
        F.sequence(F.lit(0), F.size("__w") - WORDS),
        lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(WORDS)]),
    )
    some = F.when(F.size("__w") >= WORDS, grams).otherwise(F.array().cast("array<bigint>"))
    return compute_once(compute_once(df, {"__w": split}), {"__s": some}).drop("__w")


def bands(s: Column) -> Column:
    """Hash of every band of a set's MinHash signature: BANDS bands of ROWS minima.

    A window with containment c of a template of its size has similarity c / (2 - c). The best window lies at most half
    a step, a sixteenth of its size, beside one of the grid, which then holds c - 1/16: 0.52 at c = 0.75; that one
    shares a band with probability 1 - (1 - 0.27)^32 > 0.9999.
    """
    def lowest(j: Column) -> Column:
        return F.array_min(F.transform(s, lambda x: F.xxhash64(x, j)))

    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *[lowest(b * ROWS + r) for r in range(ROWS)]))


def template_table(df: DataFrame, templates: dict[str, str]) -> DataFrame:
    """license, its distinct shingles and their number. The table has one row per template."""
    rows = df.sparkSession.range(1).select(F.explode(F.create_map(*[F.lit(x) for kv in templates.items() for x in kv])).alias("license", "__t"))
    made = with_shingles(rows, "__t").select("license", F.array_distinct("__s").alias("shingles"))
    return made.withColumn("n", F.size("shingles")).where("n > 0")


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and license found: key, license, n_windows, containment, first_shingle, best_containment.

    Every whole text is cut into overlapping windows of each template size (in shingles, a step of an eighth). Windows
    without any shingle of a template have no minimum in common with one and are passed over, exactly; the others'
    bands are looked up among the templates' bands. What meets is verified by the exact containment of the template's
    shingles in the windows at every start within a step of it: a license is found if the best of them, best_containment,
    suffices, wherever it stands. n_windows counts the windows of the grid that suffice; containment is the largest and
    first_shingle the first start of these, or those of the best window where none does. Templates are a parameter: their tables, a row per shingle and band, are broadcast.
    Null, empty and short texts give no rows; a null or repeated key is carried, rows being told apart by a row number;
    equal rows give equal results each; an empty table gives no rows; other columns are not carried.
    """
    facts = keep(template_table(docs, templates), "license-templates")
    known = [r[0] for r in facts.select(F.explode("shingles")).distinct().collect()]
    sizes = sorted({r[0] for r in facts.select("n").collect()})
    rows = docs.select(F.col(key).alias("__key"), F.monotonically_increasing_id().alias("__row"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    held = with_shingles(rows, "__t").drop("__t").where(F.arrays_overlap("__s", F.array(*[F.lit(k) for k in known])))
    held = keep(held, "license-texts")

    of_template = F.broadcast(facts.select(F.explode("shingles").alias("__h")).distinct())
    hits = held.select("__row", F.posexplode("__s").alias("__at", "__h")).join(of_template, "__h").select("__row", "__at")
    size = F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n")
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 8)).cast("int")
    # windows start at multiples of the step; those that hold the place of a hit
    first = F.greatest(F.lit(0), F.ceil((F.col("__at") - F.col("n") + 1) / F.col("__step"))).cast("int")
    windows = (
        hits.select("__row", "__at", size)
        .withColumn("__step", step)
        .withColumn("__start", F.explode(F.sequence(first, F.floor(F.col("__at") / F.col("__step")).cast("int"))))
        .select("__row", "n", (F.col("__start") * F.col("__step")).alias("__start"))
        .distinct()
    )
    cut = windows.join(held.withColumnRenamed("__s", "__all"), "__row")
    # the shingles of a window and of a step on both sides of it
    from_ = F.greatest(F.lit(0), F.col("__start") - step)
    cut = cut.withColumn("__from", from_).withColumn("__off", (F.col("__start") - F.col("__from")).cast("int"))
    around = F.slice("__all", F.col("__from").cast("int") + 1, (F.col("__off") + F.col("n") + step).cast("int"))
    cut = compute_once(cut, {"__s": F.array_distinct(F.slice("__all", F.col("__start").cast("int") + 1, F.col("n"))), "__around": around}).drop("__all")
    banded = cut.select("__key", "__row", "n", "__start", "__from", "__off", "__s", "__around", F.posexplode(bands(F.col("__s"))).alias("__band", "__b"))
    wanted = facts.select("license", "shingles", "n", F.posexplode(bands(F.col("shingles"))).alias("__band", "__b"))
    met = banded.join(F.broadcast(wanted), ["n", "__band", "__b"]).dropDuplicates(["__row", "n", "__start", "license"])
    # a window a step away holds at most a step more of the template
    share = F.size(F.array_intersect("__s", "shingles"))
    near = compute_once(met, {"__share": share}).where(F.col("__share") + step >= containment * F.col("n"))
    starts = F.sequence(F.lit(0), F.least(F.size("__around") - 1, F.col("__off") + step))
    at = F.transform(
        starts,
        lambda i: F.struct((F.size(F.array_intersect(F.slice("__around", i + 1, F.col("n")), "shingles")) / F.col("n")).alias("c"), (-F.col("__from") - i).alias("at")),
    )
    near = compute_once(near, {"__best": F.array_max(at), "__c": F.col("__share") / F.col("n")})
    sure = F.col("__c") >= containment
    found = near.groupBy("__row", "license").agg(
        F.first("__key").alias("__key"), F.count_if(sure).alias("n_windows"), F.max(F.when(sure, F.col("__c"))).alias("__c"),
        F.min(F.when(sure, F.col("__start"))).alias("__start"), F.max("__best").alias("__best"),
    )
    found = found.where(F.col("__best.c") >= containment).select(
        "__key", "license", "n_windows", F.coalesce("__c", "__best.c").alias("containment"),
        F.coalesce("__start", -F.col("__best.at")).cast("long").alias("first_shingle"), F.col("__best.c").alias("best_containment"),
    )
    return found.select(F.col("__key").alias(key), "license", "n_windows", "containment", "first_shingle", "best_containment")
