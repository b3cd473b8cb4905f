"""License notices in texts: MinHash bands over overlapping windows, then exact containment; DataFrame operations only.

Words are runs of a-z and 0-9 after lower-casing A-Z; shingles are three words. A text's shingles are cut into windows of
6 that start at every third one, so any run of 4 lies inside a window. Templates are cut into runs of at most 4. A window that
holds a run whole shares at least 3 of its 6 shingles with it; with 24 bands of one minimum each, the run's template is
retrieved with probability 1 - 2^-24 or more. Retrieved templates are verified by counting how many of their distinct shingles
the text holds; `enough` of them make a match.

A window without any template shingle cannot share a minimum with a template. Texts and windows without one are therefore
left out before their minima are taken, which loses nothing.

Defined results: null, empty and very short texts have no shingles and give no row; a text gives one row for each template
that it matches, however often; repeated rows and rows without doc_id each give their own. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public license notices, by name.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", 'you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MIT", "Released under the MIT License."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WIDTH, STEP, RUN, BANDS = 6, 3, 4, 24


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[^a-z0-9]+"), "")


def shingles(w: Column) -> Column:
    """64-bit hashes of the three-word shingles, in order."""
    at = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))


def minima(window: Column) -> Column:
    """One key a band: the band's number with the least hash of a shingle under the band's hash function."""
    def least(b: int) -> Column:
        return F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(b))))

    return F.array(*[F.xxhash64(F.lit(b), least(b)) for b in range(BANDS)])


def windows(s: Column, width: int, step: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)), F.lit(step)), lambda i: F.slice(s, i + 1, width))


def templates(spark: SparkSession, notices: Iterable[tuple[str, str]] = NOTICES) -> DataFrame:
    """license, wanted (distinct shingles): a table of fixed size."""
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in notices])
    split = spark.range(1).select(F.explode(rows).alias("t")).select("t.license", words(F.col("t.text")).alias("w"), F.monotonically_increasing_id().alias("row"))
    return split.select("license", F.array_distinct(shingles(F.col("w"))).alias("wanted"))


def matches(docs: DataFrame, notices: Iterable[tuple[str, str]] = NOTICES, enough: float = 0.8) -> DataFrame:
    """doc_id, license, n_found, n_shingles, containment: the templates of which a text holds at least `enough`."""
    spark = docs.sparkSession
    known = spark.createDataFrame(templates(spark, notices).collect(), "license string, wanted array<long>")  # fixed by the templates
    # some hundred numbers, fixed by the templates
    any_of = F.array(*[F.lit(x) for (x,) in known.select(F.explode("wanted")).distinct().orderBy("col").collect()])
    keys = (known.select("license", "wanted", F.explode(windows(F.col("wanted"), RUN, 1)).alias("run"))
            .where((F.size("run") == RUN) | (F.size("wanted") < RUN)).select("license", "wanted", F.explode(minima(F.col("run"))).alias("key")).distinct())
    # the row number also keeps the filter above the split, which would otherwise run once for every shingle
    held = (docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
            .select("doc_id", "row", shingles(F.col("w")).alias("held")).where(F.arrays_overlap("held", any_of)))
    cut = held.withColumn("window", F.explode(windows(F.col("held"), WIDTH, STEP))).where(F.arrays_overlap("window", any_of))
    met = cut.withColumn("key", F.explode(minima(F.col("window")))).join(F.broadcast(keys), "key")
    return (met.select("row", "doc_id", "license", F.size(F.array_intersect("wanted", "held")).alias("n_found"), F.size("wanted").alias("n_shingles"))
            .where(F.col("n_found") >= F.lit(enough) * F.col("n_shingles")).distinct()
            .select("doc_id", "license", F.col("n_found").cast("long"), F.col("n_shingles").cast("long"), (F.col("n_found") / F.col("n_shingles")).alias("containment")))


def check_sql(notices: Iterable[tuple[str, str]] = NOTICES, enough: float = 0.8) -> str:
    """The same rows by comparing every text with every template."""
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in notices)
    cut = "list_filter(regexp_split_to_array(translate(text, '{}', '{}'), '[^a-z0-9]+'), lambda x: x <> '')".format(UPPER, LOWER)
    grams = "list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"
    return f"""
with t as (select license, {grams} as s from (select license, {cut} as w from (values {values}) as v(license, text))),
d as (select doc_id, {grams} as s from (select doc_id, {cut} as w from documents where text is not null)),
m as (select doc_id, license, len(list_intersect(t.s, d.s)) as n_found, len(t.s) as n_shingles from d, t)
select doc_id, license, cast(n_found as bigint) as n_found, cast(n_shingles as bigint) as n_shingles, n_found / n_shingles as containment
from m where n_found >= {enough} * n_shingles
"""
