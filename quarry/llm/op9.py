"""License scans by a trained paragraph classifier.

A paragraph is a line that isn't blank. Word unigrams and bigrams of the license notices are the features
of a multinomial logistic regression with an L1 penalty (sparse weights) over the licence
families and the class "unknown". It is trained on variants of the notices and on half of all
the corpus' own paragraphs that match no notice (by hash); paragraphs with equal features are one row
with their number as weight, and weights are scaled so that all together count for
``unknown_weight`` at most, or the notices would vanish in a large corpus. The unknown class is calibrated: a family
needs a probability above what nearly all unknown paragraphs of the other half reach. A prediction is confirmed by comparison with
the family's notices: the paragraph must hold 80 % of the five-word shingles of one of them.

Main path: DataFrame functions and the JVM's own feature and classifier stages.

Defined cases: null texts have no paragraphs; rows repeated whole count as one row each;
extra columns are ignored; an empty corpus is scanned by a classifier trained on notices and
the built-in other sentences; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, drop, lower_ascii, scratch

UNKNOWN, SHINGLE, NEAR, UNKNOWN_WEIGHT = "unknown", 5, 0.8, 2000.0

#: Common notices of each family.
NOTICES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache License 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License v3.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0."],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
}
#: Sentences that hold words of notices and grant nothing.
OTHERS = [
    "You need a driving license to rent a car.", "The license of the pub was renewed under the new law.", "Version 2.0 was released in May.",
    "The general public is free to visit.", "The committee released a public version of the report.", "All rights reserved.",
    "Apache is the name of a people.", "MIT is a university.", "The work is under way.", "The license was revoked.",
    "Licensed premises are open until midnight.", "Permission was granted by the court.", "A creative work in the commons.",
]


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), r"[^a-z0-9\x{80}-\x{10FFFF}]+"), lambda w: w != "")


def grams(tokens: Column, n: int) -> Column:
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def features(tokens: Column) -> Column:
    pairs = F.zip_with(tokens, F.slice(tokens, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(tokens, F.filter(pairs, lambda x: x.isNotNull()))


def shingles(tokens: Column) -> Column:
    short = F.size(tokens) < SHINGLE
    return F.when(short, F.array(F.array_join(tokens, " "))).otherwise(F.array_distinct(grams(tokens, SHINGLE)))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def notices(spark: SparkSession) -> DataFrame:
    """(family, notice): the fixed table as rows."""
    rows = ", ".join(f"({_literal(f)}, {_literal(t)})" for f, own in NOTICES.items() for t in own)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(family, notice)")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n, paragraph); ``mark``: xxhash64 of the text."""
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("mark"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("n", "paragraph"))
    return rows.filter(F.trim("paragraph") != "")


def _vocabulary() -> list[str]:
    found: dict[str, None] = {}
    for own in NOTICES.values():
        for notice in own:
            w = re.findall(r"[a-z0-9]+", notice.lower())
            found |= dict.fromkeys([*w, *(f"{a} {b}" for a, b in zip(w[:-1], w[1:], strict=True))])
    return list(found)


class Model:
    """The trained parts: features, classifier, families in order and the threshold."""

    def __init__(self, counter: CountVectorizerModel, classifier: LogisticRegressionModel, families: list[str], threshold: float):
        self.counter, self.classifier, self.families, self.threshold = counter, classifier, families, threshold

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows with ``tokens`` -> the same with ``family`` and ``probability``."""
        return self.classify(self.counter.transform(rows.withColumn("grams", features(F.col("tokens")))), rows.columns)

    def classify(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """Rows with ``features`` -> the columns ``keep`` with ``family`` and ``probability``."""
        out = self.classifier.transform(rows)
        p = vector_to_array("probability")
        known = F.slice(p, 1, len(self.families) - 1)
        out = out.select(*keep, F.array_max(known).alias("top"), known.alias("known"))
        family = F.element_at(F.array(*[F.lit(f) for f in self.families[:-1]]), F.array_position("known", F.col("top")).cast("int"))
        return out.select(*keep, F.when(F.col("top") > self.threshold, family).otherwise(UNKNOWN).alias("family"), F.col("top").alias("probability"))


def confirm(rows: DataFrame) -> DataFrame:
    """Adds ``likeness``: the largest share of a notice's shingles that the paragraph holds."""
    table = notices(rows.sparkSession).select(F.col("family"), shingles(words(F.col("notice"))).alias("own"))
    table = table.groupBy("family").agg(F.collect_list("own").alias("notices"))  # one row a family
    both = rows.join(F.broadcast(table), "family", "left").withColumn("held", shingles(F.col("tokens")))
    # a paragraph longer than a short notice has five-word shingles only; compare by the notice's own length
    text = F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" "))
    share = F.transform("notices", lambda t: F.when((F.size(t) == 1), text.contains(F.concat(F.lit(" "), t[0], F.lit(" "))).cast("double")).otherwise(F.size(F.array_intersect(t, F.col("held"))) / F.size(t)))
    return both.withColumn("likeness", F.coalesce(F.array_max(share), F.lit(0.0))).drop("notices", "held")


def kinds(docs: DataFrame, counter: CountVectorizerModel) -> DataFrame:
    """(features, half, times) of all corpus paragraphs that hold no notice; ``half``: 0 or 1 by hash."""
    rows = paragraphs(docs).select(words(F.col("paragraph")).alias("tokens"), F.pmod(F.xxhash64("paragraph", "doc_id", "n"), F.lit(2)).alias("half"))
    rows = rows.withColumn("joined", F.array_join("tokens", " "))
    for own in NOTICES.values():
        for notice in own:
            rows = rows.filter(~F.col("joined").contains(" ".join(re.findall(r"[a-z0-9]+", notice.lower()))))
    vectors = counter.transform(rows.select("half", features(F.col("tokens")).alias("grams")))
    return vectors.groupBy("features", "half").agg(F.count("*").alias("times"))


def train(docs: DataFrame, unknown_weight: float = UNKNOWN_WEIGHT) -> Model:
    spark = docs.sparkSession
    families = [*NOTICES, UNKNOWN]
    counter = CountVectorizerModel.from_vocabulary(_vocabulary(), "grams", "features")
    counter.setBinary(True)
    texts = notices(spark).select("family", words(F.col("notice")).alias("tokens"))
    # variants: whole, and with one word in nine left out, nine ways
    gone = F.explode(F.sequence(F.lit(-1), F.lit(8))).alias("gone")
    good = texts.select("family", "tokens", gone).select("family", F.filter("tokens", lambda w, i: (F.col("gone") < 0) | (i % 9 != F.col("gone"))).alias("tokens"), F.lit(2.0).alias("weight"))
    rows = ", ".join(f"({_literal(t)})" for t in OTHERS)
    other = spark.sql(f"SELECT * FROM VALUES {rows} AS t(text)").select(F.lit(UNKNOWN).alias("family"), words(F.col("text")).alias("tokens"), F.lit(5.0).alias("weight"))
    corpus = scratch(kinds(docs, counter), "kinds")
    total = corpus.filter("half = 0").agg(F.sum("times")).first()[0] or 0
    own = corpus.filter("half = 0").select("features", F.lit(len(families) - 1.0).alias("label"), (F.col("times") * min(1.0, unknown_weight / max(1, total))).alias("weight"))
    number = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    data = good.unionByName(other)
    # an unknown word or no word at all must stay unknown
    data = data.withColumn("label", number).withColumn("grams", features(F.col("tokens")))
    fit = LogisticRegression(family="multinomial", featuresCol="features", labelCol="label", weightCol="weight", regParam=0.0005, elasticNetParam=0.5, maxIter=60, standardization=False)
    classifier = fit.fit(counter.transform(data).select("features", "label", "weight").unionByName(own))
    model = Model(counter, classifier, families, 0.0)
    # the threshold lies between 0.5 and 0.9, so what is beyond needs no value of its own
    bounded = F.greatest(F.lit(0.5), F.least(F.lit(0.9), F.col("probability"))).alias("p")
    seen = model.classify(corpus.filter("half = 1"), ["times"]).select("times", bounded).agg(F.expr("percentile(p, 0.999, times)")).first()[0]
    drop(corpus)
    model.threshold = seen or 0.5
    return model


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, mark, n, paragraph, family, probability, likeness, confirmed) of the paragraphs predicted to be a notice."""
    rows = paragraphs(docs).withColumn("tokens", words(F.col("paragraph")))
    found = confirm(model.predict(rows).filter(F.col("family") != UNKNOWN))
    return found.withColumn("confirmed", F.col("likeness") >= NEAR).drop("tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = scan(docs, train(docs)).filter("confirmed")
    of = found.groupBy("doc_id", "mark").agg(F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.countDistinct("n").alias("n_licenses"), F.min("n").alias("first_paragraph"), F.max("probability").alias("probability"))
    text = F.col("text").cast("string")
    n = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.trim(p) != ""))
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("m"), n.cast("long").alias("n_paragraphs"))
    out = rows.join(of, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark")), "left")
    return out.select(F.col("id").alias("doc_id"), "n_paragraphs", F.coalesce("n_licenses", F.lit(0)).alias("n_licenses"), F.coalesce("families", F.lit("")).alias("families"), "first_paragraph", "probability")


QUERIES = {"op9_license_scan": query}
ORACLES: dict[str, str] = {}
