"""URL filters: listed rules first, then a logistic regression on hashed character n-grams.

The regression learns from a small table of labelled URLs. Its features are the character
n-grams of host and path, hashed to a fixed number of slots, so the model's size is fixed too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

#: Lengths of the n-grams, hash slots, and labelled URLs that a model is fitted on at most.
SHORTEST, LONGEST, SLOTS, LABELLED = 3, 5, 1 << 16, 20_000

#: (verdict, host, start of the path)
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(verdict, rule) of the longest rule that fits host or a domain above it and the path's start; else null."""
    if not rules:
        return F.lit(None).cast("struct<verdict: string, rule: string>")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
                   F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"))) for v, h, p in ordered]
    return F.coalesce(*fits)


def character_grams(host: Column, path: Column) -> Column:
    """N-grams of host and path between marks, told apart by a prefix."""
    def grams(text: Column, prefix: str) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        spans = F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda n: F.when(
            F.length(marked) >= n, F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1),
                                               lambda i: F.concat(F.lit(prefix), F.substring(marked, i, n)))).otherwise(F.array().cast("array<string>")))
        return F.flatten(spans)

    return F.concat(grams(host, "h:"), grams(path, "p:"))


def _features(urls: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=SLOTS, binary=True, inputCol="_grams", outputCol="_features").transform(
        urls.withColumn("_grams", character_grams(F.col("host"), F.col("path"))))


def fit_url_model(labelled: DataFrame, most: int = LABELLED):
    """A model from (host, path, block); a constant where fewer than two classes are labelled.

    Of more than `most` labelled URLs those with the smallest hash are taken. Classes weigh alike.
    """
    sample = labelled.orderBy(F.xxhash64("host", "path"), "host", "path").limit(most)
    counts = {r["block"]: r["n"] for r in sample.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(counts) < 2:
        return next(iter(counts), False)
    total = sum(counts.values())
    weight = F.when(F.col("block"), total / 2 / counts[True]).otherwise(total / 2 / counts[False])
    rows = _features(sample).select("_features", F.col("block").cast("double").alias("label"), weight.alias("weight"))
    return LogisticRegression(featuresCol="_features", weightCol="weight", regParam=1e-3, maxIter=40).fit(rows)


def url_verdicts(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url: str = "url", labelled: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, block_score) per row.

    The longest of the `rules` that fits decides, ties go to `allow`; else the model, which says
    block from a score of 1/2. It is trained on `labelled` (host, path, block), by default on
    the URLs of `pages` that a rule decides. `rules` is a list in the program, a few thousand at
    most; rule lists of that size become one expression.

    Null URLs and URLs without `://` have an empty host and path; no rule fits an empty path.
    Without labelled URLs of both classes the model says the class there is, or allow. Repeated
    rows get equal verdicts, rows with a null id are answered like any others. Very long URLs are
    hashed whole. Other columns are ignored, whatever their names; an empty table gives an empty
    result.
    """
    link = F.coalesce(F.col(url), F.lit(""))
    split = pages.select(F.col(id_col).alias("id"), host_of(link).alias("host"), path_of(link).alias("path"))
    ruled = split.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = ruled.filter("hit IS NOT NULL").select("host", "path", (F.col("hit.verdict") == "block").alias("block"))
    model = fit_url_model(labelled)
    if isinstance(model, bool):
        scored = ruled.withColumn("block_score", F.lit(float(model)))
    else:
        scored = model.transform(_features(ruled)).withColumn("block_score", vector_to_array("probability")[1])
    verdict = F.coalesce("hit.verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "block_score")
