"""URL filter: allow and block rules, and gradient-boosted trees on lexical features for the rest (no Python workers).

The URLs that a rule decides are the labelled ones. Trees are fitted on at most ``train_rows`` of them (chosen by a hash of
the URL, ties by the URL) and judge every URL without a rule. The rate of blocked URLs of a host's suffix (its last two labels) is counted out of fold: hosts are
dealt into FOLDS, and a URL's rate comes from labelled URLs of other folds, so that no label is a feature of itself.

Defined cases: a null URL or one without ``://`` has empty host and path, no rule, and is judged on its (empty) features;
very long URLs are read whole; without labelled URLs of both verdicts the model's verdict is the commoner one, or allow; an empty table gives no rows;
repeated rows are judged alike; null page_ids are reported as such; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

#: (verdict, host suffix, path prefix)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
FEATURES = ["length", "depth", "digit_ratio", "entropy", "params", "host_labels", "hyphens", "suffix_rate", "suffix_rows"]
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host (or a parent domain) and path; null if none does."""
    found = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(f"{h}{p}").alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r))
    ]
    best = F.coalesce(*found)
    return best["rule"], best["verdict"]


def lexical_features(pages: DataFrame) -> DataFrame:
    """Adds the features that come from the URL's own characters."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    counts = F.expr("transform(array_distinct(split(coalesce(url, ''), '')), c -> length(coalesce(url, '')) - length(replace(coalesce(url, ''), c, '')))")
    return (
        pages.withColumn("length", F.length(url).cast("double"))
        .withColumn("depth", F.length("path").cast("double") - F.length(F.translate("path", "/", "")))
        .withColumn("digit_ratio", (F.length(url) - F.length(F.translate(url, "0123456789", ""))) / n)
        .withColumn("counts", counts)
        .withColumn("entropy", F.expr("aggregate(counts, 0D, (a, c) -> a - IF(c > 0, c / greatest(length, 1D) * ln(c / greatest(length, 1D)), 0D))"))
        .withColumn("params", F.length(url).cast("double") - F.length(F.translate(url, "=", "")))
        .withColumn("host_labels", F.length("host").cast("double") - F.length(F.translate("host", ".", "")))
        .withColumn("hyphens", F.length("host").cast("double") - F.length(F.translate("host", "-", "")))
        .withColumn("suffix", F.substring_index("host", ".", -2))
        .drop("counts")
    )


def judge_urls(
    pages: DataFrame, rules=RULES, train_rows: int = 20_000, trees: int = 12, depth: int = 3, seed: int = 7, held_out: Column | None = None
) -> DataFrame:
    """(page_id, url) -> page_id, host, path, rule, verdict, score (the trees' probability of block, null where a rule decides).

    held_out: URLs that are judged by trees that don't know their label, in spite of a rule, to measure the trees.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = ruled if held_out is None else F.when(~held_out, ruled)
    urls = lexical_features(urls.withColumn("rule", rule).withColumn("ruled", ruled).withColumn("dealt", F.xxhash64("url", F.lit(seed))))
    urls = materialize(urls.withColumn("fold", F.pmod(F.xxhash64("host", F.lit(seed)), F.lit(FOLDS))), "urls")
    blocked = F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)
    counts = (
        urls.groupBy("suffix", "fold")
        .agg(F.count("*").alias("rows"), F.count("ruled").alias("labelled"), F.sum(F.when(F.col("ruled").isNotNull(), blocked).otherwise(0.0)).alias("bad"))
    )
    # FOLDS rows a suffix at most.
    every = Window.partitionBy("suffix")
    others = (F.sum("bad").over(every) - F.col("bad") + 1) / (F.sum("labelled").over(every) - F.col("labelled") + 2)
    stats = materialize(counts.select("suffix", "fold", F.log1p(F.sum("rows").over(every)).alias("suffix_rows"), others.alias("suffix_rate")), "url-suffixes")
    full = urls.join(stats, ["suffix", "fold"])
    sample = materialize(
        full.where("ruled is not null").select(*FEATURES, blocked.alias("label"), "dealt", "url").orderBy("dealt", "url").limit(train_rows).drop("url"),
        "url-sample",
    )
    classes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    if len(classes) == 2:
        # Trees stay small and fixed in number, so the fitted model does not grow with the input.
        model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=seed).fit(vectors.transform(sample.coalesce(2)))
        left = model.transform(vectors.transform(full.where("ruled is null")))
        score = F.element_at(vector_to_array("probability"), 2)
        judged = left.withColumn("score", score).withColumn("verdict", F.when(F.col("prediction") > 0.5, "block").otherwise("allow"))
    else:
        common = "block" if classes.get(1.0, 0) > classes.get(0.0, 0) else "allow"
        judged = full.where("ruled is null").withColumn("score", F.lit(float(common == "block"))).withColumn("verdict", F.lit(common))
    columns = ["page_id", "host", "path", "rule", "verdict", "score"]
    ruled = full.where("ruled is not null").withColumn("score", F.lit(None).cast("double")).withColumn("verdict", F.col("ruled"))
    return ruled.select(columns).unionByName(judged.select(columns))


def op8_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
