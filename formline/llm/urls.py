"""URL filters: rules of host and path, and logistic regression where no rule fits.

All of it is column code and Spark ML on columns; no row ever leaves the JVM.  The features are
character n-grams of host and path, hashed into a vector of fixed size.  The model is fitted on a
small labelled table and has that many weights whatever the number of pages.  Judging is one pass
over the rows without a shuffle, so no host can be too frequent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm.registry import query, table

FEATURES, GRAMS = 1 << 15, (3, 4, 5)
RIDGE, ITERATIONS, THRESHOLD = 0.002, 100, 0.5
#: Most labelled rows that are learnt from; a larger table is refused, not cut.
MOST_LABELLED = 100_000
ALLOW, BLOCK = "allow", "block"

# The rules of the query, as (verdict, host and path).
RULES = (
    (ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"),
    (ALLOW, "com/fr/"), (BLOCK, "com/de/"),
)

# The small labelled table: words of unwanted and of ordinary hosts, put into URLs by rule.
UNWANTED = (
    "casino", "poker", "jackpot", "slots", "bets", "betting", "winbig", "lottery", "pills",
    "viagra", "cheap-meds", "pharma-deal", "diet-pills", "free-gift", "free-cash", "adult",
    "xxx-cam", "sexdate", "spam", "link-farm", "spam-host", "click-ads", "ads-serve", "track",
    "tracker", "adserver", "popunder", "payday-loan", "cheap-watch", "replica",
)
ORDINARY = (
    "news", "daily-post", "weather", "river", "museum", "library", "garden", "kitchen", "travel",
    "history", "science", "theatre", "forum", "recipes", "school", "nature", "streets", "harbour",
    "letters", "nation", "thermal", "internet", "theory", "station", "another", "gathering",
    "whether", "motion", "thread", "earth",
)
_PREFIXES = ("", "www.", "m.", "blog.")
_ENDINGS = ("", "/", ".html", "?page=2", "#top")
_ZONES = ("example.com", "example.net", "example.org")
_FOLDERS = ("en", "de", "fr", "es")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, unwanted 0/1): hosts in each zone, with other parts of the URL taken in turn.

    An ordinary word also stands joined to the next ones: most hosts are ordinary, and a host
    whose n-grams were never seen is to pass.
    """
    joined = [w for n, word in enumerate(ORDINARY) for a, b in [
        (ORDINARY[(n + 1) % len(ORDINARY)], ORDINARY[(n + 7) % len(ORDINARY)])]
        for w in (word, word + a, f"{word}-{b}", f"the{word}")]
    rows = [(f"https://{_PREFIXES[(n + n // 4) % 4]}{word}.{zone}/{_FOLDERS[(n + z) % 4]}/"
             f"{(n * 37 + z * 411) % 997}{_ENDINGS[n % 5]}", unwanted)
            for unwanted, words in ((1, UNWANTED), (0, joined))
            for n, word in enumerate(words) for z, zone in enumerate(_ZONES)]
    return spark.createDataFrame(rows, "url string, unwanted int")


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host: between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased.  Path: from there up to ``?``, ``#`` or the end.  Both are empty without ``://``
    and for NULL."""
    text = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: str, path: str, rules: Sequence[tuple[str, str]]
                 ) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; NULL without.

    A rule fits its host and all subdomains, if the path starts with the rule's.  Of rules of one
    length the one with the longer host wins, then the one that blocks.  The rules are part of the
    plan: hundreds, not millions.
    """
    def order(rule):
        verdict, text = rule
        return -len(text), -text.index("/"), verdict != BLOCK
    own, under = F.col(host), F.concat(F.lit("."), F.col(host))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=order, reverse=True):  # the strongest one is outermost
        at = text.index("/")
        fits = under.endswith("." + text[:at]) & (own != "") & F.col(path).startswith(text[at:])
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def grams(text: Column, prefix: str, sizes: Sequence[int] = GRAMS) -> Column:
    """Character n-grams of ``text`` between border signs, marked by ``prefix``.

    Characters are split once, so the work is linear in the length of the text.
    """
    def of_size(chars: Column, n: int) -> Column:
        starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(
            F.lit(prefix), *[F.get(chars, i + k) for k in range(n)]))

    def of(chars: Column) -> Column:
        return F.flatten(F.array(*[of_size(chars, n) for n in sizes]))
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    # A one-element array binds the characters, so they are split once for all sizes.
    return F.flatten(F.transform(F.array(chars), of))


def with_features(df: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """Adds ``_features``: whether each hashed n-gram of host and path is there."""
    parts = F.concat(grams(F.col(host), "h"), grams(F.col(path), "p"))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams",
                     outputCol="_features").transform(df.withColumn("_grams", parts)).drop("_grams")


def fit(labelled: DataFrame, url: str = "url", unwanted: str = "unwanted"
        ) -> LogisticRegressionModel:
    """Logistic regression of ``unwanted`` (1) on the features of ``url``.

    Rows without label are left out.  At most ``MOST_LABELLED`` rows are accepted.  One row is
    added, an empty URL that is wanted; so a table without rows lets everything pass.
    """
    labelled = labelled.select(url, unwanted).unionByName(labelled.sparkSession.createDataFrame(
        [("", 0)], f"{url} string, {unwanted} int"))
    rows = labelled.where(F.col(unwanted).isin(0, 1)).select(
        *[c.alias(n) for c, n in zip(host_and_path(url), ("host", "path"), strict=True)],
        F.col(unwanted).cast("double").alias("_y"))
    if rows.limit(MOST_LABELLED + 1).count() > MOST_LABELLED:
        raise ValueError(f"the labelled table has more than {MOST_LABELLED} rows")
    # One small partition: sums have one order and the weights are always the same.
    return LogisticRegression(
        featuresCol="_features", labelCol="_y", regParam=RIDGE, maxIter=ITERATIONS,
        standardization=False, probabilityCol="_chance", rawPredictionCol="_raw",
        predictionCol="_class").fit(with_features(rows).coalesce(1))


def judged(pages: DataFrame, model: LogisticRegressionModel,
           rules: Sequence[tuple[str, str]] = RULES, url: str = "url",
           threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (chance of being unwanted) as last
    columns; columns of these names are replaced.

    NULL URLs and URLs without ``://`` have an empty host and path, fit no rule and get the verdict
    of the model for nothing at all.  Repeated rows are judged alike; an empty table stays empty.
    """
    new = ("host", "path", "rule", "verdict", "score")
    kept = [c for c in pages.columns if c not in new]
    host, path = host_and_path(F.col(f"`{url}`").cast("string"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_kept"),
                        host.alias("host"), path.alias("path"))
    scored = model.transform(with_features(rows)).withColumn(
        "score", F.get(vector_to_array("_chance"), 1))
    rule, verdict = rule_columns("host", "path", rules)
    return scored.select(*[F.col("_kept").getField(c).alias(c) for c in kept], "host", "path",
                         rule.alias("rule"), F.coalesce(verdict, F.when(
                             F.col("score") >= threshold, BLOCK).otherwise(ALLOW)).alias("verdict"),
                         "score")


@query("op11_url_filter")
def op11_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, fit(labelled_urls(spark))).drop("url")
