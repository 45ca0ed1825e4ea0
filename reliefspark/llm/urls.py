"""URL filter: rules by host and path, and boosted trees where no rule fits.

All of it is DataFrame expressions and spark.ml: lexical features (length, depth, digit
ratio, entropy, parameter counts) and suffix statistics (smoothed shares of blocked
URLs for each top-level domain, registered domain and first path part) feed gradient-
boosted trees. The labelled URLs are those that a rule decides; statistics count all of
them, the trees are fitted on a bounded sample. A labelled URL's own fold of hosts is left
out of its suffix statistics, so trees do not see a label through its own share.

Null URLs and those without "://" have empty host and path and are judged by the
method. Repeated pages are judged row by row; other columns are ignored. If rules label
one class only, that is the method's verdict everywhere; without any, "allow".
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Labelled URLs, at most, that the trees are fitted on.
TRAIN_ROWS = 20_000
#: Parts of the hosts; a labelled row's suffix statistics come from the parts that its host is not in.
FOLDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, tail (what follows the path)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    df = pages.select("page_id", url.alias("url"), rest.alias("rest"))
    df = df.withColumn("raw_host", F.regexp_extract("rest", "^[^/?#]*", 0))
    after = F.substring(F.col("rest"), F.length("raw_host") + 1, F.length("rest"))
    df = df.withColumn("after", after).withColumn("path", F.regexp_extract("after", "^[^?#]*", 0))
    return df.select("page_id", "url", F.translate("raw_host", _UPPER, _LOWER).alias("host"), "path", F.substring(F.col("after"), F.length("path") + 1, F.length("after")).alias("tail"))


def rule_columns(rules) -> tuple[Column, Column]:
    """The fitting rule (host and path written together) and its verdict; the longest rule wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _count(column: str, part: str) -> Column:
    return F.length(column) - F.length(F.replace(F.col(column), F.lit(part), F.lit("")))


def lexical() -> dict[str, Column]:
    """Features of a URL alone."""
    n = F.greatest(F.length("url"), F.lit(1)).cast("double")
    share = lambda ch: (F.length("url") - F.length(F.replace(F.col("url"), ch, F.lit("")))) / n
    chars = F.array_remove(F.array_distinct(F.split("url", "")), "")
    entropy = F.aggregate(F.transform(chars, lambda ch: -share(ch) * F.log2(share(ch))), F.lit(0.0), lambda a, x: a + x)
    digits = F.length("url") - F.length(F.regexp_replace("url", "[0-9]", ""))
    return {
        "f_length": F.length("url"),
        "f_host": F.length("host"),
        "f_labels": _count("host", "."),
        "f_depth": _count("path", "/"),
        "f_path": F.length("path"),
        "f_digits": digits / n,
        "f_path_digits": F.length("path") - F.length(F.regexp_replace("path", "[0-9]", "")),
        "f_entropy": entropy,
        "f_params": F.when(F.col("tail").startswith("?"), _count("tail", "&") + 1).otherwise(F.lit(0)),
        "f_fragment": F.instr("tail", "#") > 0,
        "f_secure": F.col("url").startswith("https:"),
        "f_dashes": _count("url", "-") + _count("url", "_"),
        "f_www": F.col("host").startswith("www."),
        "f_extension": F.col("path").rlike("[.][A-Za-z0-9]{1,5}$"),
    }


def suffixes() -> dict[str, Column]:
    """Keys whose share of blocked URLs is a feature."""
    labels = F.split("host", "[.]")
    top = F.element_at(labels, -1)
    first = F.regexp_extract("path", "^/([^/]*)", 1)
    return {"k_top": top, "k_domain": F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)), "k_first": first, "k_top_first": F.concat_ws("/", top, first)}


def suffix_shares(df: DataFrame, k: str, folds: int = FOLDS) -> DataFrame:
    """Adds r_k and n_k: the smoothed share of blocked URLs of a suffix, and the log of how many are labelled.

    A labelled row gets the counts of the other folds alone, so its own host's labels never
    reach it and trees learn how far a suffix can be trusted on hosts not seen before.
    """
    labelled = df.where(F.col("given").isNotNull()).withColumn("bad", (F.col("given") == "block").cast("double"))
    # partial aggregation shrinks hot suffixes before the shuffle; the joins can be split or broadcast by their measured size
    by_fold = labelled.groupBy(F.col(k).alias("key"), F.col("fold").alias("own")).agg(F.sum("bad").alias("b"), F.count("*").alias("n"))
    every = by_fold.groupBy("key").agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("own", F.struct("b", "n")))).alias("folds"))
    own = F.when(F.col("given").isNotNull(), F.element_at("folds", F.col("fold")))  # at most `folds` entries for a suffix
    bad, n = (F.coalesce(F.col(x), F.lit(0)) - F.coalesce(own[x], F.lit(0)) for x in ("b", "n"))
    joined = df.join(every, df[k] == every["key"], "left")
    return joined.withColumns({"r_" + k: (bad + 1) / (n + 2), "n_" + k: F.log1p(n)}).drop("key", "b", "n", "folds")


def with_features(pages: DataFrame, rules, hidden: int | None = None) -> tuple[DataFrame, list[str]]:
    """Pages with rule, truth (the rule's verdict), given (truth but for the hidden fold) and features; the features' names."""
    rule, verdict = rule_columns(rules)
    df = parsed(pages).withColumn("rule", rule).withColumn("truth", verdict).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))
    df = df.withColumn("given", F.col("truth") if hidden is None else F.when(F.col("fold") != hidden, F.col("truth")))
    df = df.withColumns({k: c.cast("double") for k, c in lexical().items()} | suffixes())
    names = list(lexical())
    for k in suffixes():
        df = suffix_shares(df, k)
        names += ["r_" + k, "n_" + k]
    return df, names


def _fit(train: DataFrame, names: list[str], trees: int, depth: int):
    """A function that adds `score`, the chance of "block", and the number of each label seen."""
    train = train.select(*names, (F.col("given") == "block").cast("double").alias("label")).persist()
    seen = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(seen) == 2:
        gather = VectorAssembler(inputCols=names, outputCol="features")
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=11, cacheNodeIds=False).fit(gather.transform(train))
        chance = F.element_at(vector_to_array("probability"), 2)
        out = lambda df: model.transform(gather.transform(df)).withColumn("score", chance)
    else:
        out = lambda df: df.withColumn("score", F.lit(1.0 if set(seen) == {1.0} else 0.0))
    train.unpersist()
    return out


def _sampled(df: DataFrame) -> DataFrame:
    return df.where(F.col("given").isNotNull()).orderBy(F.xxhash64("page_id", "url"), "page_id").limit(TRAIN_ROWS)


def judge(pages: DataFrame, rules=RULES, trees: int = 20, depth: int = 4) -> DataFrame:
    """page_id, host, path, rule and verdict of every page, and score, the method's own chance of "block"."""
    df, names = with_features(pages, rules)
    scored = _fit(_sampled(df), names, trees, depth)(df)
    own = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("given", own).alias("verdict"), "score")


def held_out_accuracy(pages: DataFrame, rules=RULES, trees: int = 20, depth: int = 4) -> tuple[float, int]:
    """Share of labelled URLs of held-out hosts (fold 0) that the method alone judges as their rule does, and their number.

    Nothing of these hosts takes part in training: their labels are hidden from suffix shares and trees.
    """
    df, names = with_features(pages, rules, hidden=0)
    tested = _fit(_sampled(df), names, trees, depth)(df.where((F.col("fold") == 0) & F.col("truth").isNotNull()))
    row = tested.agg(F.avg(((F.col("score") > 0.5) == (F.col("truth") == "block")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    return row["a"] or 0.0, row["n"]


def op3_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
