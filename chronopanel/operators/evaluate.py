"""Evaluation of predicted probabilities, by model and test year or pooled: all by ordered sums over distinct scores.

Rows are summed up by distinct score first, and prefix sums go slice by slice (:mod:`ordered`), so no task holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.operators.ordered import at_ranks, order_key, prefix_sums, quantiles, text_key
from chronopanel.sources.tables import written

EDGE = 1e-8
#: Places to which probabilities are summed up where means are compared between engines: integers add up alike in any order.
PLACES = 12


def curve(predictions: DataFrame, by: list[str]) -> DataFrame:
    """A point for each distinct score of a group, from the highest: precision and recall if all from there up are selected."""
    each = predictions.groupBy(*by, F.col("predicted_probability").alias("score")).agg(F.count("*").alias("n"), F.sum("observed").cast("long").alias("hits"))
    each = written(each, "curve-scores", keep=True)
    out = prefix_sums(each, by, F.col("score"), [], {"selected": F.col("n"), "captured": F.col("hits")}, descending=True)
    out = out.join(each.groupBy(*by).agg(F.sum("hits").alias("positives"), F.sum("n").alias("rows")), by)
    return out.withColumns({"precision": F.col("captured") / F.col("selected"), "recall": F.when(F.col("positives") > 0, F.col("captured") / F.col("positives"))})


def metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """n, positives, prevalence, average precision (steps over distinct scores), ROC AUC (by mid-ranks), Brier score and log loss."""
    points = curve(predictions, by)
    # of pairs of a positive and a negative: the negatives below count whole, those at the same score half
    below = F.col("rows") - F.col("selected") - (F.col("positives") - F.col("captured"))
    ranked = points.groupBy(*by).agg(
        F.max("rows").alias("n"), F.max("positives").alias("positives"), F.sum(F.when(F.col("positives") > 0, F.col("hits") / F.col("positives") * F.col("precision"))).alias("average_precision"),
        F.sum(F.col("hits") * (below + (F.col("n") - F.col("hits")) / 2)).alias("wins"),
    )
    ranked = ranked.withColumn("prevalence", F.col("positives") / F.col("n")).withColumn("roc_auc", F.when((F.col("positives") > 0) & (F.col("positives") < F.col("n")), F.col("wins") / F.col("positives") / (F.col("n") - F.col("positives")))).drop("wins")
    y = F.col("observed")
    p = F.greatest(F.least(F.col("predicted_probability"), F.lit(1 - EDGE)), F.lit(EDGE))
    losses = predictions.groupBy(*by).agg(F.avg((F.col("predicted_probability") - y) ** 2).alias("brier_score"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))
    return ranked.join(losses, by)


def top_fractions(predictions: DataFrame, by: list[str], fractions: list[float]) -> DataFrame:
    """What the highest share of each group captures; ties go to the first units by name.

    All cuts of a group are found together, by radix over its distinct scores (``ordered.at_ranks``): those above the one at a cut are counted whole, and
    of the rows of that score only those next to the cut are put in order.
    """
    score = F.col("predicted_probability").alias("score")
    points = predictions.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum("observed").cast("long").alias("hits"))
    points = written(points.withColumn("key", -order_key(F.col("score"))), "fractions-scores", keep=True)
    totals = points.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum("hits").alias("positives"))
    k = lambda x: F.greatest(F.lit(1), F.ceil(F.col("rows") * x)).cast("long")
    shares = F.array(*[F.lit(float(x)) for x in fractions])
    totals = totals.withColumn("ranks", F.transform(shares, k))
    cut = at_ranks(points, by, "key", [], "n", ["hits"], totals.select(*by, F.array_distinct("ranks").alias("ranks")))
    cut = cut.select(*by, "score", "rank", "n", "hits", "before_hits", (F.col("rank") - F.col("before_n")).alias("more"))
    cut = written(cut, "fractions-cuts", keep=True)
    whole = cut.where("more = n").select(*by, F.col("rank").alias("k"), (F.col("before_hits") + F.col("hits")).alias("captured"))
    split = cut.where("more < n")
    if not split.isEmpty():
        own = [*by, "score"]
        asked = split.groupBy(*own).agg(F.collect_list("more").alias("ranks"))
        tied = predictions.select(*by, score, F.col("su_id").cast("string").alias("unit"), F.col("observed").cast("long").alias("observed")).join(asked.select(*own), own)
        # names that share their beginning are told apart by what follows
        ends = tied.groupBy(*own).agg(F.min("unit").alias("a"), F.max("unit").alias("b"))
        alike = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.octet_length("a"), F.octet_length("b")))), lambda i: F.substring(F.encode("a", "UTF-8"), F.lit(1), i) == F.substring(F.encode("b", "UTF-8"), F.lit(1), i)))
        tied = tied.join(ends.select(*own, alike.alias("skip")), own).withColumn("key", text_key(F.col("unit"), F.col("skip"))).withColumn("n", F.lit(1))
        tied = written(tied.drop("skip"), "fractions-ties", keep=True)
        placed = at_ranks(tied, own, "key", ["unit"], "n", ["observed"], asked)
        found = placed.select(*own, F.col("rank").alias("more"), (F.col("before_observed") + F.col("observed")).alias("found"))
        whole = whole.unionByName(split.join(found, [*own, "more"]).select(*by, F.col("rank").alias("k"), (F.col("before_hits") + F.col("found")).alias("captured")))
    each = totals.select(*by, "positives", F.explode(F.arrays_zip(shares.alias("share"), F.col("ranks").alias("k"))).alias("x")).select(*by, "positives", F.col("x.share").alias("top_fraction"), F.col("x.k").alias("k"))
    out = each.join(whole, [*by, "k"]).select(*by, "top_fraction", F.col("k").alias("selected_rows"), F.col("captured").cast("long").alias("captured_positives"), F.col("positives").cast("long").alias("total_positives"))
    return _shares(out)


def _shares(out: DataFrame) -> DataFrame:
    return out.withColumns({"positive_capture_rate": F.when(F.col("total_positives") > 0, F.col("captured_positives") / F.col("total_positives")), "precision_at_fraction": F.col("captured_positives") / F.col("selected_rows")})


def annual_budget(predictions: DataFrame, fractions: list[float]) -> DataFrame:
    """Top fractions taken in each year, summed up by model."""
    out = top_fractions(predictions, ["model", "test_year"], fractions).groupBy("model", "top_fraction").agg(*[F.sum(c).cast("long").alias(c) for c in ("selected_rows", "captured_positives", "total_positives")])
    return _shares(out).withColumn("budget_definition", F.lit("top fraction selected independently within each held-out year, then counts pooled"))


def calibration_sums(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """n, the sum of predictions (a decimal, so alike in any order) and positives of each bin of a model and year.

    Bins are by exact quantiles, without repeated edges; right-closed, the lowest edge within the first.
    """
    by = ["model", "test_year"]
    edges = quantiles(predictions, by, "predicted_probability", [i / bins for i in range(bins + 1)]).select(*by, F.array_distinct("quantiles").alias("edges"))
    below = F.size(F.filter("edges", lambda e: e < F.col("predicted_probability")))
    binned = predictions.join(edges, by).withColumn("calibration_bin", F.greatest(F.lit(0), below - 1).cast("int"))
    p = F.round("predicted_probability", PLACES).cast(f"decimal({PLACES + 2},{PLACES})")
    return binned.groupBy(*by, "calibration_bin").agg(F.count("*").alias("n"), F.sum(p).alias("sum_predicted"), F.sum("observed").cast("long").alias("positives"))


def _means(sums: DataFrame, by: list[str]) -> DataFrame:
    return sums.select(*by, "calibration_bin", "n", (F.col("sum_predicted").cast("double") / F.col("n")).alias("mean_predicted"), (F.col("positives") / F.col("n")).alias("observed_rate"))


def calibration(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Mean prediction and observed rate of each bin of a model and year."""
    return _means(calibration_sums(predictions, bins), ["model", "test_year"])


def pooled_calibration(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """The bins of all years together, weighted by their rows."""
    sums = calibration_sums(predictions, bins).groupBy("model", "calibration_bin").agg(F.sum("n").cast("long").alias("n"), F.sum("sum_predicted").alias("sum_predicted"), F.sum("positives").cast("long").alias("positives"))
    return _means(sums, ["model"])


def increments(pooled: DataFrame, pairs: list[tuple[str, str]], names: list[str]) -> DataFrame:
    """Differences of pooled metrics, richer less simpler model."""
    spark = pooled.sparkSession
    long = pooled.unpivot(["model"], names, "metric", "value")
    wanted = F.broadcast(spark.createDataFrame(pairs, "richer_model string, simpler_model string"))
    richer = long.select(F.col("model").alias("richer_model"), "metric", F.col("value").alias("a"))
    simpler = long.select(F.col("model").alias("simpler_model"), "metric", F.col("value").alias("b"))
    joined = wanted.join(richer, "richer_model").join(simpler, ["simpler_model", "metric"])
    return joined.select("richer_model", "simpler_model", "metric", (F.col("a") - F.col("b")).alias("difference_richer_minus_simpler"))
