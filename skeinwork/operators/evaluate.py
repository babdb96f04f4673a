"""Evaluation of classifiers and rankings with aggregates and windows, folds by group, and learned baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables
from . import boosting, ranking


def _safe(n: Column, d: Column, otherwise=0.0) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(otherwise))


def confusion(df: DataFrame, target: str, predicted: Column, by: list[str] = [], copies: str | None = None) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1, false positive rate; divisions by zero give 0. copies: a column with the number of rows that a row
    stands for."""
    p, y = predicted.cast("int"), F.col(target).cast("int")
    number = F.count_if if copies is None else lambda c: F.coalesce(F.sum(F.when(c, F.col(copies))), F.lit(0))
    counts = df.groupBy(*by).agg(*[number((y == a) & (p == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))])
    return _measured(counts)


def _measured(counts: DataFrame) -> DataFrame:
    out = counts.withColumn("precision", _safe(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _safe(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("fpr", _safe(F.col("fp"), F.col("fp") + F.col("tn")))


def threshold_sweep(df: DataFrame, target: str, score: str, percents: list[int], by: list[str] = []) -> DataFrame:
    """Confusion at each threshold (in hundredths). Rows are counted by the number of thresholds that they pass, once; the counts,
    as few as there are thresholds, are added up for each threshold."""
    limits = sorted(percents)
    passed = F.size(F.filter(F.array(*[F.lit(p) for p in limits]), lambda p: F.col(score) >= p / 100))
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(target).cast("int").alias("__y"), passed.alias("__passed")).agg(F.count("*").alias("__n"))
    at = counts.select(*by, "__y", "__passed", "__n", F.posexplode(F.array(*[F.lit(p) for p in limits])).alias("__i", "percent"))
    hit = F.col("__passed") > F.col("__i")
    cell = lambda y, h: F.coalesce(F.sum(F.when((F.col("__y") == y) & (hit == h), F.col("__n"))), F.lit(0))
    return _measured(at.groupBy(*by, "percent").agg(cell(1, True).alias("tp"), cell(0, True).alias("fp"), cell(0, False).alias("tn"), cell(1, False).alias("fn")))


def best_f1(sweep: DataFrame, by: list[str]) -> DataFrame:
    return sweep.groupBy(*by).agg(F.max_by("percent", F.struct("f1", "precision", "recall", "percent")).alias("percent"), F.max("f1").alias("f1"))


def _by_score(df: DataFrame, target: str, score: str, copies: str | None = None) -> DataFrame:
    """(score, pos, neg): one row for each distinct score, so that windows run over scores, not over rows."""
    y, n = F.col(target).cast("int"), F.lit(1) if copies is None else F.col(copies)
    return df.groupBy(F.col(score).alias("score")).agg(F.sum(y * n).alias("pos"), F.sum((1 - y) * n).alias("neg"))


#: Parts into which distinct scores are cut for running sums.
PARTS = 64


def _running(s: DataFrame, names: list[str]) -> DataFrame:
    """s with the sums of the named columns over all lower scores, as `<name>_below`.

    Scores are cut into parts at approximate quantiles; windows run inside parts, and the sums of the parts below, at most
    PARTS + 1 rows, are added. So no task holds all scores."""
    bounds = s.select(F.percentile_approx("score", [i / PARTS for i in range(1, PARTS)], 1000)).first()[0] or []
    cuts = F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<double>")
    s = s.withColumn("__part", F.size(F.filter(cuts, lambda b: b <= F.col("score"))))
    sums = s.groupBy("__part").agg(*[F.sum(n).alias(n) for n in names])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in names])
    inside = Window.partitionBy("__part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    out = s.join(F.broadcast(starts), "__part")
    return out.withColumns({f"{n}_below": F.col(f"__{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in names}).drop("__part", *[f"__{n}" for n in names])


def roc_auc(df: DataFrame, target: str, score: str, copies: str | None = None) -> DataFrame:
    """Area under the ROC curve: the part of positive-negative pairs in the right order, ties counting half."""
    s = _running(_by_score(df, target, score, copies), ["neg"])
    won = s.agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return won.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).alias("roc_auc"))


def average_precision(df: DataFrame, target: str, score: str, copies: str | None = None) -> DataFrame:
    """Sum over distinct scores of precision times the gain in recall."""
    by = _by_score(df, target, score, copies)
    whole = by.agg(F.sum("pos").alias("all_pos"), F.sum(F.col("pos") + F.col("neg")).alias("everything"))
    c = _running(by.withColumn("both", F.col("pos") + F.col("neg")), ["pos", "both"]).join(F.broadcast(whole))
    tp, every = F.col("all_pos") - F.col("pos_below"), F.col("everything") - F.col("both_below")
    return c.agg((F.sum(F.col("pos") * tp / every) / F.max("all_pos")).alias("average_precision"))


def top_k_hit_rate(df: DataFrame, group: str, target: str, score: str, tie: str, ks: list[int]) -> DataFrame:
    """(k, groups, hit_rate): of groups with a positive, the part with one among its k best."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), tie)))
    first = ranked.groupBy(group).agg(F.min(F.when(F.col(target) == 1, F.col("rank"))).alias("first")).where("first is not null")
    at = first.select("first", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return at.groupBy("k").agg(F.count("*").alias("groups"), F.avg((F.col("first") <= F.col("k")).cast("double")).alias("hit_rate"))


def group_folds(df: DataFrame, group: str, target: str, k: int = 5) -> DataFrame:
    """df with a fold for each row: groups stay whole; within groups of like share of positives folds go round robin."""
    per = df.groupBy(group).agg(F.avg(F.col(target).cast("double")).alias("share"), F.count("*").alias("n"))
    stratum = F.floor(F.col("share") * 4)
    order = Window.partitionBy(stratum).orderBy(F.col("n").desc(), F.md5(F.col(group).cast("string")))
    folds = per.withColumn("fold", F.pmod(F.row_number().over(order) - 1, F.lit(k)).cast("int")).select(group, "fold")
    return df.join(folds, group)


#: Rounds of a signature's groups that are not dealt in bulk, so that there is something to even out with.
SPARE_ROUNDS = 8


def dealt_signatures(signatures: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """(negatives, positives, whole rounds, folds of the rest) for signatures (negatives, positives, groups): of groups that are
    alike most go round the folds in whole rounds, which leaves the folds even, and each of the rest to the fold where it leaves
    the classes spread most evenly.

    Signatures come in order of the difference between their classes, since a group of one class is the hardest to balance."""
    total = [max(1, sum(n * x[c] for *x, n in signatures)) for c in (0, 1)]
    folds, out = [[0, 0] for _ in range(k)], []

    def unevenness(at: int, group: tuple[int, int]) -> tuple[float, int, int]:
        shares = [[(f[c] + (group[c] if i == at else 0)) / total[c] for i, f in enumerate(folds)] for c in (0, 1)]
        return round(sum(sum((x - sum(s) / k) ** 2 for x in s) ** 0.5 for s in shares), 12), sum(folds[at]), at

    for neg, pos, n in sorted(signatures, key=lambda x: (-abs(x[0] - x[1]), -x[0] - x[1], x)):
        rounds, chosen = max(0, n // k - SPARE_ROUNDS), []
        for _ in range(n - rounds * k):
            best = min(range(k), key=lambda i: unevenness(i, (neg, pos)))
            folds[best][0] += neg
            folds[best][1] += pos
            chosen.append(best)
        out.append((neg, pos, rounds, chosen))
    return out


def balanced_folds(df: DataFrame, group: str, target: str, k: int = 5, copies: str | None = None) -> DataFrame:
    """df with a fold for each row: groups stay whole, and folds have near equal numbers of rows of both classes.

    Only the signatures of groups (how many rows of each class) and their numbers go to the driver; groups of one signature are
    interchangeable and are dealt by their place in an order by digest. Rows of null group are a group of their own. copies: a column with
    the number of rows that a row stands for."""
    positive = F.coalesce(F.col(target).cast("int"), F.lit(0)) == 1
    number = F.count_if if copies is None else lambda c: F.coalesce(F.sum(F.when(c, F.col(copies))), F.lit(0))
    per = df.groupBy(F.col(group).alias("__group")).agg(number(~positive).alias("__neg"), number(positive).alias("__pos"))
    per = tables.stored(per, f"{tables.scratch(df.sparkSession)}/groups")
    found = [tuple(r) for r in per.groupBy("__neg", "__pos").agg(F.count("*")).orderBy("__neg", "__pos").collect()]
    starts, at = {}, 0
    for neg, pos, n in found:
        starts[neg, pos], at = at, at + n
    rows = [(neg, pos, starts[neg, pos], rounds * k, rest) for neg, pos, rounds, rest in dealt_signatures(found, k)]
    plan = df.sparkSession.createDataFrame(rows, "__neg long, __pos long, __start long, __whole long, __rest array<int>")
    placed = ranking.row_numbers(per, [F.col("__neg"), F.col("__pos"), F.md5(F.coalesce(F.col("__group").cast("string"), F.lit(""))), F.col("__group")], "__place")
    nth = F.col("__place") - F.col("__start") - 1
    fold = F.when(nth < F.col("__whole"), F.pmod(nth, F.lit(k)).cast("int")).otherwise(F.get("__rest", (nth - F.col("__whole")).cast("int")))
    folds = placed.join(plan, ["__neg", "__pos"]).select("__group", fold.alias("fold"))
    return df.join(folds, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")


# Rounds and step of the boosted trees; rounds of the logistic model at most, which ends when it has converged.
BOOSTING_ROUNDS, BOOSTING_STEP = 150, 0.05
LOGISTIC_ROUNDS = 2000


def _standard(train: DataFrame, features: list[str], copies: str) -> list[Column]:
    """The features less their mean, in standard deviations of the rows that the rows of train stand for; one that is constant is 0."""
    n, x = F.col(copies), lambda c: F.col(c).cast("double")
    sums = train.agg(F.sum(n), *[f for c in features for f in (F.sum(x(c) * n) / F.sum(n), F.min(x(c)), F.max(x(c)))]).first()
    means, constant = sums[1::3], [a == b for a, b in zip(sums[2::3], sums[3::3], strict=True)]
    squares = train.agg(*[F.sum((x(c) - F.lit(m)) ** 2 * n) for c, m in zip(features, means, strict=True)]).first()
    return [F.lit(0.0) if same or not v else (x(c) - F.lit(m)) / F.lit((v / max(1, sums[0] - 1)) ** 0.5) for c, m, v, same in zip(features, means, squares, constant, strict=True)]


def out_of_fold(df: DataFrame, features: list[str], target: str, kind: str = "logistic", k: int = 5, copies: str | None = None) -> DataFrame:
    """df (with a fold column) with out-of-fold probabilities of a learned model; k fits, each a distributed job.

    `logistic` standardises the features and gives both classes the same weight, its penalty that of one row; any other kind
    is boosted trees of depth 3 over the rows as they are. copies: a column with the number of rows that a row stands for, which only
    `logistic` heeds."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    if copies and kind != "logistic":
        raise ValueError("rows that stand for several are for the logistic model")
    out, number = None, F.col(copies) if copies else F.lit(1)
    for fold in range(k):
        train, test = df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)
        share, n = train.agg(F.sum(F.col(target).cast("double") * number) / F.sum(number), F.sum(number)).first()
        if share is None:
            continue
        weigh = F.when(F.col(target) == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)) * number
        names, learner = features, LogisticRegression(featuresCol="__x", labelCol=target, weightCol="__w", maxIter=LOGISTIC_ROUNDS, regParam=1 / n)
        if copies:
            # the scaler of the library has no weights
            names = [f"__{c}" for c in features]
            scaled = dict(zip(names, _standard(train, features, copies), strict=True))
            train, test = train.withColumns(scaled), test.withColumns(scaled)
        stages = [VectorAssembler(inputCols=names, outputCol="__x" if copies else "__raw", handleInvalid="keep")]
        if copies:
            stages += [learner]
        elif kind == "logistic":
            stages += [StandardScaler(inputCol="__raw", outputCol="__x", withMean=True), learner]
        else:
            stages += [GBTClassifier(featuresCol="__raw", labelCol=target, maxIter=BOOSTING_ROUNDS, maxDepth=3, stepSize=BOOSTING_STEP, seed=7)]
        model = Pipeline(stages=stages).fit(train.withColumn("__w", weigh))
        got = model.transform(test).withColumn("oof_probability", vector_to_array("probability")[1]).select(*df.columns, "oof_probability")
        out = got if out is None else out.unionByName(got)
    return out


# The two rules that learned models are compared with.
RULE_SHARED, RULE_JACCARD = 3, 0.20


def rule_models(pairs: DataFrame, target: str, exact: str = "exact_key", shared: str = "shared_count", jaccard: str = "jaccard", by: list[str] = []) -> DataFrame:
    """Confusion and its measures of the rules `upc_only` and `token_and_similarity` (enough shared tokens and similarity, or the same code)."""
    same = F.coalesce(F.col(exact).cast("int"), F.lit(0)) == 1
    alike = F.coalesce((F.col(shared) >= RULE_SHARED) & (F.col(jaccard) >= RULE_JACCARD), F.lit(False))
    cells = F.array(F.struct(F.lit("upc_only").alias("rule"), same.cast("int").alias("hit")), F.struct(F.lit("token_and_similarity").alias("rule"), (same | alike).cast("int").alias("hit")))
    at = pairs.select(*by, target, F.explode(cells).alias("c")).select(*by, target, "c.rule", "c.hit")
    return confusion(at, target, F.col("hit"), ["rule", *by])


def model_comparison(rows: DataFrame, target: str, features: list[str], lexical: list[str], k: int = 5, rounds: int | None = None, copies: str | None = None) -> DataFrame:
    """One row for each of three models, with the measures of their out-of-fold probabilities: logistic over all features, logistic
    over the lexical ones, and boosted trees over all. rows have a fold; rows of null target take no part.

    Rows alike in fold, target and features are learnt from and judged as one with their number, so that the rounds of learning look at
    different rows only. copies: a column with the number of rows that a row stands for."""
    path, every = tables.scratch(rows.sparkSession), list(dict.fromkeys([*features, *lexical]))
    number = F.count("*") if copies is None else F.sum(copies)
    known = tables.stored(rows.where(F.col(target).isNotNull()).groupBy("fold", target, *every).agg(number.alias("__copies")), f"{path}/alike")
    learned = {
        "logistic_all": out_of_fold(known, features, target, "logistic", k, "__copies"), "logistic_lexical": out_of_fold(known, lexical, target, "logistic", k, "__copies"),
        "hist_gradient_boosting": boosting.out_of_fold(known, features, target, k, rounds=rounds or boosting.ROUNDS, copies="__copies"),
    }
    out = None
    for name, df in learned.items():
        p = tables.stored(df.select(target, "oof_probability", "__copies"), f"{path}/{name}")
        one = confusion(p, target, F.col("oof_probability") >= 0.5, copies="__copies").join(roc_auc(p, target, "oof_probability", "__copies")).join(average_precision(p, target, "oof_probability", "__copies")).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
