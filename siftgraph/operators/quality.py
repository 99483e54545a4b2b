"""Graphs against labels: evaluation, matched comparison, pooled benchmark, pivot benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LABELS, MIN_POSITIVE = 20, 10


def ratios(out: DataFrame, tp: str = "tp", fp: str = "fp", positives: str = "positives", prefix: str = "") -> DataFrame:
    p, r = F.try_divide(tp, F.col(tp) + F.col(fp)), F.try_divide(tp, positives)
    return out.withColumn(f"{prefix}precision", p).withColumn(f"{prefix}recall", r).withColumn(f"{prefix}f1", F.try_divide(2 * p * r, p + r))


def evaluated(predicted: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and ratios of each case (``keys``) from distinct (keys, domain) predictions and (keys, domain, positive) labels. Undefined ratios are null."""
    x = predicted.select(*keys, "domain", F.lit(True).alias("p")).distinct().join(labels, [*keys, "domain"], "full")
    hit = F.coalesce("p", F.lit(False))
    out = x.groupBy(*keys).agg(
        F.count_if(hit & F.col("positive")).alias("tp"), F.count_if(hit & ~F.col("positive")).alias("fp"), F.count_if(~hit & F.col("positive")).alias("fn"),
        F.count_if(hit & F.col("positive").isNull()).alias("unlabeled"), F.count_if("positive").alias("positives"), F.count_if(~F.col("positive")).alias("negatives"), F.count_if(hit).alias("predicted"),
    )
    return ratios(out)


def compared(baseline: DataFrame, candidate: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Per case: what the candidate gained and lost, the verdict, and whether planners may learn from it."""
    side = lambda df, n: df.select(*keys, "domain", F.lit(True).alias(n)).distinct()
    x = side(baseline, "b").join(side(candidate, "c"), [*keys, "domain"], "full").join(labels, [*keys, "domain"], "full")
    b, c, good = F.coalesce("b", F.lit(False)), F.coalesce("c", F.lit(False)), F.col("positive")
    n = lambda cond, name: F.count_if(cond).alias(name)
    out = x.groupBy(*keys).agg(
        n(good & b, "baseline_tp"), n(good & c, "candidate_tp"), n(~good & b, "baseline_fp"), n(~good & c, "candidate_fp"), n(good, "positives"), n(good.isNotNull(), "labels"), n(good & c & ~b, "new_tp"), n(good & b & ~c, "lost_tp"),
        n(~good & c & ~b, "new_fp"), n(~good & b & ~c, "resolved_fp"), n(c & ~b & good.isNull(), "added_unlabeled"), n(b & ~c, "removed"),
    )
    return gated(out.withColumn("verdict", verdict("improved_on_labeled_case", (F.col("lost_tp") > 0) | (F.col("new_fp") > 0), (F.col("added_unlabeled") > 0) | (F.col("removed") > 0))))


def verdict(better: str, worse: Column, moved: Column) -> Column:
    return F.when(worse, "degraded").when((F.col("new_tp") > 0) | (F.col("resolved_fp") > 0), better).when(moved, "inconclusive_unlabeled_change").otherwise("no_labeled_change")


def gated(out: DataFrame) -> DataFrame:
    return out.withColumn("eligible", (F.col("labels") >= MIN_LABELS) & (F.col("positives") >= MIN_POSITIVE) & (F.col("added_unlabeled") == 0))


def pooled(comparisons: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row over all cases: sums first, then ratios."""
    names = ("baseline_tp", "candidate_tp", "baseline_fp", "candidate_fp", "positives", "labels", "new_tp", "lost_tp", "new_fp", "resolved_fp", "added_unlabeled")
    sums = [F.sum(c).alias(c) for c in names]
    out = comparisons.groupBy(*(by or [])).agg(F.count("*").alias("cases"), F.count_if(F.col("verdict") == "degraded").alias("degraded_cases"), *sums)
    out = ratios(ratios(out, "baseline_tp", "baseline_fp", "positives", "baseline_"), "candidate_tp", "candidate_fp", "positives", "candidate_")
    worse = (F.col("degraded_cases") > 0) | (F.col("new_fp") > 0) | (F.col("lost_tp") > 0)
    out = gated(out.withColumn("verdict", verdict("improved_on_labeled_corpus", worse, F.col("added_unlabeled") > 0)))
    return out.withColumn("eligible", F.col("eligible") & (F.col("degraded_cases") == 0))


def outcomes(predicted: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """The sets behind ``evaluated`` as rows: (keys, domain, outcome), each predicted or labelled positive domain of a case in one of four sets."""
    x = predicted.select(*keys, "domain", F.lit(True).alias("p")).distinct().join(labels, [*keys, "domain"], "full")
    hit, good = F.coalesce("p", F.lit(False)), F.col("positive")
    outcome = F.when(hit & good, "true_positive").when(hit & ~good, "known_false_positive").when(hit, "unlabeled_prediction").when(good, "false_negative")
    return x.select(*keys, "domain", outcome.alias("outcome")).where("outcome is not null")


def changes(baseline: DataFrame, candidate: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """The sets behind ``compared`` as rows: (keys, domain, change); a domain that came or went is in the set of all such and in that of its label."""
    side = lambda df, n: df.select(*keys, "domain", F.lit(True).alias(n)).distinct()
    x = side(baseline, "b").join(side(candidate, "c"), [*keys, "domain"], "full").join(labels, [*keys, "domain"], "left")
    came, went, good = F.col("b").isNull(), F.col("c").isNull(), F.col("positive")
    sets = [
        (came, "added_prediction"), (went, "removed_prediction"), (came & good, "new_true_positive"), (went & good, "lost_true_positive"),
        (came & ~good, "new_known_false_positive"), (went & ~good, "resolved_known_false_positive"), (came & good.isNull(), "added_unlabeled"),
    ]
    of = F.array_compact(F.array(*[F.when(cond, name) for cond, name in sets]))
    return x.where(came | went).select(*keys, "domain", F.explode(of).alias("change"))


#: Changes that a pooled benchmark lists by root and domain.
SCOPED = ("new_true_positive", "lost_true_positive", "new_known_false_positive", "resolved_known_false_positive", "added_unlabeled")


def scoped(changed: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """(change, name) over all cases: ``root/domain``, as a case's domains are told apart from another's. ``roots``: keys, root_domain."""
    return changed.where(F.col("change").isin(*SCOPED)).join(roots, keys).select("change", F.concat_ws("/", "root_domain", "domain").alias("name")).distinct()


def listed(members: DataFrame, keys: list[str], of: str) -> DataFrame:
    """Members as sorted lists, a row for each case and set: for exports, where one case's domains fit a row."""
    return members.groupBy(*keys, of).agg(F.array_sort(F.collect_list("domain")).alias("domains"))


def gate_reasons(comparisons: DataFrame, missing: Column | None = None, scope: str = "case") -> DataFrame:
    """``comparisons`` with ``reasons``: why planners may not learn from each row, empty where they may. ``missing``: names of policy fields that a side lacks; pooled rows (``scope`` ``corpus``) may hold ``degraded``, the names of degraded cases."""
    joined = lambda head, names: F.when(F.size(names) > 0, F.concat(F.lit(head), F.array_join(F.array_sort(names), ", ")))
    few = lambda n, least, what: F.when(F.col(n) < least, F.concat(F.lit(f"requires at least {least} {what} domains; {scope} has "), F.col(n).cast("string")))
    told = [few("labels", MIN_LABELS, "labeled"), few("positives", MIN_POSITIVE, "positive"), F.when(F.col("added_unlabeled") > 0, "candidate-only predictions remain unlabeled")]
    if missing is not None:
        told.append(joined("matched policy fields missing: ", missing))
    if "degraded" in comparisons.columns:
        told.append(joined("case-level degradation: ", F.col("degraded")))
    return comparisons.withColumn("reasons", F.array_compact(F.array(*told)))


def pooled_costs(costs_: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Usage deltas of all cases and what each net new true positive cost; null where none was gained on balance."""
    sums = [F.sum(f"{c}_delta").alias(f"{c}_delta") for c in USAGE]
    out = costs_.groupBy(*(by or [])).agg(F.count("*").alias("cases"), (F.sum("new_tp") - F.sum("lost_tp")).alias("net_new_tp"), *sums)
    for c in ("calls", "units"):
        out = out.withColumn(f"{c}_per_net_new_tp", F.when(F.col("net_new_tp") > 0, F.col(f"{c}_delta").cast("double") / F.col("net_new_tp")))
    return out


def pivot_scores(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """Per case: groups of accepted values hit (tp) and missed (fn), predictions outside all groups (fp). ``expected`` has a row for each accepted value with its ``group``."""
    keys = ["case_id", "id_type", "value"]
    p = predicted.select(*keys).distinct()
    hits = p.join(expected, keys).groupBy("case_id").agg(F.count_distinct("group").alias("tp"))
    groups = expected.groupBy("case_id").agg(F.count_distinct("group").alias("groups"))
    wrong = p.join(expected.select(*keys).distinct(), keys, "left_anti").groupBy("case_id").agg(F.count("*").alias("fp"))
    out = groups.join(hits, "case_id", "full").join(wrong, "case_id", "full").select("case_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("groups", "tp", "fp")])
    return ratios(out.withColumn("fn", F.col("groups") - F.col("tp")), "tp", "fp", "groups")


def predicted_domains(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run_id, domain): the owners' domains of a run's domain nodes, without its root's; nodes that aren't domain names count for nothing."""
    from .validation import owner

    root = runs.select("run_id", owner(F.col("root_domain")).alias("__root"))
    own = nodes.where("node_type = 'domain'").select("run_id", owner(F.col("value_norm")).alias("domain")).where("domain is not null")
    return own.join(root, "run_id").where("domain <> __root").select("run_id", "domain").distinct()


USAGE = ("calls", "upstream_requests", "latency_ms", "units")


def usage_totals(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the four measures of each graph; 0 where a row lacks one."""
    return usage.groupBy(*keys).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in USAGE])


def costs(comparisons: DataFrame, baseline: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """``comparisons`` with the usage deltas of candidate and baseline, and what each new true positive cost; null where nothing was gained or less was used."""
    side = lambda df, p: usage_totals(df, keys).select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in USAGE])
    out = comparisons.join(side(baseline, "b"), keys, "left").join(side(candidate, "c"), keys, "left")
    zero = F.lit(0)
    for c in USAGE:
        out = out.withColumn(f"{c}_delta", F.coalesce(f"c_{c}", zero) - F.coalesce(f"b_{c}", zero))
    for c in ("calls", "units"):
        d = F.col(f"{c}_delta")
        out = out.withColumn(f"{c}_per_new_tp", F.when((F.col("new_tp") > 0) & (d >= 0), d.cast("double") / F.col("new_tp")))
    return out.drop(*[f"{p}_{c}" for p in "bc" for c in USAGE])


MIN_CASES, MIN_POSITIVE_CASES, MIN_ABSTENTIONS, MIN_LIFT = 20, 10, 5, 0.05


def accepted_pivots(candidates: DataFrame, least: float = 0.4) -> DataFrame:
    """(case_id, id_type, value): valid candidates of at least ``least``, in normal form, each once."""
    from ..functions.domains import normalized_identifier, valid_pivot

    good = candidates.where((F.col("score") >= least) & valid_pivot(F.col("id_type"), F.col("value"), F.col("score")))
    return good.select("case_id", "id_type", normalized_identifier(F.col("id_type"), F.col("value")).alias("value")).where("value is not null").distinct()


def pivot_benchmark(cases: DataFrame, expected: DataFrame, baseline: DataFrame, model: DataFrame, calls: DataFrame, cloud: bool = False) -> DataFrame:
    """One row for saved model outputs: what the rules find (``baseline``), what they and the model find together (``assisted``), the lift, abstention, and whether the model may be recommended.

    cases (case_id, corpus_class, expected_abstain), expected (case_id, id_type, value, group: alternatives share
    one), baseline and model (case_id, id_type, value, score), calls (case_id, disposition, tokens, cost).
    """
    keys = ["case_id", "id_type", "value"]
    from ..functions.domains import normalized_identifier

    groups = expected.select("case_id", "id_type", normalized_identifier(F.col("id_type"), F.col("value")).alias("value"), "group").distinct()
    rules = accepted_pivots(baseline)
    both = rules.union(accepted_pivots(model)).distinct()
    total = groups.select("case_id", "group").distinct().agg(F.count("*").alias("groups"))

    def score(found: DataFrame, p: str) -> DataFrame:
        hit = found.join(groups, keys).select("case_id", "group").distinct().agg(F.count("*").alias(f"{p}tp"))
        wrong = found.join(groups.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias(f"{p}fp"))
        return hit.withColumn("__k", F.lit(0)).join(wrong.withColumn("__k", F.lit(0)), "__k")

    out = total.withColumn("__k", F.lit(0))  # one row each from here
    for found, p in ((rules, "baseline_"), (both, "assisted_")):
        out = ratios(out.join(score(found, p), "__k"), f"{p}tp", f"{p}fp", "groups", p)
    state = F.coalesce("disposition", F.lit("missing"))
    c = cases.join(calls, "case_id", "left").withColumn("disposition", state)
    right = F.when(F.col("expected_abstain"), F.col("disposition") == "abstained").otherwise(F.col("disposition") == "accepted")
    all_known = lambda col: F.when(F.count_if(F.col(col).isNull()) == 0, F.sum(col))
    per = c.agg(
        F.count("*").alias("cases"),
        F.count_if(~F.col("expected_abstain")).alias("positive_cases"),
        F.count_if("expected_abstain").alias("abstention_cases"),
        F.count_if(F.col("corpus_class") != "held_out").alias("synthetic_cases"),
        F.try_divide(F.count_if(F.col("expected_abstain") & right), F.count_if("expected_abstain")).alias("abstention_accuracy"),
        F.count_if(F.col("disposition").isin("invalid", "error", "missing")).alias("invalid_or_error_count"),
        all_known("tokens").alias("tokens"),
        all_known("cost").alias("cost"),
        F.count_if(F.col("cost").isNull()).alias("unpriced"),
    )
    out = out.join(per.withColumn("__k", F.lit(0)), "__k").drop("__k")
    out = out.withColumn("recall_lift", F.col("assisted_recall") - F.col("baseline_recall")).withColumn("precision_delta", F.col("assisted_precision") - F.col("baseline_precision"))
    rule = lambda bad, text: F.when(F.coalesce(bad, F.lit(True)), text)
    reasons = [
        rule(F.col("synthetic_cases") > 0, "corpus contains synthetic cases"),
        rule(F.col("cases") < MIN_CASES, f"requires at least {MIN_CASES} cases"),
        rule(F.col("positive_cases") < MIN_POSITIVE_CASES, f"requires at least {MIN_POSITIVE_CASES} positive cases"),
        rule(F.col("abstention_cases") < MIN_ABSTENTIONS, f"requires at least {MIN_ABSTENTIONS} abstention cases"),
        rule(F.col("invalid_or_error_count") > 0, "all model outputs must be valid and completed"),
        rule(F.col("precision_delta") < 0, "assisted precision must not regress from baseline"),
        rule(F.col("recall_lift") < MIN_LIFT, f"recall lift must be at least {MIN_LIFT:.2f}"),
        rule((F.col("unpriced") > 0) & F.lit(cloud), "cloud provider-reported cost must be known for every case"),
    ]
    out = out.withColumn("reasons", F.array_compact(F.array(*reasons))).drop("unpriced")
    return out.withColumn("eligible", F.size("reasons") == 0)
