import random

from siftgraph.operators import graph as gr
from siftgraph.operators import models as mo
from siftgraph.operators import quality as qu

CEILINGS = {"calls": 6, "input_tokens": 900, "output_tokens": 500, "cloud_tokens": 700, "cloud_cost": 60}


def plain(rows):
    used, out = {}, {}
    for run, at, i, o, cloud, cost in sorted(rows):
        u = used.setdefault(run, [0] * 5)
        asks = [1, i, o, i + o if cloud else 0, cost if cloud else 0]
        tests = [(n, a) for n, a in zip(mo.CEILINGS, range(5)) if cloud or a < 3]
        out[run, at] = next((n for n, k in tests if u[k] + asks[k] > CEILINGS[n]), None)
        if out[run, at] is None:
            used[run] = [x + y for x, y in zip(u, asks)]
    return out


def test_reservations_under_five_ceilings(spark):
    r = random.Random(3)
    rows = [(k % 7, k, r.randint(0, 400), r.randint(0, 200), r.random() < 0.6, r.randint(0, 40)) for k in range(300)]
    df = spark.createDataFrame(rows, "run int, at int, input_tokens long, output_tokens long, cloud boolean, cost long")
    got = {(x["run"], x["at"]): x["refusal"] for x in mo.reserved(df, "run", ["at"], CEILINGS).collect()}
    assert got == plain(rows) and set(got.values()) == {None, *mo.CEILINGS}
    assert mo.reserved(df.limit(0), "run", ["at"], CEILINGS).count() == 0


def test_clusters_without_lists(spark):
    rows = [("hot", "org", f"d{k:03d}") for k in range(200)] * 2 + [("pair", "org", "a"), ("pair", "org", "b"), ("pair", "email", "a"), ("one", "org", "a"), ("one", "org", "a")]
    pairs = spark.createDataFrame(rows, "identifier string, id_type string, domain string")
    sizes = gr.cluster_sizes(pairs, 2, 3)
    assert {tuple(x[:3]): x["preview"] for x in sizes.collect()} == {("hot", "org", 200): ["d000", "d001", "d002"], ("pair", "org", 2): ["a", "b"]}
    assert gr.cluster_members(pairs, sizes).count() == 202


def test_sets_agree_with_counts(spark):
    r = random.Random(5)
    pick = lambda p: [(c, f"d{k}") for c in range(3) for k in range(60) if r.random() < p]
    a, b = pick(0.5), pick(0.5)
    labels = [(c, d, r.random() < 0.6) for c, d in pick(0.7)]
    frame = lambda rows: spark.createDataFrame(rows, "case_id int, domain string")
    known = spark.createDataFrame(labels, "case_id int, domain string, positive boolean")
    base, cand = frame(a), frame(b + b[:5])
    sets = {(x["case_id"], x["outcome"]): x["domains"] for x in qu.listed(qu.outcomes(base, known, ["case_id"]), ["case_id"], "outcome").collect()}
    for row in qu.evaluated(base, known, ["case_id"]).collect():
        for name, count in (("true_positive", "tp"), ("known_false_positive", "fp"), ("false_negative", "fn"), ("unlabeled_prediction", "unlabeled")):
            assert len(sets.get((row["case_id"], name), [])) == row[count]
    positive = {(c, d) for c, d, p in labels if p}
    assert sets[0, "true_positive"] == sorted(d for c, d in set(a) & positive if c == 0)
    changed = {(x["case_id"], x["domain"], x["change"]) for x in qu.changes(base, cand, known, ["case_id"]).collect()}
    assert {x[:2] for x in changed if x[2] == "new_true_positive"} == (set(b) - set(a)) & positive
    assert {x[:2] for x in changed if x[2] == "removed_prediction"} == set(a) - set(b)
    compared = qu.compared(base, cand, known, ["case_id"])
    for row in compared.collect():
        for name, count in (("new_true_positive", "new_tp"), ("lost_true_positive", "lost_tp"), ("new_known_false_positive", "new_fp"), ("resolved_known_false_positive", "resolved_fp"), ("added_unlabeled", "added_unlabeled"), ("removed_prediction", "removed")):
            assert sum(x[0] == row["case_id"] and x[2] == name for x in changed) == row[count]
    reasons = {x["case_id"]: x["reasons"] for x in qu.gate_reasons(compared).collect()}
    assert all(("candidate-only predictions remain unlabeled" in reasons[x["case_id"]]) == (x["added_unlabeled"] > 0) and bool(reasons[x["case_id"]]) != x["eligible"] for x in compared.collect())
    roots = spark.createDataFrame([(c, f"root{c}.com") for c in range(3)], "case_id int, root_domain string")
    assert ("added_unlabeled" in {x["change"] for x in qu.scoped(qu.changes(base, cand, known, ["case_id"]), roots, ["case_id"]).collect()}) == any(x[2] == "added_unlabeled" for x in changed)
