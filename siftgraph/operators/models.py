"""Saved model outputs as data: strict validation, routing, cost, context bounds, usage."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Dollars per million input and output tokens.
PRICES = {"gpt-5-mini": ("0.25", "2.00"), "gpt-5-mini-2025-08-07": ("0.25", "2.00"), "gpt-5.6-luna": ("0.20", "1.20")}
_OUTPUT = "struct<abstain:boolean,abstention_reason:string,pivots:array<struct<id_type:string,value:string,score:double,reason:string>>>"


def validated(outputs: DataFrame) -> DataFrame:
    """``outputs`` with ``disposition`` (accepted, abstained, invalid) and ``pivots`` of accepted ones. Other keys, types or ranges than the contract's make the whole output invalid."""
    v = F.try_parse_json("content")
    o = F.from_json("content", _OUTPUT)
    raw = lambda path: F.get_json_object("content", path)
    keys = F.array_sort(F.json_object_keys("content"))
    items = F.from_json(raw("$.pivots"), "array<string>")
    fine_keys = F.forall(items, lambda s: F.coalesce(F.array_sort(F.json_object_keys(s)) == F.array(*map(F.lit, ("id_type", "reason", "score", "value"))), F.lit(False)))
    fine = F.forall(o["pivots"], lambda p: F.coalesce(p["id_type"].isin("email", "org", "name", "ns", "phone") & F.length(p["value"]).between(1, 500) & p["score"].between(0.0, 1.0) & F.length(p["reason"]).between(1, 1000), F.lit(False)))
    typed = F.schema_of_variant(v).contains("abstain: BOOLEAN")
    reason = F.coalesce(F.trim(o["abstention_reason"]), F.lit(""))
    n = F.size(o["pivots"])
    whole = typed & (keys == F.array(*map(F.lit, ("abstain", "abstention_reason", "pivots")))) & fine_keys & fine & (n <= 20) & (F.length(F.coalesce(o["abstention_reason"], F.lit(""))) <= 1000)
    agrees = F.when(o["abstain"], (n == 0) & (reason != "")).otherwise(n > 0)
    state = F.when(~F.coalesce(whole & agrees, F.lit(False)), "invalid").when(o["abstain"], "abstained").otherwise("accepted")
    return outputs.withColumn("disposition", state).withColumn("pivots", F.when(F.col("disposition") == "accepted", o["pivots"]))


def routed(fast: DataFrame, primary: DataFrame, accept: float = 0.75) -> DataFrame:
    """(domain, pivots, route): the fast model's pivots where one is strong enough, else the primary model's."""
    strong = F.exists("pivots", lambda p: p["score"] >= accept)
    good = fast.where((F.col("disposition") == "accepted") & strong).select("domain", "pivots", F.lit("fast").alias("route"))
    rest = primary.where("disposition = 'accepted'").select("domain", "pivots", F.lit("primary").alias("route")).join(good.select("domain"), "domain", "left_anti")
    return good.unionByName(rest)


def micro_dollars(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Price of a call rounded up to millionths of a dollar; null for a model without a price. Tokens times dollars per million are micro-dollars."""
    rate = lambda k: F.try_element_at(F.create_map(*[x for m, p in PRICES.items() for x in (F.lit(m), F.lit(Decimal(p[k])).cast("decimal(18,6)"))]), model)
    whole = lambda c: F.greatest(F.lit(0), c).cast("decimal(18,0)")
    return F.ceil(whole(tokens_in) * rate(0) + whole(tokens_out) * rate(1)).cast("long")


#: Days after which prices are too old to be relied on.
PRICE_DAYS = 90


def priced(calls: DataFrame, reviewed: Column, today: Column) -> DataFrame:
    """``calls`` (model, tokens_in, tokens_out) with ``cost`` in micro-dollars and ``refusal``: a model without a price, or prices reviewed too long ago, refuse the call."""
    cost = micro_dollars(F.col("model"), F.col("tokens_in"), F.col("tokens_out"))
    refusal = F.when(F.datediff(today, reviewed) > PRICE_DAYS, "stale prices").when(cost.isNull(), "unknown model")
    return calls.withColumn("refusal", refusal).withColumn("cost", F.when(F.col("refusal").isNull(), cost))


def token_bound(text: Column) -> Column:
    """No tokenizer makes more tokens than bytes."""
    return F.octet_length(text).cast("long")


def trimmed(context: Column, most: int = 22_000) -> Column:
    """A JSON context whose host list is cut from its end, a tenth (20 at least) at a time, until its ASCII form fits."""

    @F.pandas_udf(StringType())
    def cut(s: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            c = json.loads(text)
            hosts = c.get("subdomains")
            if isinstance(hosts, list) and hosts and len(json.dumps(c)) > most:
                n, step = len(hosts), max(20, len(hosts) // 10)
                while c["subdomains"] and len(json.dumps(c)) > most:
                    c["subdomains"] = c["subdomains"][:-step]
                c["subdomains_truncated"] = n - len(c["subdomains"])
            return json.dumps(c)

        return s.map(one)

    return cut(context)


def usage(calls: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Calls and sums by null-keeping keys; a sum over nulls only is null."""
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in sums])


def budget_use(reservations: DataFrame, sums: list[str]) -> DataFrame:
    return reservations.agg(F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])


#: What a request is refused by, in the order of the tests; the last two hold for models that run elsewhere.
CEILINGS = ("calls", "input_tokens", "output_tokens", "cloud_tokens", "cloud_cost")


def reserved(requests: DataFrame, key: str, order: list[str], ceilings: dict[str, int]) -> DataFrame:
    """``requests`` (key, order, input_tokens, output_tokens, cloud, cost) in order, each with ``refusal``: the first ceiling that it would exceed, null where it is reserved. A refused one uses nothing.

    All ceilings hold at once, so what is reserved depends on all before it: a key's rows stream through one task,
    of which five sums are held.
    """
    from .usage import in_order

    most = [ceilings[c] for c in CEILINGS]
    columns = [key, *order, "input_tokens", "output_tokens", "cloud", "cost"]
    rows = requests.select(*columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used = None, [0] * len(most)
        for p in frames:
            refusals = []
            for k, given, made, cloud, cost in zip(*[p[c].tolist() for c in (key, "input_tokens", "output_tokens", "cloud", "cost")]):
                if k != now:
                    now, used = k, [0] * len(most)
                asks = [1, given, made, *((given + made, cost) if cloud else (0, 0))]
                over = next((c for c, u, a, m in zip(CEILINGS, used, asks, most) if u + a > m and (cloud or not c.startswith("cloud"))), None)
                if over is None:
                    used = [u + a for u, a in zip(used, asks)]
                refusals.append(over)
            yield p.assign(refusal=pd.Series(refusals, index=p.index, dtype=object))

    return in_order(rows, key, order).mapInPandas(run, rows.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",refusal:string")
