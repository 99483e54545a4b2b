"""Graph exports and what may leave: JSON in and out, export policy, egress bounds, domain lists, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH = "run struct<id:string,root_domain:string,status:string>, nodes array<struct<id:string,node_type:string,value_norm:string,metadata_json:string>>, edges array<struct<id:string,from_node_id:string,to_node_id:string,relation_type:string,depth:int,source:string,confidence:double>>"


def graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graph exports at a path, each with its run."""
    g = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    nodes = g.select(F.col("run.id").alias("run_id"), "run.root_domain", F.explode("nodes").alias("n")).select("run_id", "root_domain", F.col("n.id").alias("node_id"), "n.node_type", "n.value_norm", F.get_json_object("n.metadata_json", "$.identifier_type").alias("identifier_type"))
    edges = g.select(F.col("run.id").alias("run_id"), F.explode("edges").alias("e")).select("run_id", "e.*")
    return nodes, edges


# What of a piece of evidence may leave where its values may not.
DERIVED = ("observation_id", "polarity", "weight", "reason", "created_at", "source", "predicate", "observed_at", "source_family", "data_policy_version", "export_scope", "raw_retention")


def exportable(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations that may be exported, counts of those kept back). Only scope ``normalized``, the default, leaves; ``derived_only`` ones are restricted, all others denied."""
    scope = F.coalesce(F.nullif("export_scope", F.lit("")), F.lit("normalized"))
    denied = ~scope.isin("normalized", "derived_only")
    counts = observations.agg(F.count_if(denied).alias("denied"), F.count_if(scope == "derived_only").alias("restricted"))
    return observations.where(scope == "normalized"), counts


def exportable_evidence(evidence: DataFrame, keys: tuple[str, ...] = ("claim_id",)) -> DataFrame:
    """Evidence rows that may be exported: of ``derived_only`` ones the derived columns alone, denied ones not at all."""
    scope = F.coalesce(F.nullif("export_scope", F.lit("")), F.lit("normalized"))
    kept = evidence.where(scope.isin("normalized", "derived_only"))
    bare = [c for c in kept.columns if c not in (*DERIVED, *keys)]
    return kept.select(*[F.when(scope == "normalized", F.col(c)).alias(c) if c in bare else F.col(c) for c in kept.columns])


def egress_text(value: Column, most: int = 1000) -> Column:
    """A value as it may go to a model: without control characters, trimmed and bounded; null where nothing is left."""
    v = F.regexp_replace(F.regexp_replace(value, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"(?U)^\s+|\s+$", "")
    return F.nullif(F.substring(v, 1, most), F.lit(""))


def egress_list(values: Column, most: int = 250) -> Column:
    texts = F.transform(F.slice(F.coalesce(values, F.array().cast("array<string>")), 1, most), lambda x: egress_text(x))
    return F.filter(texts, lambda x: x.isNotNull())


# The fields of the evidence that a model may see; people's own only if the model runs here.
_TEXTS = ("domain", "registrant_org", "creation_date", "expiration_date", "title", "description", "copyright_org", "redirect_domain")
_LISTS = ("nameservers", "aliases", "tracker_ids", "legal_entities", "subdomains")
_PERSONAL = ("registrant_name", "registrant_email", "registrant_phone")


def model_evidence(records: DataFrame, cloud: bool) -> DataFrame:
    """Each record's allowed fields in their bounds; a model that runs elsewhere gets no personal ones."""
    texts = _TEXTS if cloud else (*_TEXTS, *_PERSONAL)
    return records.select(*[egress_text(F.col(c)).alias(c) for c in texts], *[egress_list(F.col(c)).alias(c) for c in _LISTS])


def graph_json(nodes: DataFrame, edges: DataFrame, most: int = 10_000) -> DataFrame:
    """One JSON row for each run of at most ``most`` nodes and ``most`` edges, which bounds the arrays; a larger run raises, since a cut graph is no export."""

    def gathered(rows: DataFrame, order: tuple[str, ...], name: str) -> DataFrame:
        size = rows.groupBy("run_id").agg(F.count("*").alias("__n"))
        small = F.when(F.col("__n") <= most, F.col("run_id")).otherwise(F.raise_error(F.lit(f"more than {most} {name}")))
        fits = rows.join(size, "run_id").withColumn("run_id", small)
        return fits.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*order))).alias(name))

    n = gathered(nodes, ("node_type", "value_norm", "node_id"), "nodes")
    e = gathered(edges, ("from_node_id", "relation_type", "to_node_id"), "edges")
    return n.join(e, "run_id", "full").select("run_id", F.to_json(F.struct("run_id", "nodes", "edges")).alias("json"))


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """An integrity check: keys that more than one row has."""
    return table.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """An integrity check: rows whose parent is missing."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def backup(tables: dict[str, DataFrame], folder: str) -> None:
    """A copy of each table below a folder that all executors can write; a copy that exists is never replaced."""
    for name, rows in tables.items():
        rows.write.mode("error").parquet(f"{folder}/{name}")


def restored(spark: SparkSession, folder: str, keys: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The tables of a backup, after a check that none repeats its keys."""
    out = {}
    for name, key in keys.items():
        rows = spark.read.parquet(f"{folder}/{name}")
        if not duplicate_keys(rows, key).isEmpty():
            raise ValueError(f"backup of {name} repeats its keys")
        out[name] = rows
    return out


def ascii_tree(edges: list[tuple[str, str, str]], root: str) -> str:
    """A small collected graph, (from, relation, to), as an indented tree; nodes met again are marked."""
    below: dict[str, list[tuple[str, str]]] = {}
    for a, r, b in edges:
        below.setdefault(a, []).append((r, b))
    out, seen, todo = [], set(), [(root, "", 0)]
    while todo:
        node, relation, depth = todo.pop()
        label = f"{relation}: {node}" if relation else node
        out.append("  " * depth + label + (" (seen)" if node in seen else ""))
        if node not in seen:
            seen.add(node)
            todo += [(b, r, depth + 1) for r, b in sorted(below.get(node, []), reverse=True)]
    return "\n".join(out)


def markdown_report(run: dict, counts: dict[str, int], usage: list, claims: list, pivots: list, most_claims: int = 20, most_pivots: int = 10) -> str:
    """A run's report from aggregates and the few rows that it shows."""
    out = [f"# Report: {run['id']}", "", f"- Root domain: `{run['root_domain']}`", f"- Status: `{run['status']}`", *[f"- {k}: `{v}`" for k, v in counts.items()], "", "## Sources", ""]
    out += [f"- `{u['provider']}` / `{u['capability']}`: `{u['status']}`, calls `{u['calls']}`" for u in usage] or ["- none"]
    out += ["", "## Claims", "", *[f"- `{c['subject_value_norm']}` {c['claim_type']} `{c['object_value_norm']}` ({c['confidence_class']}, {c['score']:.2f})" for c in claims[:most_claims]]]
    out += ["", "## Pivots", "", *[f"- `{p['id_type']}` `{p['value']}` ({p['score']:.2f})" for p in pivots[:most_pivots]]]
    return "\n".join(out) + "\n"


def write_bundle(spark: SparkSession, folder: str, report: str, tree: str, graph: DataFrame) -> None:
    """The report, the tree and the graph's JSON in a folder that Spark can write."""
    graph.select("json").write.mode("overwrite").text(f"{folder}/graph")
    for name, text in (("report", report), ("tree", tree)):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def discovered_domains(nodes: DataFrame, lineage: DataFrame) -> DataFrame:
    """(run_id, domain, first_depth) of domain nodes; the depth is the least of their lineage, 0 where they have none."""
    depth = lineage.groupBy("run_id", F.col("child_node_id").alias("node_id")).agg(F.min("depth").alias("d"))
    return nodes.where("node_type = 'domain'").join(depth, ["run_id", "node_id"], "left").select("run_id", F.col("value_norm").alias("domain"), F.coalesce("d", F.lit(0)).alias("first_depth"))
