"""Clusters of domains that share an identifier, expansion by waves, and lookups over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How telling a shared identifier is, strongest first.
RANK = {"tracker": 0, "email": 1, "org": 2, "ns": 3, "name": 4, "phone": 5}


def shared_clusters(nodes: DataFrame, edges: DataFrame, min_domains: int = 2) -> DataFrame:
    """(identifier, id_type, domains, n_domains, rank) of identifiers that link enough domains, in either direction of the edge."""
    side = lambda p: nodes.select(F.col("node_id").alias(f"{p}_id"), F.col("node_type").alias(f"{p}_type"), F.col("value_norm").alias(f"{p}_value"), F.col("identifier_type").alias(f"{p}_kind"))
    e = edges.join(side("a"), F.col("from_node_id") == F.col("a_id")).join(side("b"), F.col("to_node_id") == F.col("b_id"))
    left = F.col("a_type") == "identifier"
    e = e.where((left & (F.col("b_type") == "domain")) | ((F.col("a_type") == "domain") & (F.col("b_type") == "identifier")))
    pick = lambda x: F.when(left, F.col(f"a_{x}")).otherwise(F.col(f"b_{x}"))
    pairs = e.select(pick("id").alias("id"), pick("value").alias("identifier"), F.coalesce(pick("kind"), F.lit("")).alias("id_type"), F.when(left, F.col("b_value")).otherwise(F.col("a_value")).alias("domain"))
    found = pairs.groupBy("id", "identifier", "id_type").agg(F.array_sort(F.collect_set("domain")).alias("domains")).where(F.size("domains") >= min_domains)
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("id_type")), F.lit(9))
    return found.select("identifier", "id_type", "domains", F.size("domains").cast("long").alias("n_domains"), rank.cast("long").alias("rank"))


def clusters_of(pairs: DataFrame, min_domains: int = 2) -> DataFrame:
    """The same from plain (identifier, id_type, domain) rows."""
    found = pairs.groupBy("identifier", "id_type").agg(F.array_sort(F.collect_set("domain")).alias("domains"))
    return found.where(F.size("domains") >= min_domains)


def cluster_sizes(pairs: DataFrame, min_domains: int = 2, preview: int = 10) -> DataFrame:
    """(identifier, id_type, n_domains, preview) of clusters from (identifier, id_type, domain) rows: how many domains share an identifier, and the first few by name.

    An identifier that a third of all domains share costs a row for each task in counting, and ``preview`` rows for
    each task in the preview (the limit is applied before the shuffle); its domains never meet in one row.
    """
    key = ["identifier", "id_type"]
    once = pairs.select(*key, "domain").distinct()
    sizes = once.groupBy(*key).agg(F.count("*").alias("n_domains")).where(F.col("n_domains") >= min_domains)
    first = once.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy("domain"))).where(F.col("__r") <= preview)
    shown = first.groupBy(*key).agg(F.array_sort(F.collect_list("domain")).alias("preview"))
    return sizes.join(shown, key)


def cluster_members(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The (identifier, id_type, domain) rows of the clusters in ``sizes``, each once: what a list in one row would hold."""
    return pairs.select("identifier", "id_type", "domain").distinct().join(sizes.select("identifier", "id_type"), ["identifier", "id_type"], "left_semi")


def expand(links: DataFrame, roots: DataFrame, max_depth: int, node_cap: int | None = None) -> DataFrame:
    """(domain, depth) reached from the roots over (from_domain, to_domain) links, breadth first.

    One wave a step; what a wave has seen is left out by an anti join, and each
    wave is written out so that plans don't grow. ``node_cap`` is tested between
    waves, where (depth, domain) decides who stays, so it isn't overshot.
    """
    front = cut(roots.select("domain", F.lit(0).alias("depth")).distinct())
    waves, count = [front], front.count()
    for depth in range(1, max_depth + 1):
        if node_cap is not None and count >= node_cap:
            break
        new = links.join(front.select(F.col("domain").alias("from_domain")), "from_domain").select(F.col("to_domain").alias("domain")).distinct()
        for wave in waves:  # the written waves before; only the new one is written now
            new = new.join(wave.select("domain"), "domain", "left_anti")
        front = cut(new.withColumn("depth", F.lit(depth)))
        n = front.count()
        if not n:
            break
        waves.append(front)
        count += n
    seen = waves[0]
    for wave in waves[1:]:
        seen = seen.unionByName(wave)
    return seen if node_cap is None else seen.orderBy("depth", "domain").limit(node_cap)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that ``spark.checkpoint.dir`` names; only a local session may do without one."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that they share")
            import tempfile

            place = tempfile.mkdtemp(prefix="siftgraph-")
        context.setCheckpointDir(place)
    return df.checkpoint()


def unprocessed(nodes: DataFrame, processed: DataFrame) -> DataFrame:
    """Domain nodes that no processed row names."""
    return nodes.where("node_type = 'domain'").join(processed.select("run_id", F.col("domain").alias("value_norm")), ["run_id", "value_norm"], "left_anti")


def both_ends(captures: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """Of each key the first ceil(k/2) and last floor(k/2) captures: two ranks, each limited before its shuffle, and what both gave once."""
    cols = captures.columns
    asc = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    desc = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))
    first = captures.withColumn("__r", asc).where(F.col("__r") <= (k + 1) // 2)
    last = captures.withColumn("__r", desc).where(F.col("__r") <= k // 2)
    return first.select(*cols).unionByName(last.select(*cols)).distinct()


def exactly_one(candidates: DataFrame, name: str, value: str) -> DataFrame:
    """Names that one candidate alone has; all others abstain. One aggregation, no window."""
    return candidates.groupBy(name).agg(F.count("*").alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")


def cascade(answers: DataFrame, key: str, priority: str) -> DataFrame:
    """Of each key the answers of its first source that gave any."""
    best = answers.groupBy(key).agg(F.min(priority).alias(priority))
    return answers.join(best, [key, priority], "left_semi")
