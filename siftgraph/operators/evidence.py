"""The ledger: observations, claims and evidence links, each written once.

Rows carry ``seq``, their order of arrival. Of rows of one key the first wins,
whatever the later ones say, and rows whose key is stored already are left out
by an anti join, so a replay adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The parts of the keys, in order. The raw record stands as its hash, else as the canonical JSON of the normalized value.
OBSERVATION_KEY = ("source", "source_record_id", "subject_type", "subject_value_norm", "predicate", "object_type", "object_value_norm", "raw", "observed_at")
CLAIM_KEY = ("claim_type", "subject_type", "subject_value_norm", "object_type", "object_value_norm", "status", "policy_version", "valid_from", "valid_to")
POLICY = "relationship-v1"
# Relations that a resolver or listing states directly.
INFRASTRUCTURE = ("domain_has_subdomain", "domain_has_ip", "domain_has_mx", "domain_has_ns", "domain_has_cname")


def stable_hash(*parts: Column | str) -> Column:
    """SHA-256 of the parts with nulls as empty, joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]), 256)


def first_of(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The row of least ``seq`` of each key: one aggregation, combined before its shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    order = [seq, *[c for c in rest if c != seq]]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first")).select(*keys, "__first.*").select(*rows.columns)


def observations(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations with their ``dedup_key``, rows that break a rule with the ``reason``). ``raw_hash`` and ``normalized`` (canonical JSON) may be absent."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    reason = F.when(~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), "confidence").when(blank("subject_type") | blank("subject_value_norm") | blank("predicate") | blank("source"), "required")
    marked = facts.withColumn("reason", reason)
    raw = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("raw_hash", "normalized") if c in facts.columns], F.lit("{}"))
    good = marked.where("reason is null").drop("reason").withColumn("dedup_key", stable_hash(*[raw if k == "raw" else k for k in OBSERVATION_KEY]))
    return good, marked.where("reason is not null")


def append(rows: DataFrame, keys: list[str], stored: DataFrame | None = None) -> DataFrame:
    """The rows to add to a table that has these keys at most once."""
    new = first_of(rows, keys)
    return new if stored is None else new.join(stored.select(*keys), keys, "left_anti")


def claims(relations: DataFrame) -> DataFrame:
    """Claims of (relation_type, subject_*, object_*, score, source, seq): bounded score, class and status by relation, key."""
    s = F.greatest(F.lit(0.0), F.least(F.col("score"), F.lit(1.0)))
    seen, bought = F.col("relation_type").isin(*INFRASTRUCTURE), F.col("relation_type").startswith("acquisition_")
    kind = F.when(seen, "verified").when(s >= F.when(bought, 0.75).otherwise(0.8), "probable").otherwise("candidate")
    status = F.when(seen, "observed").when(bought, F.regexp_replace("relation_type", "^acquisition_", "")).otherwise("candidate")
    out = relations.withColumn("score", s).withColumn("confidence_class", kind).withColumn("status", status).withColumn("policy_version", F.lit(POLICY)).withColumnRenamed("relation_type", "claim_type")
    for c in ("valid_from", "valid_to"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.withColumn("claim_key", stable_hash(*CLAIM_KEY)).withColumn("evidence_reason", F.concat("source", F.lit(f" observation projected by {POLICY}")))


# Which sources share a lineage.
FAMILIES = {
    "rdap-iana": "domain-registration-registry", "python-whois": "domain-registration-registry", "registration-cascade": "domain-registration-registry", "test-whois": "domain-registration-registry",
    "http-html": "current-origin-web", "system-dns": "authoritative-dns", "stdlib": "authoritative-dns", "crtsh": "certificate-transparency", "hackertarget": "hackertarget-aggregate", "subfinder": "multi-upstream-wrapper",
    "duckduckgo": "web-search-index", "search-candidate": "web-search-index", "whoxy": "commercial-whois-history", "wikidata": "wikidata-community-graph", "gleif": "gleif-lei-register", "sec-edgar": "sec-regulatory-filings",
    "wayback": "internet-archive", "relationship_engine": "derived-inference",
}


def family(source: Column, compat: bool = False) -> Column:
    """The lineage family of a source. Per-upstream names are known with a colon and, unless ``compat``, with a slash."""
    s = F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))
    known = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    upstream = F.trim(F.regexp_extract(s, "^subfinder:(.*)$" if compat else "^subfinder[:/](.*)$", 1))
    return F.coalesce(F.try_element_at(known, s), F.when(upstream != "", F.concat(F.lit("subfinder-upstream:"), upstream)), F.lit("unclassified"))


def independence(evidence: DataFrame) -> DataFrame:
    """(claim_id, families, classified_family_count, has_unclassified_sources, independence_status) over all polarities."""
    f = family(F.col("source"))
    out = evidence.groupBy("claim_id").agg(F.array_sort(F.collect_set(f)).alias("families"))
    known = F.size(F.filter("families", lambda x: x != "unclassified"))
    odd = F.array_contains("families", "unclassified")
    status = F.when(odd, "unclassified").when(known >= 2, "multiple_independent_families").otherwise("single_family")
    return out.select("claim_id", "families", known.cast("long").alias("classified_family_count"), odd.alias("has_unclassified_sources"), status.alias("independence_status"))


def source_value(claims_: DataFrame, evidence: DataFrame) -> DataFrame:
    """What each family contributes, from supporting evidence: sole and corroborated support is counted only where no source is unclassified."""
    rows = evidence.where("polarity = 'supports'").select("claim_id", "source", family(F.col("source")).alias("source_family"))
    # A claim's families are few (the catalogue's), so they are one small array; sources and domains are made distinct before they are counted.
    per = rows.groupBy("claim_id").agg(F.collect_set("source_family").alias("f"))
    own = claims_.select("claim_id", "confidence_class", "object_type", "object_value_norm")
    odd, n = F.array_contains("f", "unclassified"), F.size("f")
    x = per.join(own, "claim_id").select("*", ((n == 1) & ~odd).alias("sole"), ((n >= 2) & ~odd).alias("more"), F.explode("f").alias("source_family"))
    verified = F.col("confidence_class") == "verified"
    counts = x.groupBy("source_family").agg(
        F.count("*").alias("supporting_claims"),
        F.count_if(verified).alias("verified_claims_supported"),
        F.count_if("sole").alias("sole_family_claims"),
        F.count_if(F.col("sole") & verified).alias("sole_family_verified_claims"),
        F.count_if("more").alias("corroborated_claims"),
    )
    reached = x.where("object_type = 'domain' and object_value_norm <> ''").groupBy("source_family", "object_value_norm").agg(F.bool_or("sole").alias("sole"))
    reached = reached.groupBy("source_family").agg(F.count("*").alias("d"), F.count_if("sole").alias("s"))
    told = rows.join(own.select("claim_id"), "claim_id", "left_semi").select("source_family", "source").distinct()
    told = told.groupBy("source_family").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    zero = F.lit(0)
    return counts.join(told, "source_family").join(reached, "source_family", "left").select(
        "source_family", "sources", "supporting_claims", "verified_claims_supported", "sole_family_claims", "sole_family_verified_claims",
        F.coalesce("d", zero).alias("supported_domains"), F.coalesce("s", zero).alias("sole_family_supported_domains"), "corroborated_claims",
    )


def claim_edges(claims_: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges of the claim graph: claims that aren't rejected, with their distinct sources and polarities."""
    of = evidence.groupBy("claim_id").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("polarity")).alias("polarities"))
    none = F.array().cast("array<string>")
    kept = claims_.where("confidence_class <> 'rejected'").join(of, "claim_id", "left")
    return kept.withColumn("sources", F.coalesce("sources", none)).withColumn("polarities", F.coalesce("polarities", none))


def claim_nodes(claims_: DataFrame) -> DataFrame:
    kept = claims_.where("confidence_class <> 'rejected'")
    return kept.select(F.col("subject_type").alias("node_type"), F.col("subject_value_norm").alias("value")).union(kept.select("object_type", "object_value_norm")).distinct()


def observations_from(records: DataFrame, kind: str, raw: list[str] | None = None, capability: str | None = None) -> DataFrame:
    """(subject, predicate, object, confidence) rows of one kind of record, from its columns.

    With ``raw``, the columns that make up the record as it was captured, each row carries the record's
    ``raw_hash`` (SHA-256 of canonical JSON); with ``capability`` the ``normalized`` value as canonical JSON.
    """
    from ..functions.canonical import canonical_row, quoted, raw_hash
    from ..functions.domains import tracker_confidence

    if raw is not None:
        records = records.withColumn("raw_hash", raw_hash(canonical_row(records, raw)))
    subject = F.col("domain")
    fact = lambda p, t, v, c, r=None: F.struct(F.lit(p).alias("predicate"), F.lit(t).alias("object_type"), v.alias("object_value_norm"), (c if isinstance(c, Column) else F.lit(c)).cast("double").alias("confidence"), (r if r is not None else F.lit(None)).cast("string").alias("source_record_id"))
    one = lambda p, t, c, conf, r=None: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.array(fact(p, t, F.col(c), conf, r))).otherwise(F.array().cast(_FACTS))
    many = lambda p, t, c, conf: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: fact(p, t, x, conf(x) if callable(conf) else conf))
    if kind == "whois":
        weak = F.when(F.col("source").isin("fallback", "whois_error", "whois_empty"), 0.1).otherwise(0.7)
        fields = (("registrant_name", "registered_by_name", "person"), ("registrant_org", "registered_by_org", "organization"), ("registrant_email", "has_registrant_email", "email"), ("registrant_phone", "has_registrant_phone", "phone"), ("creation_date", "created_at", "timestamp"), ("expiration_date", "expires_at", "timestamp"))
        parts = [one(p, t, c, weak, F.lit(c)) for c, p, t in fields] + [many("has_nameserver", "nameserver", "nameservers", weak)]
    elif kind == "basic":
        parts = [one("has_page_title", "text", "title", 0.5), one("has_page_description", "text", "description", 0.4), many("uses_alias", "name", "aliases", 0.4), many("uses_tracker", "tracker", "tracker_ids", tracker_confidence), one("claims_copyright_org", "organization", "copyright_org", 0.65), one("redirects_to_domain", "domain", "redirect_domain", 0.9, F.nullif("final_url", F.lit(""))), many("states_legal_entity", "organization", "legal_entities", 0.85)]
    elif kind == "dns":
        parts = [many(p, t, c, 0.8) for c, p, t in (("a_records", "resolves_to", "ip"), ("aaaa_records", "resolves_to", "ip"), ("mx_records", "has_mx", "mx"), ("ns_records", "has_nameserver", "nameserver"), ("cname_records", "has_cname", "domain"), ("txt_records", "publishes_txt", "text"))]
    elif kind == "history":
        capped = lambda x: F.least(F.lit(0.85), tracker_confidence(x))
        parts = [one("has_archived_snapshot", "url", "archive_url", 1.0), one("had_page_title", "text", "title", 0.6), many("historically_used_tracker", "tracker", "tracker_ids", capped), one("historically_claimed_copyright_org", "organization", "copyright_org", 0.6)]
    else:
        raise ValueError(f"unknown record kind: {kind}")
    keep = [c for c in ("source", "observed_at", "seq", "raw_hash") if c in records.columns]
    rows = records.select(F.lit("domain").alias("subject_type"), subject.alias("subject_value_norm"), *keep, F.explode(F.concat(*parts)).alias("f")).select("subject_type", "subject_value_norm", *keep, "f.*")
    if capability is None:
        return rows
    return rows.withColumn("normalized", F.concat(F.lit('{"capability":'), quoted(F.lit(capability)), F.lit(',"value":'), quoted(F.col("object_value_norm")), F.lit("}")))


_FACTS = "array<struct<predicate:string,object_type:string,object_value_norm:string,confidence:double,source_record_id:string>>"
