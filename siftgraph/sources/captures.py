"""Captured source payloads as records: built-in functions over JSON, CSV and text columns.

Every reader takes a DataFrame of payloads with the asked ``domain`` or ``name``
and returns rows; live collection isn't part of it. Malformed payloads give no
rows (or null fields), never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.domains import noise_domain, normalized_domain, registrable

_SPACE = r"(?U)^\s+|\s+$"


def _clean(c: Column) -> Column:
    return F.regexp_replace(c, _SPACE, "")


def redacted_identity(value: Column, most: int = 500) -> Column:
    """A registration field as one line; empty where it is a privacy notice."""
    v = F.substring(F.regexp_replace(_clean(value), r"(?U)\s+", " "), 1, most)
    # Notices that stand for a withheld value.
    notice = r"(?i)redacted|data protected|not disclosed|withheld|privacy|gdpr|not available from registry"
    return F.when(F.coalesce(v, F.lit("")).rlike(notice), "").otherwise(F.coalesce(v, F.lit("")))



def registration_records(payloads: DataFrame) -> DataFrame:
    """Registry JSON (domain, payload) as whois records: registrant fields by role, first event of each action, name servers."""
    j = lambda path: F.get_json_object("payload", path)
    entities = F.from_json(F.coalesce(j("$.entities"), F.lit("[]")), "array<struct<roles:array<string>,vcardArray:string>>")
    registrant = F.get(F.filter(entities, lambda e: F.array_contains(e["roles"], "registrant")), 0)["vcardArray"]
    cards = F.from_json(F.get_json_object(registrant, "$[1]"), "array<array<string>>")
    named = lambda name: lambda x: (F.lower(F.get(x, 0)) == name) & (F.coalesce(F.get(x, 3), F.lit("")) != "")
    field = lambda name: redacted_identity(F.get(F.get(F.filter(cards, named(name)), 0), 3))
    events = F.from_json(F.coalesce(j("$.events"), F.lit("[]")), "array<struct<eventAction:string,eventDate:string>>")
    event = lambda name: F.coalesce(F.get(F.filter(events, lambda e: e["eventAction"] == name), 0)["eventDate"], F.lit(""))
    servers = F.from_json(F.coalesce(j("$.nameservers"), F.lit("[]")), "array<struct<ldhName:string>>")
    return payloads.select(
        "domain",
        field("fn").alias("registrant_name"),
        field("org").alias("registrant_org"),
        field("email").alias("registrant_email"),
        field("tel").alias("registrant_phone"),
        event("registration").alias("creation_date"),
        event("expiration").alias("expiration_date"),
        _hosts(F.transform(servers, lambda s: s["ldhName"])).alias("nameservers"),
    )


def _hosts(names: Column) -> Column:
    """Host names in lower case without a last dot, distinct and sorted."""
    low = F.transform(names, lambda s: F.regexp_replace(F.lower(_clean(s)), r"\.+$", ""))
    return F.array_sort(F.array_distinct(F.filter(low, lambda s: F.coalesce(s, F.lit("")) != "")))


def answered_bases(answers: DataFrame, most: int = 3) -> DataFrame:
    """Of each domain the answer of the first of its ``most`` bases that gave one: (domain, ord, base, payload or null) rows in order."""
    tried = answers.withColumn("__r", F.row_number().over(Window.partitionBy("domain").orderBy("ord", "base"))).where(F.col("__r") <= most)
    first = tried.where("payload is not null").groupBy("domain").agg(F.min(F.struct("ord", "base", "payload")).alias("x"))
    return first.select("domain", "x.base", "x.payload")


def legacy_registrations(payloads: DataFrame) -> DataFrame:
    """JSON of the older registration service (domain, payload) as whois records; lists give their first text, whichever key holds it.

    ``source`` is ``whois_empty`` where the record is empty. ``raw`` keeps the text from which pivots are taken.
    """
    j = lambda *paths: F.coalesce(*[F.get_json_object("payload", x) for x in paths])
    first = lambda c: F.coalesce(_clean(F.get(F.filter(_listed(c), lambda x: _clean(x) != ""), 0)), F.lit(""))
    empty = F.coalesce(F.regexp_replace("payload", r"\s", ""), F.lit("{}")).isin("{}", "null", "")
    return payloads.select(
        "domain",
        F.when(empty, "whois_empty").otherwise("python-whois").alias("source"),
        first(j("$.name")).alias("registrant_name"),
        first(j("$.org")).alias("registrant_org"),
        first(j("$.emails", "$.email")).alias("registrant_email"),
        first(j("$.phone")).alias("registrant_phone"),
        first(j("$.creation_date")).alias("creation_date"),
        first(j("$.expiration_date")).alias("expiration_date"),
        _hosts(_listed(j("$.name_servers", "$.nserver"))).alias("nameservers"),
        F.coalesce("payload", F.lit("")).alias("raw"),
    )


def _listed(c: Column) -> Column:
    """A JSON text or array of texts as an array."""
    return F.when(c.startswith("["), F.from_json(c, "array<string>")).when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))


def dns_records(answers: DataFrame) -> DataFrame:
    """Captured answers (domain, rtype, value) as one record of sorted distinct values for each domain."""
    v = F.regexp_replace(_clean("value"), r"\.+$", "")
    value = F.when(F.col("rtype") == "TXT", F.col("value")).when(F.col("rtype") == "MX", F.lower(F.regexp_replace(v, r"^\d+\s+", ""))).otherwise(F.lower(v))
    rows = answers.withColumn("__v", value).where("__v <> ''")
    kinds = ("A", "AAAA", "MX", "NS", "CNAME", "TXT")
    of = lambda k: F.array_sort(F.collect_set(F.when(F.col("rtype") == k, F.col("__v")))).alias(f"{k.lower()}_records")
    return rows.groupBy("domain").agg(*map(of, kinds))


def service_for(hosts: DataFrame, services: DataFrame) -> DataFrame:
    """The service of the longest suffix of each host: suffixes joined by equality, then one aggregation."""
    labels = F.split("domain", r"\.")
    ends = hosts.select("domain", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))).alias("suffix"))
    return ends.join(services, "suffix").groupBy("domain").agg(F.max_by("base", F.length("suffix")).alias("base"))


def merged_registration(first: DataFrame, second: DataFrame) -> DataFrame:
    """Fields of the first where it has them, else of the second; the union of name servers."""
    fields = [c for c in first.columns if c not in ("domain", "nameservers")]
    x = first.alias("a").join(second.alias("b"), "domain", "left")
    none = F.array().cast("array<string>")
    return x.select("domain", *[F.coalesce(F.nullif(F.col(f"a.{c}"), F.lit("")), F.col(f"b.{c}"), F.lit("")).alias(c) for c in fields], F.array_sort(F.array_union(F.coalesce("a.nameservers", none), F.coalesce("b.nameservers", none))).alias("nameservers"))


def registration_cascade(answers: DataFrame) -> DataFrame:
    """Answers (domain, priority, fields...) in order, up to the first with an identity; of each field the first that isn't empty."""
    identity = ["registrant_name", "registrant_org", "registrant_email", "registrant_phone"]
    enough = F.greatest(*[(F.coalesce(c, F.lit("")) != "").cast("int") for c in identity])
    before = F.max(enough).over(Window.partitionBy("domain").orderBy("priority").rowsBetween(Window.unboundedPreceding, -1))
    used = answers.withColumn("__done", F.coalesce(before, F.lit(0))).where("__done = 0")
    rest = [c for c in answers.columns if c not in ("domain", "priority", "nameservers")]
    # min_by skips rows whose order is null: those with an empty field.
    pick = lambda c: F.coalesce(F.min_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("priority"))), F.lit(""))
    return used.groupBy("domain").agg(*[pick(c).alias(c) for c in rest], F.array_sort(F.array_distinct(F.flatten(F.collect_list("nameservers")))).alias("nameservers"))


def listing_state(payload: Column) -> Column:
    """What a text listing is: ``rate_limited`` or ``error`` notices, ``empty``, or ``ok``."""
    t = _clean(F.coalesce(payload, F.lit("")))
    notice = t.startswith("error") | (t == "")
    return F.when(notice & F.lower(t).rlike("limit|quota"), "rate_limited").when(t == "", "empty").when(notice, "error").otherwise("ok")


def listed_hosts(listings: DataFrame, most: int, scoped: bool = True) -> DataFrame:
    """Hosts of text listings (domain, payload), the first field of each line: no wildcards, lower case, distinct, the shortest first, then by name; (domain, host, place). Notices give none; ``scoped`` keeps hosts of the domain."""
    rows = listings.where(listing_state(F.col("payload")) == "ok").select("domain", F.explode(F.split("payload", "\n")).alias("h"))
    rows = rows.select("domain", F.regexp_replace(F.lower(_clean(F.split_part("h", F.lit(","), F.lit(1)))), r"\.+$", "").alias("host"))
    good = rows.where((F.col("host") != "") & ~F.col("host").contains("*"))
    if scoped:
        good = good.where((F.col("host") == F.col("domain")) | F.col("host").endswith(F.concat(F.lit("."), "domain")))
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.length("host"), "host"))
    return good.distinct().withColumn("place", place).where(F.col("place") <= most)


def found_hosts(findings: DataFrame, most: int) -> DataFrame:
    """Hosts below the domain from JSON lines (domain, payload) with the sorted sources of each; (domain, host, sources)."""
    line = F.explode(F.split("payload", "\n"))
    rows = findings.select("domain", line.alias("j")).select("domain", F.lower(F.get_json_object("j", "$.host")).alias("host"), F.coalesce(F.get_json_object("j", "$.source"), F.lit("unknown")).alias("source"))
    rows = rows.where(F.col("host").endswith(F.concat(F.lit("."), "domain")))
    merged = rows.groupBy("domain", "host").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return merged.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy("host"))).where(F.col("r") <= most).drop("r")


def search_query(id_type: Column, value: Column) -> Column:
    """The text to search for, by type of identifier; null where there is nothing to search."""
    v = _clean(value)
    quoted = F.concat(F.lit('"'), v, F.lit('"'))
    more = {"org": " domain", "name": " domain", "ns": " nameserver", "phone": " whois"}
    out = F.when(F.lower(id_type).isin("email", "tracker"), quoted)
    for kind, word in more.items():
        out = out.when(F.lower(id_type) == kind, F.concat(quoted, F.lit(word)))
    return F.when(v != "", out.otherwise(v))


def search_hits(results: DataFrame, most: int) -> DataFrame:
    """Domains in search results (identifier, ord, text) by first mention, without noise; (identifier, domain, place).

    A search asks for three times as many results as it may keep, 10 at least: only those are read.
    """
    asked = results.withColumn("__r", F.row_number().over(Window.partitionBy("identifier").orderBy("ord"))).where(F.col("__r") <= max(10, 3 * most))
    hits = F.regexp_extract_all(F.lower("text"), F.lit(r"\b((?:[a-z0-9-]+\.)+[a-z]{2,})\b"), F.lit(1))
    found = asked.select("identifier", "ord", F.posexplode(hits).alias("pos", "hit"))
    found = found.withColumn("domain", normalized_domain(F.col("hit"))).where(F.col("domain").isNotNull() & ~noise_domain(F.col("domain")))
    first = found.groupBy("identifier", "domain").agg(F.min(F.struct("ord", "pos")).alias("at"))
    place = F.row_number().over(Window.partitionBy("identifier").orderBy("at", "domain"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("identifier", "domain", "place")


#: Most rows of a paid answer.
PAID_ROWS = 2500


def _paid_state(body: Column, whole: Column, what: str = "") -> Column:
    """``ok`` or why a paid answer isn't used, by its status and the words of its reason."""
    status = F.get_json_object(body, "$.status")
    reason = F.lower(F.coalesce(F.get_json_object(body, "$.status_reason"), F.lit("unknown error")))
    typed = F.coalesce(F.schema_of_variant(F.try_parse_json(body)).rlike("[<, ]status: (BIGINT|INT)"), F.lit(False))
    refused = F.when(reason.rlike("key|auth"), "auth_error").when(reason.rlike("limit|quota|credit|too many"), "rate_limited")
    if what == "search":
        refused = refused.when(reason.rlike("no record|no result|zero result"), "empty")
    return F.when(~typed | ~F.coalesce(status.isin("0", "1"), F.lit(False)), "malformed").when(status == "0", refused.otherwise("error")).otherwise(whole)


def paid_lookups(payloads: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """((identifier, state), (identifier, domain, place)) of paid reverse lookups (identifier, payload).

    An answer is used only if all of it keeps the contract: an integer status, the asked query, an array of at
    most 2,500 objects, counts that are whole, not negative and agree, and the first page. ``state`` is ``ok``,
    ``empty``, ``auth_error``, ``rate_limited``, ``too_large``, ``malformed`` or ``error``.
    """
    body = F.col("payload")
    j = lambda path: F.get_json_object(body, path)
    rows = F.from_json(j("$.search_result"), "array<string>")
    whole = lambda path: j(path).isNull() | j(path).rlike("^[0-9]{1,15}$")
    number = lambda path: F.when(whole(path), j(path).cast("long"))
    objects = F.forall(rows, lambda x: F.coalesce(x.startswith("{"), F.lit(False)))
    counts = whole("$.total_results") & whole("$.total_pages") & whole("$.current_page")
    pages = F.coalesce(number("$.current_page") == 1, F.lit(True)) & F.coalesce(number("$.total_results") >= F.size(rows), F.lit(True))
    fine = F.coalesce(j("$.api_query") == "reverse_whois", F.lit(True)) & rows.isNotNull() & objects & counts & pages
    state = F.when(F.size(rows) > PAID_ROWS, "too_large").when(~F.coalesce(fine, F.lit(False)), "malformed").otherwise("ok")
    told = payloads.select("identifier", _paid_state(body, state, "search").alias("state"), rows.alias("rows"))
    hits = told.where("state = 'ok'").select("identifier", F.posexplode("rows").alias("pos", "r"))
    hits = hits.select("identifier", "pos", normalized_domain(F.get_json_object("r", "$.domain_name")).alias("domain")).where("domain is not null")
    first = hits.groupBy("identifier", "domain").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy("identifier").orderBy("pos"))
    return told.select("identifier", "state"), first.withColumn("place", place).where(F.col("place") <= most).drop("pos")


def paid_balances(payloads: DataFrame) -> DataFrame:
    """(account, state, remaining) of balance answers (account, payload): an integer of at least 0, or why there is none."""
    value = F.get_json_object("payload", "$.reverse_whois_balance")
    state = _paid_state(F.col("payload"), F.when(F.coalesce(value.rlike("^[0-9]{1,15}$"), F.lit(False)), "ok").otherwise("malformed"))
    return payloads.select("account", state.alias("state"), F.when(state == "ok", value.cast("long")).alias("remaining"))


def archive_rows(listings: DataFrame) -> DataFrame:
    """Rows of array listings (domain, payload), named by their header; found pages only.

    A listing whose header lacks a field gives none, nor does a row of another length.
    """
    names = ("timestamp", "original", "mimetype", "statuscode", "digest")
    table = F.from_json("payload", "array<array<string>>")
    rows = listings.select("domain", table.alias("t")).where(F.size("t") > 1)
    rows = rows.select("domain", F.get("t", 0).alias("header"), F.explode(F.slice("t", F.lit(2), F.size("t") - 1)).alias("r"))
    rows = rows.where((F.size("r") == F.size("header")) & (F.size(F.array_intersect("header", F.array(*map(F.lit, names)))) == len(names)))
    out = rows.select("domain", *[F.get("r", (F.array_position("header", c) - 1).cast("int")).alias(c) for c in names])
    out = out.where((F.col("statuscode") == "200") & F.lower("mimetype").startswith("text/html"))
    return out.withColumn("captured_at", F.try_to_timestamp("timestamp", F.lit("yyyyMMddHHmmss")))


def snapshot_records(captures: DataFrame) -> DataFrame:
    """Records of archived pages (domain, timestamp, original, digest, html) whose address is the domain's own or its www host."""
    from ..functions import pages as pg

    host = F.regexp_replace(F.lower(F.regexp_extract("original", r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.+$", "")
    own = captures.where((host == F.col("domain")) | (host == F.concat(F.lit("www."), "domain")))
    source = F.coalesce("html", F.lit(""))
    at = F.try_to_timestamp("timestamp", F.lit("yyyyMMddHHmmss"))
    return own.select(
        "domain",
        at.alias("captured_at"),
        F.col("original").alias("original_url"),
        F.concat(F.lit("https://web.archive.org/web/"), "timestamp", F.lit("id_/"), "original").alias("archive_url"),
        "digest",
        pg.title(source).alias("title"),
        pg.trackers(source).alias("tracker_ids"),
        pg.copyright_owner(source).alias("copyright_org"),
    ).where("captured_at is not null")


def snapshots(rows: DataFrame, k: int) -> DataFrame:
    """Of each domain's distinct captures the first ceil(k/2) and the last floor(k/2)."""
    from ..operators.graph import both_ends

    return both_ends(rows.dropDuplicates(["domain", "timestamp", "digest"]), "domain", ["timestamp", "digest"], k)


_FILED = ("accessionNumber", "filingDate", "form", "primaryDocument", "items")


def filings(payloads: DataFrame, scan: int = 25, most: int = 5) -> DataFrame:
    """Current reports that tell of a completed purchase: of the first ``scan`` filings (cik, payload), columnar arrays zipped to rows, the first ``most`` that do."""
    recent = F.from_json(F.get_json_object("payload", "$.filings.recent"), "struct<" + ",".join(f"{c}:array<string>" for c in _FILED) + ">")
    rows = payloads.select("cik", F.posexplode(F.arrays_zip(*[recent[c].alias(c) for c in _FILED])).alias("pos", "r"))
    rows = rows.where(F.col("pos") < scan).select("cik", "pos", "r.*")
    told = F.exists(F.split("items", ","), lambda x: F.trim(x) == "2.01")
    held = (F.coalesce("accessionNumber", F.lit("")) != "") & (F.coalesce("primaryDocument", F.lit("")) != "")
    hit = rows.where(F.col("form").isin("8-K", "8-K/A") & told & held)
    return hit.withColumn("place", F.row_number().over(Window.partitionBy("cik").orderBy("pos"))).where(F.col("place") <= most)


def purchases_in_filings(reports: DataFrame, filers: DataFrame) -> DataFrame:
    """(cik, org, source_record_id, supporting_text) of completed purchases that reports (cik, place, accessionNumber, html) tell of: each target once, never the filer (cik, title) itself."""
    from ..functions.pages import plain_name, plain_text
    from ..operators.extract import completed_purchases

    found = reports.select("cik", "place", "accessionNumber", F.posexplode(completed_purchases(plain_text(F.col("html")))).alias("pos", "p"))
    found = found.withColumn("key", plain_name(F.col("p.target")))
    own = filers.select("cik", plain_name(F.col("title")).alias("key"))
    first = found.join(own, ["cik", "key"], "left_anti").groupBy("cik", "key").agg(F.min(F.struct("place", "pos", "accessionNumber", "p")).alias("x"))
    return first.select("cik", F.col("x.p.target").alias("org"), F.col("x.accessionNumber").alias("source_record_id"), F.col("x.p.support").alias("supporting_text"))


def exact_names(asked: DataFrame, registered: DataFrame) -> DataFrame:
    """(name, id) where one active registered entity alone has the asked name, compared in compatibility form without case, marks and spacing."""
    from ..functions.pages import plain_name

    rows = registered.where("active").select("id", F.explode("names").alias("n")).select("id", plain_name(F.col("n")).alias("key")).distinct()
    hits = asked.select("name", plain_name(F.col("name")).alias("key")).where("key <> ''").join(rows, "key")
    return hits.groupBy("name").agg(F.count_distinct("id").alias("k"), F.min("id").alias("id")).where("k = 1").drop("k")


def register_entities(payloads: DataFrame) -> DataFrame:
    """(id, names, active) of register records (payload): legal, other and transliterated names; active where both states say so."""
    j = lambda path: F.get_json_object("payload", path)
    kind = "array<struct<name:string>>"
    lists = [F.coalesce(F.from_json(j(f"$.attributes.entity.{k}"), kind), F.array().cast(kind)) for k in ("otherNames", "transliteratedOtherNames")]
    more = F.transform(F.concat(*lists), lambda x: x["name"])
    names = F.filter(F.concat(F.array(j("$.attributes.entity.legalName.name")), more), lambda x: F.coalesce(x, F.lit("")) != "")
    active = F.coalesce((j("$.attributes.entity.status") == "ACTIVE") & (j("$.attributes.registration.status") == "ISSUED"), F.lit(False))
    return payloads.select(F.coalesce(j("$.id"), j("$.attributes.lei")).alias("id"), F.array_distinct(names).alias("names"), active.alias("active")).where("id is not null")


# Relations of the register's hierarchy, in the order in which they are read.
HIERARCHY = ("direct_accounting_parent", "ultimate_accounting_parent", "direct_accounting_child", "ultimate_accounting_child")


def hierarchy(relations: DataFrame, most: int = 20) -> DataFrame:
    """(lei, relation, target, org, source_record_id) of register answers (lei, relation, payload): each (relation, target) once, the first ``most`` by relation, then place."""
    data = F.get_json_object("payload", "$.data")
    items = F.when(data.startswith("["), F.from_json(data, "array<string>")).otherwise(F.array(data))
    rows = relations.select("lei", "relation", F.posexplode(items).alias("pos", "r"))
    rows = rows.withColumn("target", F.coalesce(F.get_json_object("r", "$.id"), F.get_json_object("r", "$.attributes.lei")))
    rows = rows.withColumn("org", F.get_json_object("r", "$.attributes.entity.legalName.name")).where("target <> '' and org <> ''")
    order = F.array_position(F.array(*map(F.lit, HIERARCHY)), F.col("relation"))
    first = rows.groupBy("lei", "relation", "target").agg(F.min(F.struct("pos", "org")).alias("x"))
    place = F.row_number().over(Window.partitionBy("lei").orderBy(order, "x.pos"))
    record = F.concat_ws(":", "lei", "relation", "target").alias("source_record_id")
    return first.withColumn("place", place).where(F.col("place") <= most).select("lei", "relation", "target", F.col("x.org").alias("org"), record)


# Properties of an entity that name related ones, in the order in which they are read.
RELATED = (("P749", "parent"), ("P355", "subsidiary"), ("P127", "owned_by"), ("P1830", "owns"))


def entities_of(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, label, website), (from_id, to_id, relation, ord)) of entity JSON (id, payload): its first official website, and the links that its claims name."""
    j = lambda path: F.get_json_object("payload", path)
    values = lambda prop, path: F.filter(F.transform(F.from_json(j(f"$.claims.{prop}"), "array<string>"), lambda c: F.get_json_object(c, path)), lambda x: F.coalesce(x, F.lit("")) != "")
    sites = F.filter(values("P856", "$.mainsnak.datavalue.value"), lambda x: normalized_domain(x).isNotNull())
    own = payloads.select("id", F.coalesce(j("$.labels.en.value"), F.col("id")).alias("label"), F.get(sites, 0).alias("website"))
    links = None
    for k, (prop, relation) in enumerate(RELATED):
        targets = F.posexplode(values(prop, "$.mainsnak.datavalue.value.id")).alias("pos", "to_id")
        part = payloads.select(F.col("id").alias("from_id"), targets)
        part = part.select("from_id", "to_id", F.lit(relation).alias("relation"), (F.lit(k << 20) + F.col("pos")).alias("ord"))
        links = part if links is None else links.unionByName(part)
    return own, links


def related(entities: DataFrame, links: DataFrame, most: int = 20) -> DataFrame:
    """(org, relation, target, domain) of entity links in order, each target once and ``most`` for an entity; domain is empty where the target states no website."""
    apex = F.coalesce(registrable(normalized_domain(F.col("website"))), F.lit(""))
    site = entities.select(F.col("id").alias("to_id"), F.col("label").alias("target"), apex.alias("domain"))
    first = links.groupBy("from_id", "to_id").agg(F.min(F.struct("ord", "relation")).alias("x"))
    place = F.row_number().over(Window.partitionBy("from_id").orderBy("x.ord"))
    first = first.withColumn("place", place).where(F.col("place") <= most).select("from_id", "to_id", "x.relation")
    own = entities.select(F.col("id").alias("from_id"), F.col("label").alias("org"))
    out = first.join(own, "from_id").join(site, "to_id", "left")
    return out.select("org", "relation", F.coalesce("target", "to_id").alias("target"), F.coalesce("domain", F.lit("")).alias("domain"))
