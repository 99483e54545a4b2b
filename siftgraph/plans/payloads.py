"""Queries over payloads that are written from given tables: each row of a table becomes an answer as a source gives it, keyed so that each rule is reached, and the SQL recomputes the records from the columns.

They take the place of the queries of the same names in ``records``, whose few rows were written by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import domains as dom
from ..functions import pages as pg
from ..functions import security as sec
from ..operators import discovery as di
from ..operators import ledger as le
from ..sources import captures as cap
from .views import over

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Views that both engines read.
GIVEN: dict[str, str] = {}


def given(name: str, text: str) -> None:
    GIVEN[name] = text


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return over(spark, sf_dir, GIVEN[name], wide=True)


def query(sql: str, *names: str):
    def keep(f):
        QUERIES[f.__name__] = f
        body = f"select * from ({sql})" if sql.startswith("with ") else sql
        ORACLE_SQL[f.__name__] = "with " + ", ".join(f"v_{n} as ({GIVEN[n]})" for n in names) + "\n" + body if names else body
        return f

    return keep


def _object(*fields: tuple[str, str]) -> str:
    """SQL of a JSON object whose values are SQL texts of JSON."""
    return "concat('{', " + ", ', ', ".join(f"'\"{k}\": ', {v}" for k, v in fields) + ", '}')"


def _list(*items: str) -> str:
    return "concat('[', " + ", ', ', ".join(items) + ", ']')"


def _text(x: str) -> str:
    """SQL of a JSON string from a text without characters to escape."""
    return f"concat('\"', {x}, '\"')"


def _key(prefix: str, column: str, ending: str = "") -> str:
    return f"concat('{prefix}', cast({column} as string), '{ending}')"


# --- registrations ----------------------------------------------------------------------------------

given("bases", f"select {_key('c', 'o_custkey', '.com')} as domain, cast(o_orderkey as int) as ord, {_key('b', 'o_orderkey')} as base, case when o_orderkey % 3 = 0 then concat('{{', o_orderpriority, '}}') end as payload from orders")


@query("""select domain, arg_min(base, ord) as base, arg_min(payload, ord) as payload from (select *, row_number() over (partition by domain order by ord) as r from v_bases) where r <= 3 and payload is not null group by 1""", "bases")
def registration_bases(spark, sf_dir):
    """Each customer's orders are the bases tried, a third of which answer."""
    return cap.answered_bases(read(spark, sf_dir, "bases"))


given("hosts", f"select concat(case c_custkey % 4 when 0 then 'a.' when 1 then 'b.c.' else '' end, {_key('n', 'c_nationkey')}, case c_custkey % 5 when 0 then '.uk' when 1 then '.co.uk' when 2 then '.xx' when 3 then '.couk' else '.com' end) as domain, min(c_custkey) as k from customer group by 1")
given("services", "select case r_regionkey when 0 then 'uk' when 1 then 'co.uk' when 2 then 'com' when 3 then 'n7.com' else 'unused' end as suffix, concat('https://', lower(r_name)) as base from region")


@query("select domain, arg_max(base, len(suffix)) as base from v_hosts, v_services where domain = suffix or ends_with(domain, '.' || suffix) group by 1", "hosts", "services")
def service_suffixes(spark, sf_dir):
    return cap.service_for(read(spark, sf_dir, "hosts").select("domain"), read(spark, sf_dir, "services"))


# Customers are registrants; some withhold a field, some entities are a registrar's, some payloads are cut.
given("registry", f"""select {_key('c', 'c_custkey', '.com')} as domain, c_custkey as k, c_name as name, c_mktsegment as org, case when c_custkey % 17 = 3 then null when c_custkey % 17 = 4 then substring(j, 1, length(j) - 1) else j end as payload from (
select *, {_object(("entities", _list(_object(("roles", "'[\"registrar\"]'"), ("vcardArray", "'[\"vcard\", [[\"fn\", {}, \"text\", \"Registrar\"]]]'")), _object(("roles", "'[\"billing\", \"registrant\"]'"), ("vcardArray", _list("'\"vcard\"'", _list("'[\"fn\", {}, \"text\", \"\"]'", _list("'\"FN\", {}, \"text\"'", _text("case when c_custkey % 5 = 1 then 'Data Protected' else concat('  ', c_name, '   Ltd ') end")), _list("'\"org\", {}, \"text\"'", _text("case when c_custkey % 7 = 2 then 'REDACTED FOR PRIVACY' else c_mktsegment end")), _list("'\"email\", {}, \"uri\"'", _text("concat('m', cast(c_custkey as string), '@a.com')"))))))))
    , ("events", _list(_object(("eventAction", "'\"registration\"'"), ("eventDate", _text("cast(2000 + c_custkey % 20 as string)"))), _object(("eventAction", "'\"registration\"'"), ("eventDate", "'\"late\"'")), _object(("eventAction", "case when c_custkey % 2 = 0 then '\"expiration\"' else '\"transfer\"' end"), ("eventDate", _text("cast(2030 + c_nationkey as string)")))))
    , ("nameservers", _list(_object(("ldhName", _text("concat('NS2.N', cast(c_nationkey as string), '.com.')"))), _object(("ldhName", _text("concat('ns1.n', cast(c_nationkey as string), '.com')"))), _object(("ldhName", _text("concat('ns2.n', cast(c_nationkey as string), '.com')"))))))} as j from customer) t""")


@query("""select domain, case when bad or k % 5 = 1 then '' else name || ' Ltd' end as registrant_name, case when bad or k % 7 = 2 then '' else org end as registrant_org, case when bad then '' else 'm' || k || '@a.com' end as registrant_email, '' as registrant_phone,
case when bad then '' else (2000 + k % 20)::varchar end as creation_date, case when bad or k % 2 = 1 then '' else (2030 + c_nationkey)::varchar end as expiration_date,
case when bad then []::varchar[] else ['ns1.n' || c_nationkey || '.com', 'ns2.n' || c_nationkey || '.com'] end as nameservers from (select *, k % 17 in (3, 4) as bad from v_registry join customer on c_custkey = k)""", "registry")
def registry_records(spark, sf_dir):
    return cap.registration_records(read(spark, sf_dir, "registry").select("domain", "payload"))


# Of each customer up to five answers by orders; the first named one ends the search.
given("answers", f"""select {_key('c', 'o_custkey')} as domain, cast(o_orderkey as int) as priority, case when o_orderkey % 11 = 1 then o_orderpriority else '' end as registrant_name, case when o_orderkey % 7 = 2 then {_key('org', 'o_orderkey')} end as registrant_org,
case when o_orderkey % 13 = 3 then {_key('m', 'o_orderkey', '@a.com')} else '' end as registrant_email, '' as registrant_phone, case o_orderkey % 3 when 0 then '' when 1 then {_key('ns', 'o_orderkey % 5')} else concat('ns9,', {_key('ns', 'o_orderkey % 4')}) end as ns from orders""")


def _answers(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "answers")
    return rows.withColumn("nameservers", F.filter(F.split("ns", ","), lambda x: x != "")).drop("ns")


@query("""with u as (select *, coalesce(max((coalesce(registrant_name, '') || coalesce(registrant_org, '') || coalesce(registrant_email, '') || coalesce(registrant_phone, '') <> '')::int) over (partition by domain order by priority rows between unbounded preceding and 1 preceding), 0) as done from v_answers)
select domain, coalesce(arg_min(nullif(registrant_name, ''), priority) filter (registrant_name <> ''), '') as registrant_name, coalesce(arg_min(registrant_org, priority) filter (registrant_org <> ''), '') as registrant_org,
coalesce(arg_min(registrant_email, priority) filter (registrant_email <> ''), '') as registrant_email, coalesce(arg_min(registrant_phone, priority) filter (registrant_phone <> ''), '') as registrant_phone,
list_sort(list_filter(list_distinct(flatten(list(string_split(ns, ',')))), lambda x: x <> '')) as nameservers from u where done = 0 group by 1""", "answers")
def registration_cascade(spark, sf_dir):
    return cap.registration_cascade(_answers(spark, sf_dir))


@query("""with a as (select * from v_answers qualify row_number() over (partition by domain order by priority) = 1), b as (select * from v_answers qualify row_number() over (partition by domain order by priority desc) = 1)
select a.domain, coalesce(nullif(a.registrant_name, ''), b.registrant_name, '') as registrant_name, coalesce(nullif(a.registrant_org, ''), b.registrant_org, '') as registrant_org, coalesce(nullif(a.registrant_email, ''), b.registrant_email, '') as registrant_email,
coalesce(nullif(a.registrant_phone, ''), b.registrant_phone, '') as registrant_phone, list_sort(list_filter(list_distinct(string_split(a.ns, ',') || string_split(coalesce(b.ns, ''), ',')), lambda x: x <> '')) as nameservers from a left join b using (domain)""", "answers")
def merged_registrations(spark, sf_dir):
    """Each customer's first answer, filled from the last."""
    a = _answers(spark, sf_dir)
    ends = a.groupBy("domain").agg(F.min("priority").alias("lo"), F.max("priority").alias("hi"))
    x = a.join(ends, "domain")
    keep = [c for c in a.columns if c != "priority"]
    return cap.merged_registration(x.where("priority = lo").select(*keep), x.where("priority = hi").select(*keep))


given("legacy", f"""select {_key('s', 's_suppkey', '.com')} as domain, s_suppkey as k, s_nationkey as n, case s_suppkey % 3 when 0 then {_object(("name", _list("'\"\"'", _text("concat(' ', s_name, ' ')"))), ("org", _text(_key('Org ', 's_nationkey'))), ("emails", _list(_text(_key('a', 's_suppkey', '@a.com')), "'\"b@a.com\"'")), ("name_servers", _list(_text(_key('NS2.N', 's_nationkey', '.COM.')), _text(_key('ns1.n', 's_nationkey', '.com')), _text(_key('ns1.n', 's_nationkey', '.com')))), ("creation_date", _list(_text("cast(2000 + s_suppkey % 9 as string)"), "'\"2002\"'")))}
when 1 then {_object(("email", _text(_key('x', 's_suppkey', '@b.com'))), ("nserver", _text(_key('NS.b', 's_nationkey', '.com'))), ("phone", _text("concat('+', cast(s_suppkey as string))")))} else '{{}}' end as payload from supplier""")


@query("""select domain, case k % 3 when 2 then 'whois_empty' else 'python-whois' end as source, case k % 3 when 0 then s_name else '' end as registrant_name, case k % 3 when 0 then 'Org ' || n else '' end as registrant_org,
case k % 3 when 0 then 'a' || k || '@a.com' when 1 then 'x' || k || '@b.com' else '' end as registrant_email, case k % 3 when 1 then '+' || k else '' end as registrant_phone, case k % 3 when 0 then (2000 + k % 9)::varchar else '' end as creation_date,
case k % 3 when 0 then ['ns1.n' || n || '.com', 'ns2.n' || n || '.com'] when 1 then ['ns.b' || n || '.com'] else [] end as nameservers from v_legacy join supplier on s_suppkey = k""", "legacy")
def legacy_registrations(spark, sf_dir):
    return cap.legacy_registrations(read(spark, sf_dir, "legacy").select("domain", "payload")).drop("raw", "expiration_date")


given("dns", f"""select {_key('c', 'o_custkey', '.com')} as domain, case o_orderkey % 6 when 0 then 'A' when 1 then 'AAAA' when 2 then 'MX' when 3 then 'NS' when 4 then 'CNAME' else 'TXT' end as rtype,
case o_orderkey % 6 when 0 then concat('10.0.0.', cast(o_orderkey % 7 as string)) when 1 then concat('2A00::', cast(o_orderkey % 5 as string)) when 2 then concat(cast(o_orderkey % 3 * 10 as string), ' MX', cast(o_orderkey % 4 as string), '.a.com.') when 3 then concat(' ns', cast(o_orderkey % 4 as string), '.A.com. ') when 4 then 'C.b.com.' else concat('V=Spf1 ', o_orderstatus, ' .') end as value from orders""")


@query("""with v as (select domain, rtype, case rtype when 'TXT' then value else lower(regexp_replace(rtrim(trim(value), '.'), '^[0-9]+ ', '')) end as v from v_dns)
select domain, """ + ", ".join(f"coalesce(list_sort(list(distinct v) filter (rtype = '{k}')), []) as {k.lower()}_records" for k in ("A", "AAAA", "MX", "NS", "CNAME", "TXT")) + " from v group by 1", "dns")
def dns_records(spark, sf_dir):
    """Each customer's orders as the answers of a resolver."""
    return cap.dns_records(read(spark, sf_dir, "dns"))


# --- identifiers ------------------------------------------------------------------------------------

given("trackers", """select p_partkey as id, concat(case p_partkey % 5 when 0 then 'UA-' when 1 then 'GTM-' when 2 then 'ca-pub-' when 3 then 'G-' else 'zz-' end, case p_partkey % 7 when 0 then '11111' when 1 then 'TEST' when 2 then 'aaab' when 3 then 'XXXXX' else '' end, cast(p_partkey as string), case when p_partkey % 2 = 0 then '-1' else '' end) as v from part""")


@query("""select id, not regexp_matches(p, 'XXXXX|TEST|DEMO|SAMPLE') and len(list_distinct(string_split(p, ''))) > 2 as plausible,
case when starts_with(upper(v), 'CA-PUB-') then 0.95 when starts_with(upper(v), 'UA-') then 0.92 when starts_with(upper(v), 'GTM-') then 0.90 when starts_with(upper(v), 'G-') then 0.85 else 0.70 end::double as confidence
from (select *, replace(regexp_replace(upper(v), '^[^-]*-', ''), '-', '') as p from v_trackers)""", "trackers")
def tracker_values(spark, sf_dir):
    v = F.col("v")
    return read(spark, sf_dir, "trackers").select("id", dom.plausible_tracker(v).alias("plausible"), dom.tracker_confidence(v).alias("confidence"))


given("idents", """select c_custkey as id, case c_custkey % 6 when 0 then 'email' when 1 then 'phone' when 2 then 'ns' when 3 then 'tracker' when 4 then 'org' else 'name' end as kind,
case c_custkey % 6 when 0 then concat(' ', c_name, '@B.com ') when 1 then case when c_custkey % 4 = 1 then 'none' else concat('+1 (202) 555-', cast(c_custkey as string)) end when 2 then case when c_custkey % 4 = 0 then 'not a host' else concat('NS', cast(c_custkey as string), '.A.com.') end
when 3 then concat('ua-', cast(c_custkey as string), '-2') when 4 then concat('  ', c_mktsegment, '   INC ') else '' end as v from customer""")


@query("""select id, nullif(case kind when 'email' then lower(trim(v)) when 'phone' then regexp_replace(v, '[^0-9+]', '', 'g') when 'tracker' then upper(trim(v)) when 'ns' then case when contains(v, ' ') then null else rtrim(lower(v), '.') end else lower(trim(regexp_replace(v, ' +', ' ', 'g'))) end, '') as v from v_idents""", "idents")
def identifier_forms(spark, sf_dir):
    return read(spark, sf_dir, "idents").select("id", dom.normalized_identifier(F.col("kind"), F.col("v")).alias("v"))


# --- listings and searches --------------------------------------------------------------------------

given("listings", f"""select {_key('s', 's_suppkey', '.com')} as domain, s_suppkey as k, case s_suppkey % 5 when 1 then 'error: API limit reached' when 2 then 'error check your query' when 3 then ' ' else concat('*.', d, chr(10), 'WWW.', d, ',1.2.3.4', chr(10), 'mail', cast(s_nationkey as string), '.', d, chr(10), 'x.b.com', chr(10), 'www.', d, chr(10), 'a.', d, chr(10), d) end as payload from (select *, {_key('s', 's_suppkey', '.com')} as d from supplier) t""")


@query("""select domain, host, row_number() over (partition by domain order by len(host), host) as place from (select distinct domain, lower(string_split(h, ',')[1]) as host from (select domain, unnest(string_split(payload, chr(10))) as h from v_listings where not starts_with(payload, 'error')))
where (host = domain or ends_with(host, '.' || domain)) and not contains(host, '*') qualify place <= 2""", "listings")
def listed_hosts(spark, sf_dir):
    return cap.listed_hosts(read(spark, sf_dir, "listings").select("domain", "payload"), 2)


@query("select domain, case k % 5 when 1 then 'rate_limited' when 2 then 'error' when 3 then 'empty' else 'ok' end as state from v_listings", "listings")
def listing_states(spark, sf_dir):
    return read(spark, sf_dir, "listings").select("domain", cap.listing_state(F.col("payload")).alias("state"))


given("findings", f"""select {_key('c', 'c_custkey', '.com')} as domain, concat('{{"host": "x.', d, '", "source": "s2"}}', chr(10), '{{"host": "X.', d, '", "source": "s', cast(c_custkey % 3 as string), '"}}', chr(10), '{{"host": "', d, '"}}', chr(10), '{{"host": "not', d, '"}}', chr(10), 'no json', chr(10), '{{"host": "b', cast(c_nationkey as string), '.', d, '"}}', chr(10), '{{"host": "c.', d, '"}}') as payload from (select *, {_key('c', 'c_custkey', '.com')} as d from customer) t""")


@query("""select domain, host, list_sort(list(distinct source)) as sources from (select domain, lower(j->>'host') as host, coalesce(j->>'source', 'unknown') as source from (select domain, unnest(string_split(payload, chr(10))) as j from v_findings) where json_valid(j))
where ends_with(host, '.' || domain) group by 1, 2 qualify row_number() over (partition by domain order by host) <= 2""", "findings")
def found_hosts(spark, sf_dir):
    return cap.found_hosts(read(spark, sf_dir, "findings"), 2)


given("results", f"""select {_key('i', 'o_custkey')} as identifier, cast(o_orderkey % 14 as int) as ord, min(concat('see www.google.com and b', cast(o_orderkey % 5 as string), '.org, ', case when o_orderkey % 3 = 0 then 'reddit.com index.html' else concat('C', cast(o_orderkey % 7 as string), '.net') end, ' www.d', cast(o_custkey % 9 as string), '.com')) as text from orders group by 1, 2""")


@query("""with f as (select identifier, d, min(ord * 1000 + p) as m from (select identifier, ord, unnest(h) as d, generate_subscripts(h, 1) as p from (select identifier, ord, regexp_extract_all(lower(text), '([a-z0-9-]+\\.)+[a-z]{2,}') as h from (select * from v_results qualify row_number() over (partition by identifier order by ord) <= 10)))
where d not in ('www.google.com', 'reddit.com', 'index.html') group by 1, 2) select identifier, d as domain, row_number() over (partition by identifier order by m) as place from f qualify place <= 3""", "results")
def search_hits(spark, sf_dir):
    return cap.search_hits(read(spark, sf_dir, "results"), 3)


given("searches", """select c_custkey as k, case c_custkey % 8 when 0 then 'email' when 1 then 'org' when 2 then 'name' when 3 then 'ns' when 4 then 'phone' when 5 then 'tracker' when 6 then 'other' else 'org' end as id_type, case when c_custkey % 8 = 7 then ' ' else concat(' ', c_name, ' ') end as value from customer""")


@query("""select k, case when trim(value) = '' then null when id_type = 'other' then trim(value) else '"' || trim(value) || '"' || case id_type when 'org' then ' domain' when 'name' then ' domain' when 'ns' then ' nameserver' when 'phone' then ' whois' else '' end end as q from v_searches""", "searches")
def search_queries(spark, sf_dir):
    return read(spark, sf_dir, "searches").select("k", cap.search_query(F.col("id_type"), F.col("value")).alias("q"))


# --- paid lookups -----------------------------------------------------------------------------------

#: Answers that break the contract, each in its own way.
BROKEN = ('{"status": "1", "search_result": []}', '{"status": 2}', '{"status": 1, "search_result": {}}', '{"status": 1, "search_result": [1]}', '{"status": 1, "total_results": 0, "search_result": [{"domain_name": "a.com"}]}', '{"status": 1, "current_page": 2, "search_result": []}', '{"status": 1, "api_query": "other", "search_result": []}', "broken")
_FOUND = _object(("status", "'1'"), ("api_query", "'\"reverse_whois\"'"), ("total_results", "'4'"), ("current_page", "'1'"), ("search_result", _list(*[_object(("domain_name", _text(x))) for x in (_key("B", "c_custkey", ".com"), _key("a", "c_nationkey", ".com"), _key("b", "c_custkey", ".com"), "''")])))
given("paid", f"""select {_key('i', 'c_custkey')} as identifier, c_custkey as k, c_nationkey as n, case c_custkey % 6 when 1 then '{{"status": 0, "status_reason": "No Records found"}}' when 2 then '{{"status": 0, "status_reason": "Bad API key"}}' when 3 then '{{"status": 0, "status_reason": "Too many requests"}}' when 4 then '{{"status": 0}}'
when 5 then case c_custkey % {len(BROKEN)} {' '.join(f"when {i} then '{b}'" for i, b in enumerate(BROKEN))} end else {_FOUND} end as payload from customer""")


@query("select identifier, case k % 6 when 0 then 'ok' when 1 then 'empty' when 2 then 'auth_error' when 3 then 'rate_limited' when 4 then 'error' else 'malformed' end as state from v_paid", "paid")
def paid_states(spark, sf_dir):
    return cap.paid_lookups(read(spark, sf_dir, "paid").select("identifier", "payload"), 5)[0]


@query("select identifier, concat('b', k, '.com') as domain, 1::int as place from v_paid where k % 6 = 0 union all select identifier, concat('a', n, '.com'), 2 from v_paid where k % 6 = 0", "paid")
def paid_domains(spark, sf_dir):
    return cap.paid_lookups(read(spark, sf_dir, "paid").select("identifier", "payload"), 5)[1]


given("balances", f"""select {_key('s', 's_suppkey')} as account, s_suppkey as k, case s_suppkey % 3 when 0 then concat('{{"status": 1, "reverse_whois_balance": ', cast(s_suppkey as string), '}}') when 1 then '{{"status": 1, "reverse_whois_balance": -1}}' else '{{"status": 0, "status_reason": "out of credit"}}' end as payload from supplier""")


@query("select account, case k % 3 when 0 then 'ok' when 1 then 'malformed' else 'rate_limited' end as state, case when k % 3 = 0 then k end as remaining from v_balances", "balances")
def paid_balances(spark, sf_dir):
    return cap.paid_balances(read(spark, sf_dir, "balances").select("account", "payload"))


# --- archives, reports and registers ----------------------------------------------------------------

_DAY = "concat(cast(2000 + s_suppkey % 20 as string), '0101000000')"
_ROW = lambda at, url, mime, status, digest: _list(*[_text(x) for x in (at, url, mime, status, digest)])
given("archives", f"""select {_key('s', 's_suppkey', '.com')} as domain, s_suppkey as k, s_nationkey as n, case s_suppkey % 10 when 7 then '[["timestamp","original"],["20200101000000","u"]]' when 8 then '[]' when 9 then 'broken' else
{_list("'[\"timestamp\",\"original\",\"mimetype\",\"statuscode\",\"digest\"]'", _ROW(_DAY, _key('https://www.s', 's_suppkey', '.com/'), "'text/html'", "'200'", _key('d', 's_nationkey')), _ROW("'20210101000000'", _key('http://S', 's_suppkey', '.com/x'), "'TEXT/HTML; x'", "'200'", "'d2'"), _ROW("'20210201000000'", "'http://a.com/'", "'text/html'", "case when s_suppkey % 2 = 0 then '404' else '301' end", "'d3'"), _ROW("'20210301000000'", "'http://a.com/'", "'image/png'", "'200'", "'d4'"), "'[\"short\"]'", _ROW("'2022'", _key('http://sub.s', 's_suppkey', '.com/'), "'text/html'", "'200'", "'d5'"))} end as payload from supplier""")


@query("""with g as (select * from v_archives where k % 10 < 7) select domain, (2000 + k % 20) || '0101000000' as timestamp, 'https://www.s' || k || '.com/' as original, 'text/html' as mimetype, '200' as statuscode, 'd' || n as digest, make_timestamp(2000 + k % 20, 1, 1, 0, 0, 0) as captured_at from g
union all select domain, '20210101000000', 'http://S' || k || '.com/x', 'TEXT/HTML; x', '200', 'd2', timestamp '2021-01-01' from g union all select domain, '2022', 'http://sub.s' || k || '.com/', 'text/html', '200', 'd5', null from g""", "archives")
def archive_rows(spark, sf_dir):
    rows = cap.archive_rows(read(spark, sf_dir, "archives").select("domain", "payload"))
    return rows.withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz"))


@query("""with g as (select * from v_archives where k % 10 < 7), r as (select domain, k, (2000 + k % 20) || '0101000000' as t, make_timestamp(2000 + k % 20, 1, 1, 0, 0, 0) as ts, 'https://www.s' || k || '.com/' as o, 'd' || n as digest from g union all select domain, k, '20210101000000', timestamp '2021-01-01', 'http://S' || k || '.com/x', 'd2' from g)
select domain, ts as captured_at, o as original_url, 'https://web.archive.org/web/' || t || 'id_/' || o as archive_url, digest, 'Old & ' || domain as title, ['UA-' || (10000 + length(o)) || '-1'] as tracker_ids, '' as copyright_org from r""", "archives")
def snapshot_records(spark, sf_dir):
    """Records of the archived pages of each supplier's own hosts."""
    found = cap.archive_rows(read(spark, sf_dir, "archives").select("domain", "payload"))
    found = found.withColumn("html", F.concat(F.lit("<title>Old &amp; "), "domain", F.lit("</title> UA-"), (F.length("original") + 10000).cast("string"), F.lit("-1")))
    return cap.snapshot_records(found).withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz"))


#: Of each supplier's eight filings: form, items and whether the accession number is there, by its place.
_PLACES = range(8)
_PICK = lambda i, m, *texts: "case (s_suppkey + " + str(i) + f") % {m} " + " ".join(f"when {k} then '{t}'" for k, t in enumerate(texts)) + " end"
_FILED = {
    "form": [_PICK(i, 3, "8-K", "10-K", "8-K/A") for i in _PLACES],
    "items": [_PICK(i, 4, "2.01, 9.01", "1.01", "2.01", "12.01") for i in _PLACES],
    "accessionNumber": [f"case when (s_suppkey + {i}) % 5 = 0 then '' else concat('n', cast(s_suppkey as string), '-{i}') end" for i in _PLACES],
    "filingDate": ["'2020-01-01'" for _ in _PLACES],
    "primaryDocument": [f"'d{i}.htm'" for i in _PLACES],
}
given("submissions", "select cast(s_suppkey as string) as cik, s_suppkey as k, " + _object(("filings", _object(("recent", _object(*[(c, _list(*map(_text, v))) for c, v in _FILED.items()]))))) + " as payload from supplier")


@query("""select cik, i as pos, case (k + i) % 3 when 0 then '8-K' else '8-K/A' end as form, concat('n', k, '-', i) as accession, row_number() over (partition by cik order by i) as place from (select cik, k, unnest(range(0, 8)) as i from v_submissions)
where (k + i) % 3 <> 1 and (k + i) % 4 in (0, 2) and (k + i) % 5 <> 0 qualify place <= 3""", "submissions")
def filings(spark, sf_dir):
    f = cap.filings(read(spark, sf_dir, "submissions").select("cik", "payload"), most=3)
    return f.select("cik", F.col("pos").cast("long").alias("pos"), "form", F.col("accessionNumber").alias("accession"), "place")


given("reports", f"""select cast(s_suppkey as string) as cik, s_suppkey as k, place, {_key('n', 'place')} as accession, case place when 1 then concat('<p>Item one. On May 1 the Company completed the acquisition of Foo', cast(s_nationkey as string), ' Bar, Inc. for cash. The Company has acquired Own', cast(s_suppkey as string), ' Corp. for shares.</p>')
when 2 then concat('We acquired FOO', cast(s_nationkey as string), ' BAR, INC. in May.') when 3 then 'The company may acquire Baz LLC soon.' else concat('We agreed to acquire all of Qux', cast(s_suppkey as string), ' LLC. ', case when s_suppkey % 2 = 0 then 'It completed the Acquisition in June.' else 'It will close.' end) end as html from supplier, (values (1), (2), (3), (4)) p(place)""")
given("filers", "select cast(s_suppkey as string) as cik, concat('Own', cast(s_suppkey as string), ' Corp') as title from supplier")


@query("""select cik, 'Foo' || s_nationkey || ' Bar, Inc' as org, 'n1' as source_record_id, 'On May 1 the Company completed the acquisition of Foo' || s_nationkey || ' Bar, Inc. for cash.' as supporting_text from v_reports join supplier on s_suppkey = k where place = 1
union all select cik, 'Qux' || k || ' LLC', 'n4', 'We agreed to acquire all of Qux' || k || ' LLC. completed the Acquisition' from v_reports where place = 4 and k % 2 = 0""", "reports")
def filed_purchases(spark, sf_dir):
    """Four reports of each supplier: a purchase, told again, by the filer itself, one that may come, one agreed and closed in half of the cases; with what supports each."""
    r = read(spark, sf_dir, "reports").withColumnRenamed("accession", "accessionNumber").drop("k")
    return cap.purchases_in_filings(r, read(spark, sf_dir, "filers"))


_NAMED = _object(("legalName", _object(("name", _text(_key("Acme ", "s_suppkey", ", Inc.'".replace("'", "")))))), ("otherNames", _list(_object(("name", _text(_key("Twin-", "s_nationkey")))))), ("transliteratedOtherNames", "'[]'"), ("status", _text("case when s_suppkey % 5 = 0 then 'INACTIVE' else 'ACTIVE' end")))
given("register", "select s_suppkey as k, s_nationkey as n, " + _object(("id", _text(_key("L", "s_suppkey"))), ("attributes", _object(("entity", _NAMED), ("registration", _object(("status", _text("case when s_suppkey % 7 = 0 then 'LAPSED' else 'ISSUED' end"))))))) + " as payload from supplier")
given("names", f"select {_key('ACME-', 's_suppkey', '  inc')} as name from supplier union all select {_key('twin ', 'n_nationkey')} from nation union all select 'nobody' from region")


@query("""with e as (select *, 'L' || k as id from v_register where k % 5 <> 0 and k % 7 <> 0), t as (select n, min(id) as id, count(*) as c from e group by 1)
select 'ACME-' || k || '  inc' as name, id from e union all select 'twin ' || n, id from t where c = 1""", "register")
def exact_names(spark, sf_dir):
    """Suppliers' names in the register, each unique, and names that all suppliers of a nation share."""
    return cap.exact_names(read(spark, sf_dir, "names"), cap.register_entities(read(spark, sf_dir, "register").select("payload")))


_ENTITY = lambda id_, name: _object(("id", _text(id_)), ("attributes", _object(("entity", _object(("legalName", _object(("name", _text(name)))))))))
given("relations", f"""select {_key('L', 'c_custkey')} as lei, c_custkey as k, c_nationkey as n, relation, case when c_custkey % 6 = 5 then '{{}}' when relation = 'direct_accounting_parent' then {_object(("data", _ENTITY(_key("P", "c_nationkey"), _key("Top ", "c_nationkey"))))}
else {_object(("data", _list(_ENTITY(_key("C", "c_custkey + 1"), "'One'"), _ENTITY(_key("C", "c_custkey + 2"), "'Two'"), _ENTITY(_key("C", "c_custkey + 1"), "'Again'"), _ENTITY("''", "'None'"))))} end as payload from customer, (values ('direct_accounting_parent'), ('direct_accounting_child')) r(relation)""")


@query("""select lei, relation, 'P' || n as target, 'Top ' || n as org, lei || ':direct_accounting_parent:P' || n as source_record_id from v_relations where k % 6 <> 5 and relation = 'direct_accounting_parent'
union all select lei, relation, 'C' || (k + 1), 'One', lei || ':direct_accounting_child:C' || (k + 1) from v_relations where k % 6 <> 5 and relation = 'direct_accounting_child'""", "relations")
def hierarchy(spark, sf_dir):
    """Each customer's parent and children in the register, two relations at most."""
    return cap.hierarchy(read(spark, sf_dir, "relations").select("lei", "relation", "payload"), 2)


_CLAIM = lambda v: _object(("mainsnak", _object(("datavalue", _object(("value", v))))))
_TO = lambda x: _CLAIM(_object(("id", _text(x))))
given("wiki", f"""select {_key('Q', 's_suppkey')} as id, s_suppkey as k, {_object(("labels", _object(("en", _object(("value", _text("s_name"))))))
    , ("claims", _object(("P355", _list(_TO(_key("Q", "s_suppkey + 1")), _TO(_key("Q", "s_suppkey + 2")), _TO(_key("Q", "s_suppkey + 1")))), ("P127", _list(_TO(_key("X", "s_nationkey")), _TO(_key("Q", "s_suppkey + 1")))), ("P856", "case when s_suppkey % 3 = 0 then " + _list(_CLAIM("'\"not a url\"'"), _CLAIM(_text(_key("https://www.w", "s_suppkey", ".co.uk/x")))) + " else '[]' end"))))} as payload from supplier""")


@query("""with s as (select s_suppkey as k, s_name as name, s_nationkey as n from supplier), r as (select k, name, 'subsidiary' as relation, k + 1 as t from s union all select k, name, 'subsidiary', k + 2 from s)
select r.name as org, relation, coalesce(s.name, 'Q' || t) as target, case when s.k % 3 = 0 then 'w' || s.k || '.co.uk' else '' end as domain from r left join s on s.k = t union all select name, 'owned_by', 'X' || n, '' from s""")
def related_entities(spark, sf_dir):
    """Each supplier as an entity with two subsidiaries, one of them named twice, and an owner without an entry."""
    return cap.related(*cap.entities_of(read(spark, sf_dir, "wiki").select("id", "payload")))


# --- pages ------------------------------------------------------------------------------------------

given("shops", f"""select {_key('my-shop', 'p_partkey', '.com')} as domain, p_partkey as k, p_name as name, case when p_partkey % 9 = 8 then cast(null as string) else concat('<title>', p_name, ' &amp;  Co &lt;shop&gt;</title><meta name="description" content="All &quot;', p_brand, '&quot;"> UA-', cast(10000 + p_partkey as string), '-1 ua GTM-ABCD', cast(p_partkey as string), ' UA-00000-1 G-XXXXX123 &copy; 2019-2021 Acme', cast(p_partkey % 50 as string), ' Widgets, All Rights Reserved') end as html,
case p_partkey % 3 when 0 then concat('https://www.other', cast(p_partkey as string), '.co.uk/x') when 1 then concat('http://my-shop', cast(p_partkey as string), '.com/') else '' end as final_url, case when p_partkey % 4 = 0 then concat('<p>This website is operated by Acme', cast(p_partkey as string), ' &amp; Sons Ltd. Legal name: ACME', cast(p_partkey as string), ' &amp; SONS LTD, or</p>') end as legal_html from part""")

# A tracker of two digits alone is a placeholder.
_SHOP = "s as (select v.*, p_brand as brand, k % 9 = 8 as gone, len(list_distinct(string_split(concat(10000 + k, '1'), ''))) > 2 as own from v_shops v join part on p_partkey = k)"


@query(f"""with {_SHOP} select domain, case when gone then '' else name || ' & Co <shop>' end as title, case when gone then '' else 'All "' || brand || '"' end as description, ['My Shop' || k] as aliases, case when gone then [] when own then ['GTM-ABCD' || k, 'UA-' || (10000 + k) || '-1'] else ['GTM-ABCD' || k] end as tracker_ids,
case when gone then '' else 'Acme' || (k % 50) || ' Widgets' end as copyright_org, final_url, case when k % 3 = 0 then 'other' || k || '.co.uk' else '' end as redirect_domain, case when k % 4 = 0 then ['Acme' || k || ' & Sons Ltd'] else [] end as legal_entities from s""", "shops")
def page_records(spark, sf_dir):
    """Trackers come whole: those of keys above a million are longer than a real one's."""
    return pg.page_records(read(spark, sf_dir, "shops").select("domain", "html", "final_url", "legal_html"), whole=True)


@query(f"""with {_SHOP} select domain, 'org' as id_type, 'My Shop' || k as value, 0.45::double as score from s union all select domain, 'org', 'acme' || (k % 50) || ' widgets', 0.7 from s where not gone union all select domain, 'org', 'acme' || k || ' & sons ltd', 0.85 from s where k % 4 = 0
union all select domain, 'tracker', 'UA-' || (10000 + k) || '-1', 0.92 from s where not gone and own union all select domain, 'tracker', 'GTM-ABCD' || k, 0.9 from s where not gone""", "shops")
def page_pivots(spark, sf_dir):
    from ..operators import extract as ex

    return ex.page_pivots(pg.page_records(read(spark, sf_dir, "shops").select("domain", "html", "final_url", "legal_html"), whole=True)).select("domain", "id_type", "value", "score")


given("anchors", """select c_custkey as k, concat('https://', case when c_custkey % 2 = 0 then 'www.' else '' end, 'c', cast(c_custkey as string), '.co.uk/x/y') as base, concat('<a href="/Privacy-Policy?id=', cast(c_nationkey as string), '#top">p</a><a href="https://b.com/legal">o</a>', case when c_custkey % 3 = 0 then '' else concat('<a href="https://shop.c', cast(c_custkey as string), '.co.uk/imprint?x=1">i</a>') end, ' <a href="terms.html">t</a><a href="mailto:x">m</a><a href="../about/">a</a>') as html from customer""")


@query("""select k, list_sort([regexp_replace(base, '/x/y$', '') || '/Privacy-Policy?id=' || c_nationkey, case when k % 3 = 0 then regexp_replace(base, '/y$', '') || '/terms.html' else 'https://shop.c' || k || '.co.uk/imprint?x=1' end]) as links from v_anchors join customer on c_custkey = k""", "anchors")
def legal_links(spark, sf_dir):
    return read(spark, sf_dir, "anchors").select("k", F.array_sort(pg.legal_links(F.col("html"), F.col("base"))).alias("links"))


# --- expansion --------------------------------------------------------------------------------------

given("chosen", f"""select {_key('c', 'c_custkey', '.com')} as domain, id_type, case id_type when 'email' then {_key('m', 'c_custkey', '@a.com')} when 'tracker' then {_key('UA-', 'c_custkey + 20000', '-1')} when 'org' then {_key('acme', 'c_nationkey')} else {_key('+1', 'c_custkey')} end as value, cast(0.6 + c_custkey % 4 * 0.1 as double) as score, cast(c_custkey % 2 as int) as depth, c_custkey as k from customer, (values ('email'), ('tracker'), ('org'), ('phone')) t(id_type)""")
given("candidates", f"""select id_type, case id_type when 'email' then {_key('m', 'c_custkey', '@a.com')} when 'tracker' then {_key('UA-', 'c_custkey + 20000', '-1')} else {_key('acme', 'c_custkey % 25')} end as value, ord, case ord when 1 then {_key('www.d', 'c_custkey', '.com')} when 2 then {_key('d', 'c_custkey', '.com')} when 3 then {_key('c', 'c_custkey', '.com')} when 4 then 'google.com' when 5 then 'printer.lan' else {_key('late', 'c_custkey', '.com')} end as candidate from customer, (values ('email'), ('tracker'), ('org')) t(id_type), (values (1), (2), (3), (4), (5), (6)) o(ord)""")
given("tracked", f"select {_key('d', 'c_custkey', '.com')} as domain, concat('x UA-', cast(case when c_custkey % 3 = 0 then c_custkey + 20000 else c_custkey + 20001 end as string), '-1 y') as html from customer")


@query("""select domain, 'd' || k || '.com' as child, 'related_domain_via_identifier' as relation_type, score as confidence, 1 as depth, id_type, id_type = 'tracker' as verified from v_chosen where k % 2 = 0 and (id_type = 'email' or id_type = 'tracker' and k % 3 = 0 and len(list_distinct(string_split(concat(k + 20000, '1'), ''))) > 2)""", "chosen")
def reverse_expansion(spark, sf_dir):
    """Each customer's mail, tracker, organization and phone: half of them lie at the depth cap, organizations aren't searched, phones find nothing, two of three trackers aren't on the page."""
    found = di.reverse_links(read(spark, sf_dir, "chosen").drop("k"), read(spark, sf_dir, "candidates"), read(spark, sf_dir, "tracked"), depth_cap=1, per_identifier=5)
    return found.drop("source", "enqueue", "value")


given("owners", f"""select case n_nationkey % 3 when 0 then 'gleif' when 1 then 'wikidata' else 'sec-edgar' end as source, {_key('acme', 'n_nationkey')} as name, case n_nationkey % 2 when 0 then 'owns' else 'acquired' end as relation, n_name as org, case n_nationkey % 4 when 0 then '' when 1 then {_key('www.o', 'n_nationkey', '.co.uk')} when 2 then {_key('x.o', 'n_nationkey', '.com')} else 'google.com' end as domain, {_key('q', 'n_nationkey')} as record, n_nationkey as n from nation""")


@query("""with f as (select value, min(depth) as depth, arg_min(domain, (depth, domain)) as domain from v_chosen where id_type = 'org' group by 1)
select f.domain, case n % 4 when 1 then 'o' || n || '.co.uk' else 'o' || n || '.com' end as child, 'acquisition_' || relation as relation_type, source, 0.9::double as confidence, depth + 1 as depth, false as enqueue from f join v_owners on name = value where n % 4 in (1, 2) and n % 3 <> 2""", "chosen", "owners")
def corporate_expansion(spark, sf_dir):
    """Organizations that the customers of a nation share, each followed once, at the depth cap; those of one source were followed before."""
    owners = read(spark, sf_dir, "owners").drop("n")
    return di.corporate_links(read(spark, sf_dir, "chosen").drop("k"), owners, owners.where("source = 'sec-edgar'").select("source", "name"), depth_cap=0)[0]


@query("""select 'organization' as subject_type, name as subject_value_norm, relation as predicate, case when domain = '' then 'organization' else 'domain' end as object_type, case n % 4 when 0 then org when 1 then 'o' || n || '.co.uk' else 'o' || n || '.com' end as object_value_norm, source, record as source_record_id,
case when domain <> '' then 0.9 when source in ('gleif', 'sec-edgar') then 0.95 else 0.8 end::double as confidence from v_owners where n % 4 <> 3""", "owners")
def corporate_facts(spark, sf_dir):
    return di.corporate_facts(read(spark, sf_dir, "owners").drop("n"))


# --- ledger -----------------------------------------------------------------------------------------

given("links", "select l_orderkey as claim_id, concat('o', cast(l_partkey % 50 as string)) as observation_id, case l_linenumber % 5 when 4 then 'maybe' when 3 then 'contradicts' else 'supports' end as polarity, cast(l_discount * 12 as double) as weight, case when l_suppkey % 9 = 0 then ' ' else l_returnflag end as reason, '2024-01-01' as created_at, l_orderkey * 10 + l_linenumber as seq from lineitem")


@query("""select claim_id, observation_id, polarity, arg_min(weight, (seq, weight, reason))::double as weight, arg_min(reason, (seq, weight, reason)) as reason from v_links l where polarity in ('supports', 'contradicts') and weight between 0 and 1 and trim(reason) <> '' and not (claim_id % 5 = 0 and polarity = 'supports') group by 1, 2, 3""", "links")
def new_evidence_links(spark, sf_dir):
    """Every line as a link of evidence; the supporting ones of a fifth of the claims are stored already."""
    links = read(spark, sf_dir, "links")
    stored = links.where("claim_id % 5 = 0 and polarity = 'supports'").select("claim_id", "observation_id", "polarity").distinct()
    return le.evidence_links(links, stored)[0].drop("created_at", "seq")


@query("select seq, case when polarity = 'maybe' then 'polarity' when weight > 1 then 'weight' else 'reason' end as problem from v_links where polarity = 'maybe' or weight > 1 or trim(reason) = ''", "links")
def refused_evidence_links(spark, sf_dir):
    return le.evidence_links(read(spark, sf_dir, "links"))[1].select("seq", "problem")


given("creations", "select concat('r', cast(o_custkey % 20 as string)) as run_id, case o_orderkey % 2 when 0 then 'domain' else 'ip' end as node_type, concat('v', cast(o_custkey % 90 as string)) as value_norm, o_orderkey as seq, 'by' as k, o_orderpriority as v from orders")


@query("select run_id, node_type, value_norm, sha256(concat_ws(chr(31), run_id, node_type, value_norm)) as node_id, sha256(value_norm) as value_hash, arg_min('{\"' || k || '\":\"' || v || '\"}', seq) as metadata from v_creations group by 1, 2, 3", "creations")
def created_nodes(spark, sf_dir):
    made = read(spark, sf_dir, "creations").withColumn("metadata", F.create_map("k", "v")).drop("k", "v")
    return le.nodes(made).withColumn("metadata", F.to_json("metadata"))


given("cache", f"select {_key('c', 'c_custkey')} as domain, c_name as children, concat('2024-01-', lpad(cast(c_custkey % 28 + 1 as string), 2, '0')) as stamp from customer")
given("refreshed", f"select {_key('c', 'o_custkey + o_orderkey % 2 * 100000')} as domain, o_orderpriority as children, concat('2024-01-', lpad(cast(o_orderkey % 28 + 1 as string), 2, '0'), ' ', cast(o_orderkey as string)) as stamp from orders")


@query("select domain, arg_max(children, stamp) as children, max(stamp) as stamp from (select * from v_cache union all select * from v_refreshed) group by 1", "cache", "refreshed")
def refreshed_cache(spark, sf_dir):
    return le.upserted(read(spark, sf_dir, "cache"), read(spark, sf_dir, "refreshed"), ["domain"], "stamp")


# --- what may be asked ------------------------------------------------------------------------------

given("urls", """select k, case kind when 0 then concat('https://a', t, '.com/x') when 1 then concat('HTTP://a', t, '.com:80', cast(k % 100 as string), '/') when 2 then concat('ftp://a', t, '.com') when 3 then 'https:///x' when 4 then concat('https://u', t, ':p@a.com/') when 5 then concat('https://a.com:', cast(k % 2 * 99999 as string), '/') when 6 then concat('https://10.0.', cast(k % 256 as string), '.1/')
when 7 then concat('https://[::ffff:10.0.0.', cast(k % 256 as string), ']/') when 8 then concat('https://[2606:4700::', lower(hex(k % 65536)), ']/') when 9 then concat('https://a.com/', repeat('x', cast(4000 + k % 200 as int))) else concat('https://a', t, '.internal/') end as u, kind from (select c_custkey as k, cast(c_custkey as string) as t, c_custkey % 11 as kind from customer) c""")


@query("select k, case when kind = 2 then 'scheme' when kind = 3 then 'host' when kind = 4 then 'credentials' when kind = 5 then 'port' when kind in (6, 7, 10) then 'target' when kind = 9 and 14 + 4000 + k % 200 > 4096 then 'length' end as refusal from v_urls", "urls")
def url_refusals(spark, sf_dir):
    return read(spark, sf_dir, "urls").select("k", sec.url_refusal(F.col("u")).alias("refusal"))


given("models", """select c_custkey as k, c_custkey % 7 as kind, case c_custkey % 7 when 0 then ' ' when 1 then concat('qwen', t) when 2 then concat('Ollama/x', t) when 3 then concat('gpt-', t) when 4 then concat('Claude-', t) when 5 then concat('OpenAI/y', t) else concat('own/z', t) end as m from (select *, cast(c_custkey as string) as t from customer) c""")


@query("select k, case kind when 0 then 'ollama/qwen2.5:7b-instruct' when 1 then 'ollama/' || m when 4 then 'anthropic/' || m when 6 then 'ollama/' || m else m end as id, kind in (2, 3, 4, 5) as cloud from v_models", "models")
def model_names(spark, sf_dir):
    return read(spark, sf_dir, "models").select("k", sec.model_id(F.col("m")).alias("id"), sec.is_cloud(F.col("m")).alias("cloud"))


# --- observations -----------------------------------------------------------------------------------

given("facts", f"""select 'r' as run_id, {_key('o', 'o_orderkey')} as observation_id, o_orderkey as k, o_custkey as c, 'domain' as subject_type, {_key('c', 'o_custkey', '.com')} as subject_value_norm, case o_orderkey % 7 when 0 then 'resolves_to' when 1 then 'has_mx' when 2 then 'redirects_to_domain' when 3 then 'has_registrant_email' when 4 then 'has_subdomain' when 5 then 'redirects_to_domain' else 'publishes_txt' end as predicate, 'x' as object_type,
case o_orderkey % 7 when 0 then case when o_orderkey % 2 = 0 then concat('1.2.3.', cast(o_orderkey % 200 as string)) else concat('2a00::', cast(o_orderkey % 99 as string)) end when 1 then {_key('mx', 'o_orderkey % 5', '.a.com')} when 2 then {_key('www.b', 'o_orderkey', '.co.uk')} when 3 then {_key('M', 'o_custkey', '@a.com')} when 4 then {_key('h', 'o_orderkey % 3', '.')} when 5 then 'printer.lan' else 'v' end as object_value_norm,
case o_orderkey % 3 when 0 then 'stdlib' when 1 then 'http-html' else 'crtsh' end as source, cast(o_orderdate as string) as observed_at, cast(o_orderkey % 9 * 0.125 as double) as confidence, case when o_orderkey % 7 in (0, 1) then 'dns' else 'whois' end as capability from orders""")


def _facts(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "facts")


@query("""select subject_value_norm as domain, case k % 7 when 0 then 'ip' when 1 then 'mx' else 'domain' end as node_type, case when k % 7 = 2 then 'b' || k || '.co.uk' else object_value_norm end as value, case k % 7 when 0 then 'domain_has_ip' when 1 then 'domain_has_mx' else 'domain_redirects_to' end as relation_type, source, confidence,
case when k % 7 = 0 then case when k % 2 = 0 then 'v4' else 'v6' end end as ip_version from v_facts where k % 7 < 3""", "facts")
def infrastructure(spark, sf_dir):
    """Orders as facts of the customers' domains; redirects to an inner host count for nothing."""
    return di.infrastructure(_facts(spark, sf_dir))


@query("""select p.domain, id_type, value, observation_id, coalesce(source, 'relationship_engine') as source, coalesce(confidence, score) as weight, row_number() over (partition by p.domain, id_type, value order by confidence desc, observed_at, observation_id) = 1 as "primary"
from v_chosen p left join v_facts f on f.subject_value_norm = p.domain and lower(f.object_value_norm) = lower(p.value)""", "chosen", "facts")
def pivot_evidence(spark, sf_dir):
    return di.pivot_evidence(read(spark, sf_dir, "chosen").drop("k"), _facts(spark, sf_dir))


given("wanted", f"select 'r' as run_id, {_key('c', 'c_custkey', '.com')} as subject_value_norm, case c_custkey % 3 when 0 then {_key('m', 'c_custkey', '@A.com')} when 1 then 'V' else 'Printer.LAN' end as object_value_norm from customer")


@query("""select w.subject_value_norm as subject, w.object_value_norm as asked, observation_id, row_number() over (partition by w.subject_value_norm, w.object_value_norm order by confidence desc, observed_at, observation_id) as place from v_wanted w join v_facts f on f.run_id = w.run_id and f.subject_value_norm = w.subject_value_norm and lower(f.object_value_norm) = lower(w.object_value_norm)""", "wanted", "facts")
def observations_of_objects(spark, sf_dir):
    return le.observations_for(read(spark, sf_dir, "wanted"), _facts(spark, sf_dir)).select(F.col("subject_value_norm").alias("subject"), "asked", "observation_id", "place")


given("told", f"select o_custkey as claim_id, {_key('o', 'o_orderkey')} as observation_id, case when o_orderkey % 4 = 0 then 'contradicts' else 'supports' end as polarity, cast(o_orderdate as string) as created_at from orders")


@query("""select claim_id, observation_id, polarity, source, case source when 'stdlib' then 'authoritative-dns' when 'http-html' then 'current-origin-web' else 'certificate-transparency' end as source_family, row_number() over (partition by claim_id order by polarity, created_at, observation_id)::int as place from v_told join v_facts using (observation_id) where claim_id % 2 = 0""", "told", "facts")
def evidence_of_claims(spark, sf_dir):
    """The customers' orders as evidence of claims, every second of which is asked for."""
    links = read(spark, sf_dir, "told")
    claims = links.select("claim_id").distinct().where("claim_id % 2 = 0")
    return le.evidence_of_claims(claims, links, _facts(spark, sf_dir)).select("claim_id", "observation_id", "polarity", "source", "source_family", "place")


given("subs", f"select {_key('c', 'c_custkey', '.com')} as domain, case c_custkey % 4 when 0 then {_key('H0.c', 'c_custkey', '.com.')} when 1 then {_key('c', 'c_custkey', '.com')} when 2 then {_key('nowhere.c', 'c_custkey', '.com')} else 'not a host' end as host, c_custkey as k from customer")
given("seen", f"select concat(observation_id, 's') as observation_id, c, subject_value_norm, 'has_subdomain' as predicate, concat('h0.', subject_value_norm) as object_value_norm, source, confidence, observed_at, k as seq from ({GIVEN['facts']}) f where k % 7 = 4")


@query("""select subject_value_norm as domain, object_value_norm as host, observation_id, source, row_number() over (partition by subject_value_norm order by seq) = 1 as "primary" from v_seen where c % 4 = 0""", "seen")
def subdomain_evidence(spark, sf_dir):
    """One host of each customer, spelled otherwise, absent, the domain itself, or none, with the facts that name it."""
    return di.subdomain_evidence(read(spark, sf_dir, "subs").drop("k"), read(spark, sf_dir, "seen"))


given("cached", f"""select {_key('c', 'c_custkey', '.com')} as domain, c_custkey as k, case c_custkey % 6 when 0 then {_key('b', 'c_custkey', '.com')} when 1 then {_key('www.d', 'c_custkey', '.com')} when 2 then {_key('e', 'c_custkey', '.com')} when 3 then 'localhost' when 4 then ' ' else '::ffff:10.0.0.1' end as child, cast(c_custkey % 8 * 0.125 as double) as confidence, case c_custkey % 6 when 0 then 'email' when 2 then 'org' else '' end as id_type, case c_custkey % 6 when 0 then 'ann@a.com' when 2 then 'acme' else '' end as id_value,
case c_custkey % 6 when 0 then 'whoxy' when 2 then 'gleif' else '' end as source, case when c_custkey % 6 = 2 then 'acquisition_owns' else '' end as relation_type from customer""")


@query("""select domain, child, case when relation_type <> '' then relation_type when id_value <> '' then 'related_domain_via_identifier' else 'related_domain' end as relation_type, case source when '' then 'legacy_cache' else source end as source, confidence, k % 2 + 1 as depth, k % 2 + 1 <= 1 as enqueue,
case when relation_type = '' and id_value <> '' then id_value end as via, case when relation_type = '' and id_value <> '' then id_type end as id_type from v_cached where k % 6 < 3 and k % 5 <> 0""", "cached")
def cache_replay(spark, sf_dir):
    """Cached children of the customers' domains, four of five of which are at the front, half of them at the depth cap."""
    cached = read(spark, sf_dir, "cached")
    front = cached.where("k % 5 <> 0").select("domain", (F.col("k") % 2).cast("int").alias("depth"))
    return di.replayed(front, cached.drop("k"), depth_cap=1).withColumn("depth", F.col("depth").cast("long"))


# --- pivots and models ------------------------------------------------------------------------------

given("whois", f"""select {_key('c', 'c_custkey', '.com')} as domain, c_custkey as k, case when c_custkey % 4 = 3 then 'Tech Contact: Ann' else {_object(("a", "concat('\"Registrant Organization: ', c_mktsegment, '  Inc', cast(c_custkey as string), '\"')"), ("b", _list("concat('\"mail a', cast(c_custkey as string), '@acme.com\"')", "'\"abuse@acme.com\"'", "7")), ("c", "concat('\"Name Server: ns', cast(c_custkey as string), '.acme.com\"')"))} end as raw,
'' as registrant_name, '' as registrant_org, case when c_custkey % 2 = 0 then {_key('Boss', 'c_custkey', '@acme.com')} else '' end as registrant_email, case when c_custkey % 3 = 0 then concat('+1.202', cast(c_custkey + 1000000 as string)) else '' end as registrant_phone from customer""")


@query("""with w as (select *, k % 4 = 3 as plain from v_whois) select domain, 'email' as id_type, 'boss' || k || '@acme.com' as value, 0.8::double as score from w where k % 2 = 0 union all select domain, 'email', 'a' || k || '@acme.com', 0.8 from w where not plain union all select domain, 'phone', '+1202' || (k + 1000000), 0.6 from w where k % 3 = 0
union all select domain, 'ns', 'ns' || k || '.acme.com', 0.65 from w where not plain union all select domain, 'name', 'ns' || k || '.acme.com', 0.65 from w where not plain union all select domain, 'org', lower(c_mktsegment) || ' inc' || k, 0.75 from w join customer on c_custkey = k where not plain union all select domain, 'name', 'ann', 0.65 from w where plain""", "whois")
def registration_pivots(spark, sf_dir):
    from ..operators import extract as ex

    w = read(spark, sf_dir, "whois").drop("k").withColumn("nameservers", F.array(F.lit("ns9.acme.com")))
    return ex.registration_pivots(w).select("domain", "id_type", "value", "score")


_PIVOT = lambda score: _object(("id_type", "'\"org\"'"), ("value", _text("c_name")), ("score", score), ("reason", "'\"r\"'"))
_OUTPUT = lambda abstain, why, pivots, *more: _object(("abstain", abstain), ("abstention_reason", why), ("pivots", pivots), *more)
_OUTPUTS = {
    "accepted": _OUTPUT("'false'", "'null'", _list(_PIVOT("cast(round(c_custkey % 100 / 100e0, 2) as string)"))),
    "abstained": _OUTPUT("'true'", "'\"nothing\"'", "'[]'"),
    "invalid": _OUTPUT("'true'", "'\"x\"'", _list(_PIVOT("'0.5'"))),
    "invalid 2": _OUTPUT("'false'", "'null'", "'[]'"),
    "invalid 3": _OUTPUT("'false'", "'null'", _list(_PIVOT("'2'"))),
    "invalid 4": _OUTPUT("'false'", "'null'", "'[]'", ("z", "'1'")),
    "invalid 5": "'no json'",
    "invalid 6": _OUTPUT("'\"false\"'", "'null'", _list(_PIVOT("'0.5'"))),
}
given("outputs", f"select {_key('c', 'c_custkey', '.com')} as domain, c_custkey as k, case c_custkey % {len(_OUTPUTS)} " + " ".join(f"when {i} then {text}" for i, text in enumerate(_OUTPUTS.values())) + " end as content from customer")


@query(f"select domain, case k % {len(_OUTPUTS)} when 0 then 'accepted' when 1 then 'abstained' else 'invalid' end as disposition from v_outputs", "outputs")
def model_outputs(spark, sf_dir):
    from ..operators import models as mo

    return mo.validated(read(spark, sf_dir, "outputs").drop("k")).select("domain", "disposition")


@query(f"select domain, case when k % 100 >= 75 then 'fast' else 'primary' end as route from v_outputs where k % {len(_OUTPUTS)} = 0", "outputs")
def routed_outputs(spark, sf_dir):
    """The fast model's outputs and, from a table of its own, the primary model's for the same domains: accepted ones of at least 0.75 are kept, the others come from the primary."""
    from ..operators import models as mo

    o = read(spark, sf_dir, "outputs").drop("k")
    primary = o.withColumn("content", F.regexp_replace("content", '"reason": "r"', '"reason": "primary"'))
    return mo.routed(mo.validated(o), mo.validated(primary)).select("domain", "route")


# --- hosts and texts --------------------------------------------------------------------------------

given("heard", f"select c_custkey as k, case c_custkey % 7 when 0 then 'google.com' when 1 then {_key('www', 'c_custkey', '.google.com')} when 2 then {_key('a', 'c_custkey', '.com')} when 3 then {_key('index', 'c_custkey', '.html')} when 4 then 'localhost' when 5 then {_key('sub', 'c_custkey', '.godaddy.com')} else {_key('xgoogle', 'c_custkey', '.ORG.')} end as d from customer")


@query("select k, k % 7 not in (2, 6) as noise from v_heard", "heard")
def noise_domains(spark, sf_dir):
    return read(spark, sf_dir, "heard").select("k", dom.noise_domain(F.col("d")).alias("noise"))


given("markup", "select p_partkey as k, p_name as name, concat('<script>x < ', cast(p_partkey as string), '</script><p>', p_name, ' &amp; ', p_brand, '</p><style>p {}</style> &#169;  <b>C', cast(p_size as string), '</b>') as html from part")


@query("select k, name || ' & ' || p_brand || ' © C' || p_size as t from v_markup join part on p_partkey = k", "markup")
def plain_texts(spark, sf_dir):
    return read(spark, sf_dir, "markup").select("k", pg.plain_text(F.col("html")).alias("t"))


given("asked_trackers", f"select {_key('my-shop', 'p_partkey', '.com')} as domain, p_partkey as k, case p_partkey % 3 when 0 then {_key('ua-', 'p_partkey + 10000', '-1')} when 1 then {_key('UA-', 'p_partkey + 10001', '-1')} else 'G-XXXXX123' end as tracker_id from part")


@query(f"with {_SHOP} select a.domain, upper(tracker_id) as tracker_id from v_asked_trackers a join s using (k) where k % 3 = 0 and own and not gone", "asked_trackers", "shops")
def verified_trackers(spark, sf_dir):
    return pg.verified_trackers(read(spark, sf_dir, "asked_trackers").drop("k"), read(spark, sf_dir, "shops").select("domain", "html"))


given("mails", f"select c_custkey as k, case c_custkey % 10 when 5 then 'ns' when 6 then 'ns' when 7 then 'zip' when 8 then 'org' when 9 then 'org' else 'email' end as kind, case c_custkey % 10 when 0 then 'a@markmonitor.com' when 1 then {_key('a@x', 'c_custkey', '.markmonitor.com')} when 2 then {_key('abuse@a', 'c_custkey', '.com')} when 3 then {_key('ann', 'c_custkey', '@a.com')} when 4 then 'a@notmarkmonitor.org' when 5 then {_key('ns', 'c_custkey', '.cloudflare.com')} when 6 then {_key('ns', 'c_custkey', '.a.com')} when 8 then ' ' else c_name end as value, cast(case when c_custkey % 4 = 1 then 1.5 else 0.5 end as double) as score from customer")


@query("select k, k % 10 < 2 as registrar, k % 4 <> 1 and k % 10 in (3, 4, 6, 9) as good from v_mails", "mails")
def pivot_values(spark, sf_dir):
    m = read(spark, sf_dir, "mails")
    own = F.coalesce((F.col("kind") == "email") & dom.registrar_mail(F.col("value")), F.lit(False))
    return m.select("k", own.alias("registrar"), dom.valid_pivot(F.col("kind"), F.col("value"), F.col("score")).alias("good"))


given("targets", f"select c_custkey as k, case c_custkey % 9 when 0 then {_key('a', 'c_custkey', '.com')} when 1 then 'LOCALHOST' when 2 then {_key('x', 'c_custkey', '.internal')} when 3 then 'METADATA.google.internal' when 4 then concat('8.8.', cast(c_custkey % 256 as string), '.8') when 5 then concat('10.1.', cast(c_custkey % 256 as string), '.3') when 6 then {_key('printer', 'c_custkey', '.lan.')} when 7 then ' ' else {_key('internal', 'c_custkey', '.example')} end as h from customer")


@query("select k, k % 9 in (0, 4, 8) as allowed from v_targets", "targets")
def scan_targets(spark, sf_dir):
    return read(spark, sf_dir, "targets").select("k", dom.scan_target(F.col("h")).alias("allowed"))


# --- runs, errors, cases ----------------------------------------------------------------------------

_KINDS = ("security", "auth", "input", "malformed", "capacity", "rate_limit", "timeout", "other")
given("errors", "select event_id as id, case when event_id % 11 = 10 then cast(null as string) else case event_id % 8 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(_KINDS)) + " end end as kind, case when event_id % 8 = 7 then case event_id % 5 when 0 then 403 when 1 then 429 when 2 then 401 else 500 end end as http_status, event_id % 9 + 1 as attempt from events")


@query("""select id, case when kind in ('auth') or http_status in (401, 403) then 'auth_error' when kind in ('capacity', 'rate_limit') or http_status = 429 then 'rate_limited' when kind in ('malformed', 'timeout') then kind else 'error' end as status,
coalesce(kind not in ('security', 'auth', 'input', 'malformed', 'capacity'), true) and coalesce(http_status, 0) not in (401, 403) as retryable, least(1.0, 0.1 * power(2, attempt - 1))::double as wait from v_errors""", "errors")
def classified_errors(spark, sf_dir):
    from ..operators import usage as us

    return us.classified(read(spark, sf_dir, "errors")).select("id", "status", "retryable", us.backoff_s(F.col("attempt")).alias("wait"))


given("sized", "select p_partkey as id, p_size as s, case p_partkey % 5 when 0 then concat('[', repeat('1,', cast(p_size as int)), '1]') when 1 then concat('{\"a\": [', repeat('1,', cast(p_size as int)), '1]}') when 2 then concat('{\"a\": {\"b\": \"', repeat('é', cast(p_size as int)), '\", \"c\": 2, \"d\": 3, \"e\": 4}}') when 3 then concat('\"', repeat('é', cast(p_size as int)), '\"') else p_name end as payload, cast(60 as bigint) as max_bytes, cast(20 as bigint) as max_items from part")


@query("""select id, problem from (select id, unnest([case when strlen(payload) > 60 then 'bytes' end, case when id % 5 in (0, 1) and s + 1 > 20 then 'items' end]) as problem from v_sized) where problem is not null""", "sized")
def result_limits(spark, sf_dir):
    from ..operators import usage as us

    return us.over_result_limits(read(spark, sf_dir, "sized").drop("s"))


given("stamps", "select c_custkey as id, case c_custkey % 6 when 0 then concat('2024-01-01T', h, ':00:00') when 1 then concat('2024-01-01T', h, ':00:00+05:00') when 2 then concat('2024-01-01T', h, ':30:00Z') when 3 then 'yesterday' when 4 then concat('2023-12-31T', h, ':59:59Z') end as at_ from (select *, lpad(cast(c_custkey % 24 as string), 2, '0') as h from customer) c")


@query("select id, coalesce(case id % 6 when 0 then id % 24 >= 6 when 1 then id % 24 - 5 >= 6 when 2 then id % 24 >= 6 when 4 then false end, false) as fresh, false as never from v_stamps", "stamps")
def cache_freshness(spark, sf_dir):
    """Answers stored at hours of two days, with zones, without, or without a time, as seen at six in the morning a day later."""
    from ..operators import usage as us

    now = F.lit("2024-01-02T06:00:00Z").cast("timestamp")
    return read(spark, sf_dir, "stamps").select("id", us.fresh(F.col("at_"), now, 24).alias("fresh"), us.fresh(F.col("at_"), now, 0).alias("never"))


given("made_edges", "select concat('r', cast(l_suppkey % 3 as string)) as run_id, concat('a', cast(l_partkey % 40 as string)) as from_node_id, concat('b', cast(l_suppkey as string)) as to_node_id, 'links' as relation_type, cast(l_linenumber % 2 as int) as depth, l_returnflag as source, cast(l_discount as double) as confidence, l_orderkey * 10 + l_linenumber as seq from lineitem")


@query("select run_id, from_node_id, to_node_id, depth, source, arg_min(confidence, (seq, confidence)) as confidence from v_made_edges where not (source = 'A' and depth = 1) group by 1, 2, 3, 4, 5", "made_edges")
def first_edges(spark, sf_dir):
    """Every line as an edge; those of one source and depth are stored already."""
    from ..operators import evidence as ev

    e = read(spark, sf_dir, "made_edges")
    stored = e.where("source = 'A' and depth = 1").select(*le.EDGE_KEY).distinct()
    return ev.append(e, le.EDGE_KEY, stored).select("run_id", "from_node_id", "to_node_id", "depth", "source", "confidence")


@query("""select observation_id, sha256(concat_ws(chr(31), source, '', subject_type, subject_value_norm, predicate, object_type, object_value_norm, '{}', observed_at)) as dedup_key from (select *, row_number() over (partition by source, subject_value_norm, predicate, object_value_norm, observed_at order by k) as r from v_facts where k % 8 <> 5) where r = 1 and not (k % 7 = 4)""", "facts")
def first_observations(spark, sf_dir):
    """Orders as facts, each twice, an eighth of them with a confidence above 1, those of one predicate stored already."""
    from ..operators import evidence as ev

    f = _facts(spark, sf_dir).withColumn("seq", F.col("k")).withColumn("source_record_id", F.lit(None).cast("string"))
    f = f.withColumn("confidence", F.when(F.col("k") % 8 == 5, 1.5).otherwise(F.col("confidence")))
    again = f.withColumn("seq", F.col("seq") + 1_000_000_000).withColumn("observation_id", F.lit("late"))
    good, _ = ev.observations(f.unionByName(again))
    stored = good.where("k % 7 = 4").select("dedup_key").distinct()
    return ev.append(good, ["dedup_key"], stored).select("observation_id", "dedup_key")


given("priced", "select o_orderkey as k, case o_orderkey % 4 when 0 then 'gpt-5-mini' when 1 then 'nobody' when 2 then 'gpt-5-mini' else 'gpt-5.6-luna' end as model, cast(o_custkey % 900 as int) as tokens_in, cast(o_orderkey % 70 as int) as tokens_out, case when o_orderkey % 5 = 0 then '2026-04-02' when o_orderkey % 5 = 1 then '2026-04-03' else '2026-07-01' end as reviewed from orders")


@query("""select k, case when reviewed < '2026-04-03' then 'stale prices' when model = 'nobody' then 'unknown model' end as refusal, case when reviewed < '2026-04-03' or model = 'nobody' then null else case model when 'gpt-5-mini' then (tokens_in * 25 + tokens_out * 200 + 99) // 100 else (tokens_in * 20 + tokens_out * 120 + 99) // 100 end end::bigint as cost from v_priced""", "priced")
def priced_calls(spark, sf_dir):
    from ..operators import models as mo

    p = mo.priced(read(spark, sf_dir, "priced"), F.col("reviewed").cast("date"), F.lit("2026-07-02").cast("date"))
    return p.select("k", "refusal", "cost")


given("graph_runs", "select concat('r', cast(n_nationkey as string)) as run_id, concat('www.root', cast(n_nationkey as string), case when n_nationkey % 2 = 0 then '.com' else '.co.uk' end) as root_domain from nation")
given("graph_nodes", f"select concat('r', cast(c_nationkey as string)) as run_id, c_nationkey as n, c_custkey as k, case when c_custkey % 7 = 6 then 'ip' else 'domain' end as node_type, case c_custkey % 5 when 0 then {_key('x.c', 'c_custkey % 40', '.com')} when 1 then {_key('c', 'c_custkey % 40', '.com')} when 2 then 'bad host' when 3 then concat('a.root', cast(c_nationkey as string), case when c_nationkey % 2 = 0 then '.com' else '.co.uk' end) else {_key('www.d', 'c_custkey % 30', '.co.uk')} end as value_norm from customer")


@query("select distinct run_id, case when k % 5 < 2 then concat('c', k % 40, '.com') else concat('d', k % 30, '.co.uk') end as domain from v_graph_nodes where k % 7 <> 6 and k % 5 in (0, 1, 4)", "graph_nodes")
def predicted_domains(spark, sf_dir):
    from ..operators import quality as qu

    return qu.predicted_domains(read(spark, sf_dir, "graph_runs"), read(spark, sf_dir, "graph_nodes").drop("n", "k"))


# The web of nations, suppliers and regions; some links aren't followed.
given("web", "select concat('r', cast(r_regionkey as string)) as domain, concat('n', cast(n_nationkey as string)) as child, n_nationkey % 4 <> 3 as enqueue from region join nation on n_regionkey = r_regionkey union all select concat('n', cast(s_nationkey as string)), concat('s', cast(s_suppkey as string)), s_suppkey % 5 <> 4 from supplier union all select concat('s', cast(s_suppkey as string)), concat('n', cast((s_nationkey + 1) % 25 as string)), true from supplier")


def _explored(spark, sf_dir: str):
    web = read(spark, sf_dir, "web")

    def step(front: DataFrame) -> DataFrame:
        return web.join(front, "domain").select("domain", "child", F.lit("links").alias("relation_type"), F.lit("s").alias("source"), F.lit(1.0).alias("confidence"), (F.col("depth") + 1).alias("depth"), "enqueue")

    return di.explore(spark.createDataFrame([("r0",)], "domain string"), step, 2)


_WAVES = """w1 as (select distinct child as domain from v_web where domain = 'r0' and enqueue), w2 as (select distinct child as domain from v_web where domain in (select domain from w1) and enqueue and child <> 'r0' and child not in (select domain from w1))"""


@query(f"with {_WAVES} select 'r0' as domain, 0 as depth union all select domain, 1 from w1 union all select domain, 2 from w2", "web")
def explored_domains(spark, sf_dir):
    return _explored(spark, sf_dir)[0]


@query(f"with {_WAVES} select domain, child, depth from (select domain, child, 1 as depth from v_web where domain = 'r0' union all select domain, child, 2 from v_web where domain in (select domain from w1) union all select domain, child, 3 from v_web where domain in (select domain from w2))", "web")
def explored_links(spark, sf_dir):
    return _explored(spark, sf_dir)[1].select("domain", "child", "depth")


given("declared", """select s_suppkey as k, concat('p', cast(s_suppkey as string)) as name, case when s_suppkey % 8 = 7 then 'paid' else 'free' end as tier, s_suppkey % 8 <> 7 as declared, case when s_suppkey % 8 = 1 then 'all' else 'hash_only' end as raw_retention, case when s_suppkey % 8 = 2 then 'ever' when s_suppkey % 8 = 5 then 'run' else 'project' end as normalized_retention, s_suppkey % 8 = 5 as cross_run_cache, case when s_suppkey % 8 = 3 then 'all' else 'normalized' end as export_scope, case when s_suppkey % 8 = 4 then ' ' else 'v1' end as version from supplier""")


@query("select name as key, case k % 8 when 1 then 'raw retention' when 2 then 'normalized retention' when 3 then 'export scope' when 4 then 'version' when 5 then 'caching needs project retention' when 7 then 'paid source without a policy' end as problem from v_declared where k % 8 in (1, 2, 3, 4, 5, 7)", "declared")
def policy_problems(spark, sf_dir):
    from ..operators import validation as va

    return va.policy_problems(read(spark, sf_dir, "declared").drop("k"))


given("config", "select s_suppkey as k, concat('p', cast(s_suppkey as string)) as name, 'dns' as capability, 'free' as tier, s_suppkey % 2 = 1 as no_key, s_suppkey % 3 = 1 as bad_key, s_suppkey % 5 = 1 as no_tool from supplier")


@query("select capability, name, tier, case when name in ('p0', 'p11') then 'disabled' when no_tool then 'dependency_missing' when bad_key then 'configuration_invalid' when no_key then 'configuration_missing' else 'ready' end as state from v_config", "config")
def source_diagnostics(spark, sf_dir):
    from ..sources import registry as reg

    some = lambda c, name: F.when(F.col(c), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    c = read(spark, sf_dir, "config").select("name", "capability", "tier", some("no_key", "KEY").alias("missing_environment"), some("bad_key", "RATE").alias("invalid_environment"), some("no_tool", "tool").alias("missing_executables"))
    return reg.diagnostics(c, ("p0", "p11"))


@query("select c_custkey as id, case when c_custkey % 3 = 0 then 100 else 60 end::bigint as kept, case when c_custkey % 3 = 0 then null else 40 end::bigint as cut from customer")
def trimmed_contexts(spark, sf_dir):
    """Each customer's context of a hundred hosts, a third of which are short enough as they are."""
    from ..operators import models as mo

    c = over(spark, sf_dir, "select c_custkey as id from customer")
    short = F.col("id") % 3 == 0
    host = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("h"), F.lpad(i.cast("string"), 2, "0"), F.when(short, "").otherwise(".example.com")))
    t = c.select("id", mo.trimmed(F.to_json(F.struct(F.col("id").alias("domain"), host.alias("subdomains"))), 1320).alias("t"))
    return t.select("id", F.size(F.from_json(F.get_json_object("t", "$.subdomains"), "array<string>")).cast("long").alias("kept"), F.get_json_object("t", "$.subdomains_truncated").cast("long").alias("cut"))


@query("""select user_id as run_id, count(*) as nodes, list_sort(list(event_id))[1] as first_node, count(*) as edges, max(event_id) as last_edge from events group by 1""")
def graph_documents(spark, sf_dir):
    """Each run's export, read back: its nodes and edges."""
    from ..sources import exports as out

    e = over(spark, sf_dir, "select user_id, event_type, event_id from events")
    n = e.select(F.col("user_id").alias("run_id"), F.lit("domain").alias("node_type"), F.lit("v").alias("value_norm"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("node_id"))
    d = e.select(F.col("user_id").alias("run_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("from_node_id"), F.lit("r").alias("relation_type"), F.col("event_type").alias("to_node_id"))
    g = F.from_json("json", "run_id long, nodes array<struct<node_id:string>>, edges array<struct<from_node_id:string>>")
    at = lambda c, i: F.element_at(c, i).cast("long")
    back = out.graph_json(n, d).select(g.alias("g"))
    return back.select("g.run_id", F.size("g.nodes").cast("long").alias("nodes"), at(F.col("g.nodes.node_id"), 1).alias("first_node"), F.size("g.edges").cast("long").alias("edges"), at(F.col("g.edges.from_node_id"), -1).alias("last_edge"))


# --- cases and benchmarks ---------------------------------------------------------------------------

_LABEL = lambda domain, kind="'positive'", relationship="'owner'", ref="'r'": _object(("domain", _text(domain)), ("classification", _text(kind)), ("relationship", _text(relationship)), ("source_refs", _list(_text(ref))))
_ROOT, _OTHER = _key("root", "c_custkey", ".com"), _key("a", "c_custkey", ".org")
_GOOD = _LABEL(_OTHER)
#: The labels of a case that breaks one rule, or none.
_LABELS = {
    "fine": _list(_GOOD, _LABEL(_key("www.b", "c_custkey", ".co.uk"), "'Negative'")), "version": _list(_GOOD), "root": _list(_GOOD), "no labels": "'[]'", "label domain": _list(_LABEL("''")), "classification": _list(_LABEL(_OTHER, "'maybe'")),
    "relationship": _list(_LABEL(_OTHER, relationship="' '")), "label references": _list(_LABEL(_OTHER, ref="' '")), "root is labelled": _list(_LABEL(_key("www.root", "c_custkey", ".com"))), "conflicting labels": _list(_GOOD, _LABEL(_key("x.a", "c_custkey", ".org"), "'negative'")), "repeated label": _list(_GOOD, _GOOD),
}
_RULE = "case k % 11 " + " ".join(f"when {i} then '{name}'" for i, name in enumerate(_LABELS)) + " end"
given("cases", f"select c_custkey as k, {_key('case', 'c_custkey')} as case_id, " + _object(("schema_version", "case when c_custkey % 11 = 1 then '2' else '1' end"), ("case_id", _text(_key("case", "c_custkey"))), ("root_domain", _text(f"case when c_custkey % 11 = 2 then 'not a host' else {_ROOT} end")), ("labels", "case c_custkey % 11 " + " ".join(f"when {i} then {x}" for i, x in enumerate(_LABELS.values())) + " end")) + " as payload from customer")


def _cases(spark, sf_dir: str) -> DataFrame:
    from ..operators import validation as va

    return read(spark, sf_dir, "cases").select(F.from_json("payload", va.CASE).alias("c")).select("c.*")


@query(f"select case_id as key, {_RULE} as problem from v_cases where k % 11 <> 0", "cases")
def case_problems(spark, sf_dir):
    """Each customer as an evaluation case that keeps the rules or breaks one of ten."""
    from ..operators import validation as va

    return va.case_problems(_cases(spark, sf_dir))


@query("select case_id, 2::bigint as labels from v_cases where k % 11 = 0", "cases")
def valid_cases(spark, sf_dir):
    from ..operators import validation as va

    c = _cases(spark, sf_dir)
    return va.valid(c, va.case_problems(c), "case_id").select("case_id", F.size("labels").cast("long").alias("labels"))


given("graph_roots", f"select c_custkey as k, case c_custkey % 3 when 2 then {_key('unknown', 'c_custkey')} else {_key('case', 'c_custkey')} end as case_id, case c_custkey % 3 when 0 then {_key('www.root', 'c_custkey', '.com')} else {_key('else', 'c_custkey', '.com')} end as root_domain from customer where c_custkey % 11 <> 2")


@query("select case_id as key, 'another root' as problem from v_graph_roots where k % 3 = 1", "graph_roots")
def root_problems(spark, sf_dir):
    """Graphs of the cases, a third of which have another root."""
    from ..operators import validation as va

    return va.root_problems(read(spark, sf_dir, "graph_roots").drop("k"), _cases(spark, sf_dir))


given("manifests", f"""select s_suppkey as k, {_key('b', 's_suppkey')} as benchmark_id, {_object(("schema_version", "case when s_suppkey % 4 = 1 then '3' else '1' end"), ("benchmark_id", _text(_key('b', 's_suppkey'))), ("comparisons", "case s_suppkey % 4 when 2 then '[]' when 3 then " + _list(_object(("case", "'\"c\"'"), ("baseline", "'\" \"'"))) + " else " + _list(_object(("case", "'\"c\"'"), ("baseline", "'\"b\"'"), ("candidate", _text("s_name")))) + " end"))} as payload from supplier""")


@query("select benchmark_id as key, case k % 4 when 1 then 'version' when 2 then 'no comparisons' else 'paths' end as problem from v_manifests where k % 4 <> 0", "manifests")
def manifest_problems(spark, sf_dir):
    from ..operators import validation as va

    kind = "struct<schema_version:int,benchmark_id:string,comparisons:array<struct<case:string,baseline:string,candidate:string>>>"
    return va.manifest_problems(read(spark, sf_dir, "manifests").select(F.from_json("payload", kind).alias("m")).select("m.*"))


given("entries", f"select {_key('b', 'o_orderkey % 40')} as benchmark_id, o_orderkey as ord, {_key('c', 'o_custkey')} as case_id, concat(case when o_orderkey % 2 = 0 then 'www.' else '' end, {_key('r', 'o_custkey % 700')}, '.com') as root_domain from orders")
given("settings", f"select {_key('b', 'o_orderkey % 40')} as benchmark_id, o_orderkey as ord, side, case o_orderkey % 3 when 0 then 'max_depth' when 1 then 'cache_mode' else 'run_mode' end as field, case when side = 'candidate' and o_orderkey % 7 = 3 then null when side = 'candidate' and o_orderkey % 11 = 5 then 'other' when o_orderkey % 5 = 0 then o_orderstatus else 'same' end as value from orders, (values ('baseline'), ('candidate')) t(side)")


@query("""select benchmark_id as key, 'duplicate case_id: ' || case_id as problem from v_entries group by benchmark_id, case_id having count(*) > 1 union all select benchmark_id, 'duplicate root_domain: ' || regexp_replace(root_domain, '^www\\.', '') from v_entries group by benchmark_id, regexp_replace(root_domain, '^www\\.', '') having count(*) > 1
union all select benchmark_id, 'inconsistent policy: ' || field from (select a.benchmark_id, a.field, a.value from v_settings a join v_settings b using (benchmark_id, ord, field) where a.side = 'baseline' and b.side = 'candidate' and a.value is not null and b.value is not null) group by benchmark_id, field having count(distinct value) > 1""", "entries", "settings")
def benchmark_problems(spark, sf_dir):
    """Orders as entries of forty benchmarks."""
    from ..operators import validation as va

    return va.benchmark_problems(read(spark, sf_dir, "entries"), read(spark, sf_dir, "settings"))


@query("""select benchmark_id, ord, field, case when count(distinct side) filter (value is not null) < 2 then 'unverified' when count(distinct value) = 1 then 'matched' else 'mismatch' end as state from v_settings group by 1, 2, 3""", "settings")
def policy_match(spark, sf_dir):
    from ..operators import validation as va

    return va.policy_match(read(spark, sf_dir, "settings"), ["benchmark_id", "ord"])


given("in_use", "select s_suppkey % 2 = 0 as active, s_suppkey % 7 <> 1 as cache_allowed from supplier")


@query("select bool_and(cache_allowed) as allowed from v_in_use where active", "in_use")
def cache_eligibility(spark, sf_dir):
    return di.cache_allowed(read(spark, sf_dir, "in_use"))


given("nested", f"""select p_partkey as k, p_name as name, p_brand as brand, case when p_partkey % 3 = 2 then p_name else {_object(("b", _text("concat(' ', p_name, ' ')")), ("a", _list("cast(p_size as string)", "'null'", _object(("c", _text("p_brand"))))))} end as payload from part""")


@query("select k, case when k % 3 = 2 then name else name || chr(10) || p_size || chr(10) || brand end as t from v_nested join part on p_partkey = k", "nested")
def flat_strings(spark, sf_dir):
    from ..operators import extract as ex

    return read(spark, sf_dir, "nested").select("k", ex.flat_strings(F.col("payload")).alias("t"))


# --- metadata and serialized rows -------------------------------------------------------------------

given("made", "select concat('r', cast(n_regionkey as string)) as run_id, 'domain' as node_type, concat('v', cast(n_nationkey as string)) as value_norm, n_nationkey as seq, 'by' as k, n_name as v from nation")
given("updates", "select concat('v', cast(c_nationkey as string)) as value_norm, c_custkey as seq, case c_custkey % 3 when 0 then 'by' when 1 then 'x' else 'y' end as k, concat(c_mktsegment, cast(c_custkey as string)) as v from customer where c_nationkey % 4 <> 0 union all select 'nowhere', s_suppkey, 'x', s_name from supplier")


@query("""with l as (select value_norm, k, arg_max(v, seq) as v from v_updates group by 1, 2), m as (select run_id, m.value_norm, coalesce(b.v, m.v) as b, x.v as x, y.v as y from v_made m left join l b on b.value_norm = m.value_norm and b.k = 'by' left join l x on x.value_norm = m.value_norm and x.k = 'x' left join l y on y.value_norm = m.value_norm and y.k = 'y')
select run_id, value_norm, b as "by", x, y from m""", "made", "updates")
def merged_metadata(spark, sf_dir):
    """Nations as nodes whose metadata their customers update, the last value of a key standing; some updates name no node."""
    n = le.nodes(read(spark, sf_dir, "made").withColumn("metadata", F.create_map("k", "v")).drop("k", "v"))
    u = read(spark, sf_dir, "updates").join(n.select("value_norm", "node_id"), "value_norm", "left")
    u = u.withColumn("node_id", F.coalesce("node_id", F.lit("none"))).withColumn("metadata", F.create_map("k", "v"))
    out = le.with_metadata(n, u.select("node_id", "seq", "metadata"))
    return out.select("run_id", "value_norm", *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("by", "x", "y")])


@query("select observation_id, object_value_norm, 'normalized' as export_scope, true as cache_allowed, confidence from v_facts", "facts")
def serialized_observations(spark, sf_dir):
    """Orders as observations, written as JSON and read back."""
    f = _facts(spark, sf_dir).withColumn("source_record_id", F.col("observation_id")).withColumn("dedup_key", F.col("observation_id"))
    good, _ = le.from_json(f.select(le.to_json(f).alias("json")))
    return good.select(F.col("source_record_id").alias("observation_id"), "object_value_norm", "export_scope", "cache_allowed", "confidence")


# --- plans ------------------------------------------------------------------------------------------

_CAPABILITIES = ("whois", "basic_info", "reverse_whois", "dns", "subdomains", "historical_web", "acquisitions")
given("plan_sources", f"select {_key('p', 's_suppkey')} as name, case s_suppkey % 7 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(_CAPABILITIES)) + " end as capability, case when s_suppkey % 5 = 0 then 'paid' else 'free' end as tier, s_suppkey % 5 = 0 as billable, s_suppkey % 11 <> 3 as available, cast(s_suppkey % 4 + 1 as int) as request_limit, cast(s_suppkey as int) as ord from supplier")
_STEPS = """u as (select * from v_plan_sources where available), a as (select capability, list(name order by billable desc, ord) as names, list(request_limit order by billable desc, ord) as limits, bool_or(billable) as billable, arg_min(billable, (not billable, ord)) as first_billable, count(*) as n from u group by 1),
r(capability, step, every, per) as (values ('whois', 'whois', true, 1), ('basic_info', 'basic_info', false, 1), ('dns', 'dns', false, 1), ('subdomains', 'subdomains', true, 1), ('reverse_whois', 'reverse_whois', false, 5), ('acquisitions', 'acquisitions', true, 5), ('basic_info', 'tracker_verification', false, 50)),
p as (select step, case when every then names else names[:1] end as sources, case when every then n * per else per end::bigint as calls, case when every then list_max(limits) else limits[1] end::bigint as requests_per_call, case when every then billable else first_billable end as billable
from r join a using (capability) where step <> 'tracker_verification' or exists (select 1 from a where capability = 'reverse_whois'))"""


def _plan(spark, sf_dir: str):
    from . import preflight

    return preflight, read(spark, sf_dir, "plan_sources"), preflight.Settings(profile="byok", paid_approved=True)


@query("select name, case when not available then 'unavailable' when billable then 'policy_excluded' else 'selected' end as state from v_plan_sources", "plan_sources")
def plan_states(spark, sf_dir):
    """The suppliers as a registry of sources, under a profile that pays for none."""
    preflight, sources, _ = _plan(spark, sf_dir)
    return preflight.status(sources, preflight.Settings()).select("name", "state")


@query(f"with {_STEPS} select * from p", "plan_sources")
def plan_steps(spark, sf_dir):
    preflight, sources, s = _plan(spark, sf_dir)
    return preflight.steps(sources, s)


@query(f"with {_STEPS} select (sum(calls) * 500)::bigint as calls, (sum(calls * requests_per_call) * 500)::bigint as requests, (coalesce(sum(calls * 3) filter (billable), 0) * 500)::double as units, sum(calls) * 500 > 500 as calls_exceed, coalesce(sum(calls * 3) filter (billable), 0) * 500 > 0 as units_exceed from p", "plan_sources")
def plan_totals(spark, sf_dir):
    preflight, sources, s = _plan(spark, sf_dir)
    return preflight.totals(preflight.steps(sources, s), s)
