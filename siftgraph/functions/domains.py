"""Domain names and identifiers as Column expressions. Invalid input gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .addresses import bound, public_address

# Second-level public suffixes that count as one suffix.
TWO_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "gov.uk", "ac.uk", "co.jp", "or.jp", "ne.jp", "com.au", "net.au", "org.au", "co.nz", "com.br", "com.cn", "com.mx", "co.in", "co.za", "com.sg", "com.hk", "com.tr", "co.kr", "com.tw",
)

# Registrars and privacy services, whose contacts aren't an owner's.
REGISTRAR_HOSTS = (
    "markmonitor.com", "cscglobal.com", "csc-global.com", "cscprotectsbrands.com", "godaddy.com", "namecheap.com", "namebright.com", "gandi.net", "tucows.com", "enom.com", "enomdomains.com", "networksolutions.com",
    "register.com", "name.com", "dynadot.com", "porkbun.com", "ionos.com", "1and1.com", "ovh.com", "ovh.net", "hostinger.com", "hover.com", "domains.google", "googledomains.com", "cloudflare.com", "cloudflareregistrar.com",
    "amazonaws.com", "wildwestdomains.com", "publicdomainregistry.com", "onlinenic.com", "fabulous.com", "moniker.com", "web.com", "eurodns.com", "key-systems.net", "1api.net", "gransy.com", "safenames.net", "nom-iq.com", "comlaude.com",
)

# Sites that surface in searches without being owned by the target.
SEARCH_NOISE = (
    "baidu.com", "zhihu.com", "quora.com", "reddit.com", "wikipedia.org", "wikimedia.org", "stackoverflow.com", "crunchbase.com", "bloomberg.com", "glassdoor.com", "indeed.com", "yelp.com", "tripadvisor.com", "bing.com", "google.com",
    "yahoo.com", "duckduckgo.com", "whois.com", "who.is", "icann.org", "domaintools.com", "archive.org", "facebook.com", "twitter.com", "x.com", "linkedin.com", "instagram.com", "pinterest.com", "t.co", "goo.gl", "bit.ly",
    "ipinfo.io", "shodan.io", "censys.io", "virustotal.com", "securitytrails.com", "dnslytics.com", "builtwith.com", "similarweb.com", "netcraft.com", "robtex.com", "abuseipdb.com", "greynoise.io", "spyse.com", "riskiq.com",
    "threatcrowd.org", "viewdns.info", "whoxy.com", "dnsdumpster.com",
)

# File endings that look like top-level domains.
FILE_ENDINGS = ("html", "htm", "php", "asp", "aspx", "jsp", "xml", "json", "txt", "js", "css", "png", "jpg", "jpeg", "gif", "svg", "webp", "pdf", "doc", "docx", "zip", "md")

# Mail addresses and name servers too generic to follow.
GENERIC_MAIL = ("abuse@", "abusecomplaints", "hostmaster@", "postmaster@", "noc@", "admin@registrar", "registrar-abuse@", "whoisguard", "privacyprotect", "whoisrequest", "whois@", "domainsprivacy", "contactprivacy", "whoisprivacy", "domainabuse", "noreply", "no-reply", "registryadmin", "dns-admin", "ssl@")
GENERIC_NAME_SERVERS = (
    "akam.net", "akamai.net", "akamaiedge.net", "cloudflare.com", "cloudflare-dns.com", "awsdns", "amazonaws.com", "googledomains.com", "google.com", "azure-dns.com", "azure-dns.net", "ultradns.com", "ultradns.net", "ultradns.org",
    "domaincontrol.com", "registrar-servers.com", "dnsmadeeasy.com", "nsone.net", "p01.nsone.net", "dynect.net", "he.net", "linode.com", "digitalocean.com", "vultr.com", "hetzner.com", "godaddy.com", "namecheap.com", "safenames.net",
)

_NAME = r"^(?=.{1,253}$)(?!-)[a-z0-9-]{1,63}(?<!-)(\.(?!-)[a-z0-9-]{1,63}(?<!-))+$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalized_domain(raw: Column) -> Column:
    """The host with its port and user part of a URL or bare host; null where that isn't a domain name."""

    def host_of(v: Column) -> Column:
        host = F.when(v.contains("://"), F.regexp_extract(v, r"^[^:/?#]*://([^/?#]*)", 1)).otherwise(F.split_part(v, F.lit("/"), F.lit(1)))
        return F.regexp_replace(_strip(host), r"\.+$", "")

    # Each value is computed once: an expression that names another repeats its text, and so its work.
    return bound(bound(F.lower(_strip(raw)), host_of), lambda host: F.when(host.rlike(_NAME), host))


def registrable(host: Column) -> Column:
    """The last two labels, or three below a two-label suffix."""


    def of(h: Column) -> Column:
        last = lambda k: F.substring_index(h, ".", -k)
        return F.when(last(2).isin(*TWO_LABEL_SUFFIXES), last(3)).otherwise(last(2))

    return bound(F.regexp_replace(F.lower(_strip(host)), r"\.+$", ""), of)


def host_in(host: Column, names: tuple[str, ...]) -> Column:
    """Whether the host is one of the names or below one: its suffixes are compared by equality."""
    bare = F.regexp_replace(F.lower(_strip(host)), r"\.+$", "")
    most = max(n.count(".") for n in names) + 1  # longer suffixes are none of the names
    return bound(bare, lambda h: F.arrays_overlap(F.array(*[F.substring_index(h, ".", -k) for k in range(1, most + 1)]), F.lit(list(names))))


def contains_any(value: Column, parts: tuple[str, ...]) -> Column:
    import re

    return value.rlike("|".join(re.escape(p).replace("\\@", "@") for p in parts))


def registrar_mail(mail: Column) -> Column:
    return host_in(F.regexp_extract(F.lower(mail), r"@(.*)$", 1), REGISTRAR_HOSTS)


def noise_domain(domain: Column, noise: tuple[str, ...] = SEARCH_NOISE + REGISTRAR_HOSTS) -> Column:
    noisy = lambda d: ~d.contains(".") | F.substring_index(d, ".", -1).isin(*FILE_ENDINGS) | host_in(registrable(d), noise)
    return bound(F.regexp_replace(F.lower(_strip(domain)), r"\.+$", ""), noisy)


def normalized_identifier(kind: Column, raw: Column) -> Column:
    """By type: mail in lower case, phone as digits and +, name server as domain, tracker in upper case, else lower case with single spaces. Null where empty."""
    v, k = _strip(raw), F.lower(_strip(kind))
    other = F.lower(_strip(F.regexp_replace(v, r"(?U)\s+", " ")))
    out = F.when(k == "email", F.lower(v)).when(k == "phone", F.regexp_replace(v, r"(?U)[^\d+]", "")).when(k == "ns", normalized_domain(v)).when(k == "tracker", F.upper(v)).otherwise(other)
    return F.nullif(out, F.lit(""))


def plausible_tracker(value: Column) -> Column:
    v = F.upper(_strip(value))
    payload = F.replace(F.regexp_replace(v, r"^[^-]*-", ""), F.lit("-"), F.lit(""))
    plain = F.regexp_replace(payload, "[^A-Z0-9]", "")
    return ~payload.rlike("XXXXX|TEST|DEMO|SAMPLE") & (F.size(F.array_distinct(F.split(plain, ""))) > 2)


def tracker_confidence(value: Column) -> Column:
    v = F.upper(_strip(value))
    return F.when(v.startswith("CA-PUB-"), 0.95).when(v.startswith("UA-"), 0.92).when(v.startswith("GTM-"), 0.90).when(v.startswith("G-"), 0.85).otherwise(0.70)


def valid_pivot(kind: Column, value: Column, score: Column) -> Column:
    """A known type, a value, a score in 0 .. 1, and no generic name server or mail."""
    ok = kind.isin("email", "org", "name", "phone", "ns", "tracker") & (_strip(value) != "") & score.between(0.0, 1.0)
    low = F.lower(value)
    return ok & ~((kind == "ns") & contains_any(low, GENERIC_NAME_SERVERS)) & ~((kind == "email") & (contains_any(low, GENERIC_MAIL) | registrar_mail(low)))


# Names and endings of hosts inside a network.
INNER_HOSTS = ("localhost", "127.0.0.1", "::1", "0.0.0.0", "metadata.google.internal", "metadata.goog", "instance-data.ec2.internal", "169.254.169.254")
INNER_ENDINGS = (".local", ".localhost", ".internal", ".lan", ".home", ".localdomain")
#: White space at the ends of a host, as Python's ``strip`` sees it.
_ENDS = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"


def scan_target(host: Column) -> Column:
    """Whether a host may be asked about: no inner name or ending, and a literal address only if it is public. Brackets around an address are taken off."""
    h = F.regexp_replace(F.lower(F.regexp_replace(host, _ENDS, "")), r"\.+$", "")

    def open_(bare: Column) -> Column:
        refused = bare.isin(*INNER_HOSTS)
        for ending in INNER_ENDINGS:
            refused = refused | bare.endswith(ending)
        return (bare != "") & ~refused & F.coalesce(public_address(bare), F.lit(True))

    return F.coalesce(bound(F.regexp_replace(h, r"^\[(.*)\]$", "$1"), open_), F.lit(False))
