"""Literal internet addresses as Column expressions: parsed to 128 bits, looked up in a sorted table of ranges.

An address becomes its version and two longs, the upper and the lower 64 bits, each
with its top bit flipped so that they order as unsigned numbers do. Each version has a
table of its own: IPv4 addresses in their mapped form (``::ffff:0:0/96``) are inner ones,
whatever they map. Text that isn't a literal address gives null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address space that isn't public (private use, loopback, link-local, multicast, reserved), and what is public within it.
INNER_IPV4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
OUTER_IPV4 = ("192.0.0.9/32", "192.0.0.10/32")
INNER_IPV6 = (
    "::/8", "64:ff9b:1::/48", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16", "4000::/3", "6000::/3", "8000::/3",
    "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8",
)
OUTER_IPV6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")

_TOP = 1 << 63
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_QUAD = rf"\A{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"
_GROUP = "[0-9a-f]{1,4}"
_GROUPS = rf"\A(?:{_GROUP}(?::{_GROUP}){{7}}|(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})?)\z"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def halves(number: int) -> tuple[int, int]:
    """A 128-bit number as two longs that order like it."""
    return (number >> 64) - _TOP, (number & ((1 << 64) - 1)) - _TOP


@cache
def ranges(inner: tuple[str, ...], outer: tuple[str, ...]) -> tuple[tuple[int, bool], ...]:
    """The sorted table of one version: where each range begins, and whether it is inner; neighbours differ. A smaller network overrides the larger one that holds it."""
    rules = [(int(n.network_address), int(n.broadcast_address) + 1, kind) for kind, texts in ((True, inner), (False, outer)) for n in map(ip_network, texts)]
    rules.sort(key=lambda r: r[0] - r[1])  # the largest first
    table: list[tuple[int, bool]] = []
    for start in sorted({0} | {x for lo, hi, _ in rules for x in (lo, hi)}):
        kind = ([False] + [k for lo, hi, k in rules if lo <= start < hi])[-1]
        if start < 1 << 128 and (not table or table[-1][1] != kind):
            table.append((start, kind))
    return tuple(table)


#: The tables by version.
PUBLIC_RULE = {4: ranges(INNER_IPV4, OUTER_IPV4), 6: ranges(INNER_IPV6, OUTER_IPV6)}


def ipv4_number(text: Column) -> Column:
    """Four decimal numbers up to 255 without leading zeros, as a long."""
    part = lambda i: F.regexp_extract(text, _QUAD, i).cast("long")
    return F.when(text.rlike(_QUAD), part(1) * (1 << 24) + part(2) * (1 << 16) + part(3) * (1 << 8) + part(4))


def _in_groups(bare: Column) -> Column:
    """An IPv6 address with a closing IPv4 part turned into two groups."""
    tail = F.substring_index(bare, ":", -1)
    head = F.substring(bare, F.lit(1), F.length(bare) - F.length(tail))
    words = lambda n: F.concat(head, F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(0xFFFF))))
    return F.when(bare.contains("."), bound(ipv4_number(tail), words)).otherwise(bare)


def _digits(groups: Column) -> Column:
    """Groups as 32 hexadecimal digits, the gap filled."""
    given = lambda side: F.filter(F.split(side, ":"), lambda x: x != "")
    before, after = given(F.substring_index(groups, "::", 1)), given(F.substring_index(groups, "::", -1))
    missing = F.lit(8) - F.size(before) - F.size(after)  # at least one, if there is a gap
    filled = F.concat(before, F.array_repeat(F.lit("0"), missing), after)
    every = F.when(groups.contains("::"), F.when(missing >= 1, filled)).otherwise(before)
    return F.when(groups.rlike(_GROUPS), F.array_join(F.transform(every, lambda x: F.lpad(x, 4, "0")), ""))


def address(text: Column) -> Column:
    """A literal address as a struct of ``version``, ``hi`` and ``lo`` (see above); null for other text. A zone is dropped."""
    bare = F.regexp_extract(F.lower(text), r"\A([^%]*)(?:%[^%]+)?\z", 1)
    # Flipping the top bit: the bits as a signed number, the sign turned.
    half = lambda digits, at: F.conv(F.substring(digits, at, 16), 16, -10).cast("long").bitwiseXOR(F.lit(-_TOP))
    made = lambda version, known, hi, lo: F.when(known.isNotNull(), F.struct(F.lit(version).alias("version"), hi.alias("hi"), lo.alias("lo")))
    six = bound(bound(bare, _in_groups), lambda g: bound(_digits(g), lambda d: made(6, d, half(d, 1), half(d, 17))))
    four = bound(ipv4_number(text), lambda n: made(4, n, F.lit(-_TOP), n + F.lit(-_TOP)))
    return F.when(text.contains(":"), six).otherwise(four)


def inner(at: Column, tables: dict[int, tuple[tuple[int, bool], ...]] = PUBLIC_RULE) -> Column:
    """Whether an ``address`` lies in an inner range: the last range that begins at or before it decides, found by halving. Null for null."""

    def search(a: Column, table: tuple[tuple[int, bool], ...]) -> Column:
        his, los = (F.lit([halves(start)[k] for start, _ in table]) for k in (0, 1))
        steps = F.lit([1 << k for k in range(len(table).bit_length() - 1, -1, -1)])

        def reached(i: Column) -> Column:
            hi, lo = F.get(his, i), F.get(los, i)
            return F.coalesce((hi < a["hi"]) | ((hi == a["hi"]) & (lo <= a["lo"])), F.lit(False))

        n = F.aggregate(steps, F.lit(0), lambda n, step: F.when(reached(n + step - 1), n + step).otherwise(n))
        return F.get(F.lit([kind for _, kind in table]), n - 1)

    return bound(at, lambda a: F.when(a["version"] == 4, search(a, tables[4])).when(a["version"] == 6, search(a, tables[6])))


def public_address(text: Column) -> Column:
    """Whether a literal address (as from a DNS answer) is public; null for text that is none."""
    return ~inner(address(text))
