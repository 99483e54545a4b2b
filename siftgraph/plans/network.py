"""Queries over network addresses that are spelled from the customers' keys.

Each customer stands for an address at or beside the bound of a range, written in every
spelling below; the SQL decides from the numbers, the operators from the text.
"""

from __future__ import annotations

from ipaddress import ip_network

from pyspark.sql import functions as F

from ..functions import addresses as ad
from ..functions import domains as dom
from .views import spread, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _networks() -> list[tuple[int, int, int, bool]]:
    """Version, first and last number of each network, and whether it is inner."""
    every = ((True, ad.INNER_IPV4 + ad.INNER_IPV6), (False, ad.OUTER_IPV4 + ad.OUTER_IPV6))
    return [(n.version, int(n.network_address), int(n.broadcast_address), kind) for kind, texts in every for n in map(ip_network, texts)]


def _edges() -> list[tuple[int, ...]]:
    """Addresses at the networks' bounds and beside them, as eight groups; IPv4 addresses fill the last two."""
    at = {x + d for _, lo, hi, _ in _networks() for x in (lo, hi) for d in (-1, 0, 1)}
    return [tuple(x >> 16 * k & 0xFFFF for k in range(7, -1, -1)) for x in sorted(at) if 0 <= x < 1 << 128]


G = [f"g{k}" for k in range(1, 9)]
_HEX = [f"lower(hex({g}))" for g in G]
_FULL = "concat(" + ", ':', ".join(_HEX) + ")"
_QUAD = "concat(" + ", '.', ".join(f"cast(cast({x} as bigint) as string)" for x in ("floor(g7 / 256)", "g7 % 256", "floor(g8 / 256)", "g8 % 256")) + ")"
#: Each spelling with the number it stands for (of the eight groups, of the last two in mapped form or as IPv4, or none) and whether blanks or a dot surround it.
SPELLINGS = {
    "full": (_FULL, "all", False),
    "padded": ("upper(concat(" + ", ':', ".join(f"lpad({h}, 4, '0')" for h in _HEX) + "))", "all", False),
    "short": (f"case when g2 + g3 + g4 + g5 + g6 + g7 = 0 and g1 + g8 = 0 then '::' when g2 + g3 + g4 + g5 + g6 + g7 = 0 and g1 = 0 then concat('::', {_HEX[7]}) when g3 + g4 + g5 + g6 + g7 = 0 then concat({_HEX[0]}, ':', {_HEX[1]}, '::', {_HEX[7]}) else {_FULL} end", "all", False),
    "dotted tail": ("concat(" + ", ':', ".join(_HEX[:6]) + f", ':', {_QUAD})", "all", False),
    "zoned": (f"concat({_FULL}, '%eth', cast(k % 3 as string))", "all", False),
    "mapped": (f"concat('::ffff:', {_QUAD})", "mapped", False),
    "quad": (_QUAD, "quad", False),
    "blanks and dot": (f"concat('  ', {_FULL}, '. ')", "all", True),
    "leading zero": (f"concat('0', {_QUAD})", "none", False),
    "nine groups": (f"concat({_FULL}, ':0')", "none", False),
    "two gaps": (f"concat({_HEX[0]}, '::', {_HEX[7]}, '::')", "none", False),
    "long group": (f"concat('0', lpad({_HEX[0]}, 4, '0'), '::')", "none", False),
    "two zones": (f"concat({_FULL}, '%a%b')", "none", False),
}


def placed(customers: str) -> str:
    """SQL that both engines read: k and the eight groups of each customer's address."""
    edges = _edges()
    values = ", ".join(f"({i}, {', '.join(map(str, e))})" for i, e in enumerate(edges))
    return f"select c_custkey as k, {', '.join(f'cast({g} as bigint) as {g}' for g in G)} from {customers} join (values {values}) e(i, {', '.join(G)}) on c_custkey % {len(edges)} = i"


def _sql() -> str:
    # hugeint literals past 2^127 don't parse, so the bounds are made from groups too
    number = lambda groups: " + ".join(f"{g}::uhugeint * {65536 ** (7 - i)}::uhugeint" for i, g in enumerate(groups))
    groups = lambda x: [str(x >> 16 * k & 0xFFFF) for k in range(7, -1, -1)]
    nets = " union all ".join(f"select {v} as v, {number(groups(lo))} as lo, {number(groups(hi))} as hi, {kind} as inside" for v, lo, hi, kind in _networks())
    spelled = " union all ".join(f"select k, '{name}' as spelling, {text} as text, '{stands}' as stands, {apart} as apart, {', '.join(G)} from b" for name, (text, stands, apart) in SPELLINGS.items())
    return f"""with b as ({placed("customer")}), a as ({spelled}), nets as ({nets}),
n as (select k, spelling, text, stands, apart, case stands when 'quad' then 4 else 6 end as v, case stands when 'all' then {number(G)} when 'mapped' then {0xFFFF << 32}::uhugeint + {number(["0"] * 6 + G[6:])} when 'quad' then {number(["0"] * 6 + G[6:])} end as x from a),
w as (select v, x, arg_min(inside, hi - lo) as inside from (select distinct v, x from n) join nets using (v) where x between lo and hi group by 1, 2),
v as (select k, spelling, text, apart, stands, coalesce(inside, false) as inside from n left join w using (v, x))
select k, spelling, text, case when stands <> 'none' and not apart then not inside end as public, stands = 'none' or not inside as allowed from v"""


ORACLE_SQL["address_guard"] = _sql()


def address_guard(spark, sf_dir):
    """Every spelling of every customer's address: whether it is public (null: no literal address) and may be asked about."""
    own = "sift_guarded_customers"
    spread(table(spark, sf_dir, "customer").select("c_custkey")).createOrReplaceTempView(own)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("spelling"), F.expr(text).alias("text")) for name, (text, _, _) in SPELLINGS.items()]))
    rows = spark.sql(placed(own)).select("k", each.alias("s")).select("k", "s.*")
    return rows.select("k", "spelling", "text", ad.public_address(F.col("text")).alias("public"), dom.scan_target(F.col("text")).alias("allowed"))


QUERIES["address_guard"] = address_guard
