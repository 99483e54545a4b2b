r"""Canonical JSON of nested values as a Column expression, and its digest.

The text is compact, its keys are sorted by code point, all but ASCII is escaped as
``\uXXXX`` (two of them beyond U+FFFF), numbers are written in the shortest form
that reads back as the same double. Dates, timestamps, decimals and binary values
have no JSON form: they become their text, in quotes. A null is ``null``, also as a
field of a struct.

The expression is built from the column's type, so keys of structs are sorted once,
when the query is planned; keys of maps are sorted in each row. Maps need string keys.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegralType,
    MapType,
    NullType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from .addresses import bound
from .exact import halves, product

#: Characters that stand for themselves, and those with an escape of their own.
PLAIN = r"\A[ !#-\[\]-~]*\z"
ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def quoted(text: Column) -> Column:
    """A text as a JSON string."""

    def letter(c: Column) -> Column:
        out = F.when(c.rlike(PLAIN), c)
        for plain, escape in ESCAPES.items():
            out = out.when(c == plain, F.lit(escape))
        return out.otherwise(F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1"))

    # Runs of plain characters stay whole, so the work goes with the number of others.
    escaped = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)[ !#-\[\]-~]+|."), F.lit(0)), letter), "")
    return F.concat(F.lit('"'), F.when(text.rlike(PLAIN), text).otherwise(escaped), F.lit('"'))


def _shortest(x: Column) -> Column:
    """A finite, positive double as (digits, power): the shortest ``digits`` for which 0.digits times 10 to ``power`` reads back as x.

    Java's text reads back as x but may have a digit or two too many, so shorter ones are tried, cut
    down and cut up. Of two that read back alike the nearer to x's exact value is taken, for x between
    1e-5 and 9e18; elsewhere the nearer to Java's text, which seldom differs from it.
    """
    text = x.cast("string")
    mantissa = F.substring_index(text, "E", 1)
    whole, fraction = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
    exponent = F.coalesce(F.regexp_extract(text, "E(-?[0-9]+)", 1).try_cast("int"), F.lit(0))
    every = F.concat(whole, fraction)
    digits = F.regexp_replace(F.regexp_replace(every, "^0+", ""), "0+$", "")
    zeros = F.length(every) - F.length(F.regexp_replace(every, "^0+", ""))
    first = F.struct(digits.alias("digits"), (F.length(whole) + exponent - zeros).cast("int").alias("power"))

    def above(middle: Column, power: Column) -> Column:
        """Whether x lies above the decimal 0.``middle`` (18 digits) times 10 to ``power``: 1, -1 or 0; null where that can't be told."""
        # x times a power of ten is compared with a whole number, without an error.
        k = F.lit(18) - power
        ten = F.struct(*[F.get(F.lit([f(10.0**i) for i in range(23)]), k).alias(n) for n, f in (("t", float), ("hi", lambda t: halves(t)[0]), ("lo", lambda t: halves(t)[1]))])
        scaled = bound(bound(ten, lambda t: product(x, t["t"], t["hi"], t["lo"])), lambda m: F.signum((m["p"].cast("long") - middle).cast("double") + m["e"]))
        return F.when(power == 19, F.signum((x.cast("long") - middle * 10).cast("double"))).when(k.between(0, 22), scaled)

    def shorter(d: Column) -> Column:
        n = F.length(d["digits"])

        def same(number: Column, less: int) -> Column:
            """The candidate, if it reads back as x."""
            size = n - less
            carried = F.length(number) - size  # 999 cut up is 1000
            back = F.concat(F.lit("0."), number, F.lit("E"), (d["power"] + carried).cast("string")).cast("double")
            return F.when((size > 0) & (back == x), F.struct(F.regexp_replace(number, "0+$", "").alias("digits"), (d["power"] + carried).cast("int").alias("power")))

        tries = []
        for less in (2, 1):
            down = F.substring(d["digits"], F.lit(1), n - less).try_cast("long")
            lo, hi = same(down.cast("string"), less), same((down + 1).cast("string"), less)
            middle = F.rpad(F.concat(down.cast("string"), F.lit("5")), 18, "0").cast("long")
            side = F.coalesce(above(middle, d["power"]), F.lit(0.0))
            cut = F.substring(d["digits"], n - less + 1, F.lit(1)) >= "5"
            up = (side > 0) | ((side == 0) & cut)
            tries += [F.when(lo.isNotNull() & hi.isNotNull(), F.when(up, hi).otherwise(lo)).otherwise(F.coalesce(lo, hi))]
        return F.when((n >= 16) | (x < 1e-300), F.coalesce(*tries, d)).otherwise(d)

    return bound(first, shorter)


def number(x: Column) -> Column:
    """A double as JSON: the shortest digits, plain between 1e-4 and 1e16, else with an exponent of two digits at least."""

    def laid_out(s: Column) -> Column:
        digits, power, n = s["digits"], s["power"], F.length(s["digits"])
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power), digits)
        middle = F.concat(F.substring(digits, F.lit(1), power), F.lit("."), F.substring(digits, power + 1, n))
        large = F.concat(digits, F.repeat(F.lit("0"), power - n), F.lit(".0"))
        e = power - 1
        head = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""))
        powered = F.concat(head, F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
        powered = F.when(F.abs(e) > 99, F.concat(head, F.when(e < 0, "e-").otherwise("e+"), F.abs(e).cast("string"))).otherwise(powered)
        return F.when((power > -4) & (power <= 0), small).when((power > 0) & (power < n), middle).when((power >= n) & (power <= 16), large).otherwise(powered)

    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
    finite = F.when(x == 0, F.lit("0.0")).otherwise(bound(_shortest(F.abs(x)), laid_out))
    return F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("Infinity"))).otherwise(F.concat(sign, finite))


def canonical(x: Column, kind: DataType) -> Column:
    """The canonical JSON of a column of the given type; ``null`` for null."""
    if isinstance(kind, NullType):
        return F.lit("null")
    if isinstance(kind, StructType):
        parts = []
        for f in sorted(kind.fields, key=lambda f: f.name):
            parts += [F.lit(("," if parts else "") + _key(f.name) + ":"), canonical(x.getField(f.name), f.dataType)]
        text = F.concat(F.lit("{"), *parts, F.lit("}"))
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(x, lambda y: canonical(y, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, MapType):
        if not isinstance(kind.keyType, StringType):
            raise TypeError("canonical JSON needs string keys")
        keys = F.array_sort(F.map_keys(x))
        pair = lambda k: F.concat(quoted(k), F.lit(":"), canonical(x[k], kind.valueType))
        text = F.concat(F.lit("{"), F.array_join(F.transform(keys, pair), ","), F.lit("}"))
    elif isinstance(kind, BooleanType | IntegralType):
        text = x.cast("string")
    elif isinstance(kind, DoubleType | FloatType):
        text = bound(x.cast("double"), number)
    elif isinstance(kind, StringType):
        text = bound(x, quoted)
    elif isinstance(kind, TimestampType | TimestampNTZType):
        part = F.date_format(x, "yyyy-MM-dd HH:mm:ss")
        text = quoted(F.when(F.date_format(x, "SSSSSS") == "000000", part).otherwise(F.concat(part, F.lit("."), F.date_format(x, "SSSSSS"))))
    elif isinstance(kind, BinaryType):
        text = quoted(F.lower(F.hex(x)))
    elif isinstance(kind, DateType | DecimalType):
        text = quoted(x.cast("string"))
    else:
        raise TypeError(f"no canonical JSON for {kind.simpleString()}")
    return F.when(x.isNull(), F.lit("null")).otherwise(text)


def _key(name: str) -> str:
    import json

    return json.dumps(name)


def canonical_row(df, columns: list[str] | None = None) -> Column:
    """The canonical JSON of a row's columns."""
    kind = StructType([f for f in df.schema.fields if columns is None or f.name in columns])
    return canonical(F.struct(*[df[f.name] for f in kind.fields]), kind)


def raw_hash(text: Column) -> Column:
    """SHA-256 of canonical JSON, in hexadecimal."""
    return F.sha2(text, 256)
