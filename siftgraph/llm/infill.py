r"""Fill-in-middle transformation by escaped marker injection.

A delimiter character (U+0001) is made free by escaping it and the escape
character (U+0002) in the text, then appended after each unit by one
``regexp_replace``. Counting it gives the number of units; ``substring_index``
extracts the units before the first cut, between the cuts and after the second;
these parts lose their delimiters, are unescaped and put together around the
markers of a form. Everything is a built-in expression on the document's own
row: no shuffle, no Python.

Units are code points, words (with the white space after them) or lines; a
pattern of one's own must match every character of the escaped text and keep
escapes (U+0002 with ``a`` or ``b``) together. Where the cuts fall, and which form
a document gets, depends on its id and the seed alone.

Forms: ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle), ``plain``
(the text as it stands: it is empty, it holds a marker, or its number says so).
Markers must begin with a character that occurs in no marker again, so that no
part can make one up together with its neighbour and ``restored`` is exact.

A null text is empty. A null id takes the digest of the seed alone. Repeated
rows get the same result each; other columns are ignored, whatever their names;
an empty table gives an empty one. Texts of any length take linear time and a few
copies of themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITER, ESCAPE = "\x01", "\x02"
#: One unit of an escaped text.
UNITS = {
    "code points": "(?s)\x02[ab]|.",
    "words": r"(?U)\s*[^\s]+\s*|\s+",
    "lines": r"[^\n]*\n|[^\n]+",
}
MARKERS = ("<P>", "<S>", "<M>")


def marked(text: Column, units: str = "code points") -> Column:
    """The escaped text with the delimiter after each unit."""
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "a")), F.lit(DELIMITER), F.lit(ESCAPE + "b"))
    return F.regexp_replace(escaped, UNITS.get(units, units), "$0" + DELIMITER)


def count(text: Column) -> Column:
    """Delimiters in a marked text."""
    return (F.length(text) - F.length(F.replace(text, F.lit(DELIMITER), F.lit("")))).cast("long")


def unmarked(part: Column) -> Column:
    """A part of a marked text as it was."""
    bare = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "b"), F.lit(DELIMITER)), F.lit(ESCAPE + "a"), F.lit(ESCAPE))


def before(text: Column, mark: str | Column, n: int | Column) -> Column:
    """What stands before the n-th mark, or after the n-th from the end if n is negative."""
    return F.call_function("substring_index", text, F.lit(mark) if isinstance(mark, str) else mark, (F.lit(n) if isinstance(n, int) else n).cast("int"))


def draw(id_: Column, seed: int, k: int) -> Column:
    """The k-th of four numbers below 2^32 that belong to an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transformed(
    docs: DataFrame, units: str = "code points", seed: int = 1, transform_percent: int = 90, spm_percent: int = 20, markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, text, n (units), form, prefix, middle, suffix (null if plain), output."""
    if any(m[:1] in n[1:] for m in markers for n in markers) or not all(markers) or len(set(markers)) < 3:
        raise ValueError("markers must differ and begin with a character that occurs in none of them again")
    p, s, m = map(F.lit, markers)
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.select("id", "text", marked(F.col("text"), units).alias("marked"), *[draw(F.col("id"), seed, k).alias(f"h{k + 1}") for k in range(4)])
    rows = rows.withColumn("n", count(F.col("marked")))
    holds = F.lit(False)
    for x in markers:
        holds = holds | F.col("text").contains(x)
    plain = (F.col("text") == "") | holds | (F.col("h3") % 100 >= transform_percent)
    cuts = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.select("id", "text", "marked", "n", F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm").alias("form"), F.least(*cuts).alias("lo"), F.greatest(*cuts).alias("hi"))
    whole, d, n, lo, hi = F.col("marked"), DELIMITER, F.col("n"), F.col("lo"), F.col("hi")
    # The first hi units end without their delimiter, so the last hi - lo of them count from there; the text ends with one.
    parts = {
        "prefix": before(whole, d, lo),
        "middle": before(before(whole, d, hi), d, lo - hi),
        "suffix": before(whole, d, hi - n - 1),
    }
    rows = rows.select("id", "text", "n", "form", *[F.when(F.col("form") != "plain", unmarked(x)).alias(k) for k, x in parts.items()])
    prefix, middle, suffix = map(F.col, parts)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    return rows.select(F.col("id").alias(id_col), "text", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text, from a transformed one and its form."""
    p, s, m = markers
    head, middle = before(output, m, 1), before(output, m, -1)
    psm = F.concat(before(before(head, s, 1), p, -1), middle, before(head, s, -1))
    spm = F.concat(before(head, p, -1), middle, before(before(head, p, 1), s, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n, form, prefix_chars, middle_chars (null if plain), output_sha256, restored_sha256."""
    rows = transformed(docs, id_col=id_col, text_col=text_col)
    rows = rows.select(id_col, "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), "output")
    return rows.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def oracle_sql() -> str:
    """``digests`` in DuckDB, by positions instead of delimiters."""
    h = ", ".join(f"('0x' || substr(x, {8 * k + 1}, 8))::bigint as h{k + 1}" for k in range(4))
    return f"""with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, ''))::bigint as n, sha256('1:' || doc_id) as x from documents),
e as (select doc_id, text, n, {h} from d),
f as (select doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from e),
g as (select *, substring(text, 1, lo) as a, substring(text, lo + 1, hi - lo) as b, substring(text, hi + 1, n - hi) as c from f)
select doc_id, n, form, case when form <> 'plain' then lo end as prefix_chars, case when form <> 'plain' then hi - lo end as middle_chars,
sha256(case form when 'psm' then '<P>' || a || '<S>' || c || '<M>' || b when 'spm' then '<S>' || c || '<P>' || a || '<M>' || b else text end) as output_sha256, sha256(text) as restored_sha256 from g"""
