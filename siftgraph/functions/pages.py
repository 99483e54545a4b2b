"""Facts in page sources as Column expressions.

Character references are resolved by a pandas UDF, applied to the extracted
strings alone (a title, never a page), since no built-in function has the table
of names."""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .domains import plausible_tracker

# Tracker ids and the copyright notice in page sources.
TRACKERS = (r"UA-[0-9]{4,10}-[0-9]{1,4}", r"G-[A-Z0-9]{6,12}", r"GTM-[A-Z0-9]{4,10}", r"ca-pub-[0-9]{10,20}")
COPYRIGHT = r"(?i)(?:\x{00A9}|&copy;|copyright)\s*(?:[0-9]{4}(?:\s*[-\x{2013}\x{2014}]\s*[0-9]{4})?)?[\s,]*([A-Za-z0-9][A-Za-z0-9&.,'\- ]{2,60})"
# Endings of legal names, statements that name a legal entity, paths of legal pages.
LEGAL_SUFFIX = r"(?:Inc\.?|Incorporated|LLC|L\.L\.C\.?|Ltd\.?|Limited|Corporation|Corp\.?|Company|Co\.?|plc|L\.P\.?|LP|GmbH|S\.A\.?|B\.V\.?)"
LEGAL_ENTITY = (
    r"(?i)\b(?:legal\s+(?:name|entity)|company\s+name|owned\s+and\s+operated\s+by|operated\s+by|provided\s+by|website\s+is\s+operated\s+by)\s*[:\-]?\s*"
    r"([A-Z][A-Za-z0-9&'\x{2019}.,()\- ]{1,100}?\s+" + LEGAL_SUFFIX + r")(?=[.,;)]|$|\s+(?:is|with|whose|which|that|registered|having)\b)"
)
LEGAL_PATH = r"(?i)(?:^|/)(?:privacy(?:-policy)?|terms(?:-of-(?:use|service))?|legal|imprint|impressum|about|company)(?:[/.?#-]|$)"


@F.pandas_udf(StringType())
def unescaped(s: pd.Series) -> pd.Series:
    """Character references resolved; the table of names is beyond built-in functions."""
    return s.map(html.unescape, na_action="ignore")


#: A character reference with its semicolon.
CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


def _closed(s: str) -> str:
    known = lambda x: x[1] == "#" or x[1:] in html.entities.html5
    return CLOSED.sub(lambda m: html.unescape(m[0]) if known(m[0]) else m[0], s)


@F.pandas_udf(StringType())
def unescaped_closed(s: pd.Series) -> pd.Series:
    """Character references with their semicolon resolved; ``&amp`` without one stays as it is."""
    return s.map(_closed, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def joined_urls(base: pd.Series, links: pd.Series) -> pd.Series:
    """Links resolved against their page, without fragments; unusable ones left out."""

    def one(b, hrefs):
        out = []
        for h in hrefs if hrefs is not None else []:
            try:
                out.append(urljoin(b or "", html.unescape(h).strip()).split("#")[0])
            except ValueError:
                continue
        return out

    return pd.Series([one(b, h) for b, h in zip(base, links)])


def spaces(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


# Where a page states its title and description.
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
DESCRIPTION = r"""(?is)<meta[^>]+name=["']description["'][^>]+content=["'](.*?)["']"""


def title(source: Column, most: int = 200, closed: bool = False) -> Column:
    """``closed``: only character references with their semicolon are resolved, else all that a browser knows."""
    resolved = unescaped_closed if closed else unescaped
    return F.substring(spaces(resolved(F.regexp_extract(source, TITLE, 1))), 1, most)


def description(source: Column, most: int = 300) -> Column:
    return F.substring(spaces(unescaped(F.regexp_extract(source, DESCRIPTION, 1))), 1, most)


def trackers(source: Column, whole: bool = False) -> Column:
    """Distinct plausible tracker ids, sorted. Longer ones than any tracker's are cut off, or come ``whole``."""
    kinds = [re.sub(r"\{([0-9]+),[0-9]+\}$", r"{\1,}", t) if whole else t for t in TRACKERS]
    found = F.concat(*[F.regexp_extract_all(source, F.lit(f"({t})"), F.lit(1)) for t in kinds])
    return F.array_sort(F.array_distinct(F.filter(found, plausible_tracker)))


def copyright_owner(source: Column) -> Column:
    """The name in the first copyright notice, without "all rights reserved"."""
    name = spaces(F.regexp_extract(source, COPYRIGHT, 1))
    return F.regexp_replace(F.regexp_replace(name, r"(?i)all rights reserved.*$", ""), r"^[ .,|-]+|[ .,|-]+$", "")


def plain_text(source: Column) -> Column:
    return spaces(unescaped(F.regexp_replace(F.regexp_replace(source, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]+>", " ")))


def legal_entities(source: Column) -> Column:
    """Owners named on legal pages, first spelling of each, in order."""
    text = spaces(unescaped(F.regexp_replace(source, r"<[^>]+>", " ")))
    names = F.transform(F.regexp_extract_all(text, F.lit(LEGAL_ENTITY), F.lit(1)), lambda x: F.regexp_replace(spaces(x), r"^[ ,.;:-]+|[ ,.;:-]+$", ""))
    return folded_once(names)


@F.pandas_udf(ArrayType(StringType()))
def folded_once(names: pd.Series) -> pd.Series:
    """The first spelling of each name, compared by full case folding, in order."""

    def one(xs):
        out: dict[str, str] = {}
        for x in xs if xs is not None else []:
            out.setdefault(x.casefold(), x)
        return list(out.values())

    return names.map(one)


def legal_links(source: Column, base: Column, most: int = 2) -> Column:
    """Same-owner links to legal pages, the first few distinct ones."""
    from .domains import normalized_domain, registrable

    links = joined_urls(base, F.regexp_extract_all(source, F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), F.lit(1)))
    # The cheap tests come first; the owner is compared for what they leave. (A lambda may not hold the links' UDF, so the page's owner stands in each comparison.)
    legal = F.filter(links, lambda u: u.rlike("^https?://") & F.regexp_extract(u, r"^https?://[^/?#]*([^?#]*)", 1).rlike(LEGAL_PATH))
    apex = registrable(normalized_domain(base))
    own = F.filter(legal, lambda u: registrable(normalized_domain(u)) == apex)
    return F.slice(F.array_distinct(own), 1, most)


def compared(name: str) -> str:
    """A name as it is compared: compatibility forms, case folded, other than word characters as single spaces."""
    return " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", name).casefold()))


@F.pandas_udf(StringType())
def plain_name(name: pd.Series) -> pd.Series:
    return name.map(compared, na_action="ignore")


@F.pandas_udf(StringType())
def titled(label: pd.Series) -> pd.Series:
    """Capitals after every character that isn't a letter, unlike ``initcap``."""
    return label.map(str.title, na_action="ignore")


def redirect_domain(domain: Column, final_url: Column) -> Column:
    """The owner's domain that a page's last address belongs to, where it isn't the asked one's; else empty."""
    from .domains import normalized_domain, registrable

    host = F.regexp_extract(F.lower(final_url), r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    apex = registrable(normalized_domain(host))
    return F.coalesce(F.when(apex != registrable(domain), apex), F.lit(""))


def root_alias(domain: Column) -> Column:
    return titled(F.regexp_replace(F.split_part(domain, F.lit("."), F.lit(1)), "-", " "))


def page_records(fetched: DataFrame, whole: bool = False) -> DataFrame:
    """Records of fetched pages (domain, html, final_url, legal_html): the facts of the page and those of its legal page.

    A missing page gives the alias alone; ``legal_html`` may be null. ``whole``: see ``trackers``.
    """
    html_, legal = F.coalesce("html", F.lit("")), F.coalesce("legal_html", F.lit(""))
    alias = root_alias(F.col("domain"))
    return fetched.select(
        "domain",
        title(html_).alias("title"),
        description(html_).alias("description"),
        F.filter(F.array(alias), lambda x: x != "").alias("aliases"),
        trackers(html_, whole).alias("tracker_ids"),
        copyright_owner(html_).alias("copyright_org"),
        F.coalesce("final_url", F.lit("")).alias("final_url"),
        redirect_domain(F.col("domain"), F.coalesce("final_url", F.lit(""))).alias("redirect_domain"),
        legal_entities(legal).alias("legal_entities"),
    )


def verified_trackers(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Candidates (domain, tracker_id) whose own root page (domain, html) holds the exact tracker: a semi join on both."""
    held = pages.select("domain", F.explode(F.transform(trackers(F.coalesce("html", F.lit(""))), F.upper)).alias("tracker_id")).distinct()
    asked = candidates.withColumn("tracker_id", F.upper(F.trim("tracker_id")))
    return asked.join(held, ["domain", "tracker_id"], "left_semi")
