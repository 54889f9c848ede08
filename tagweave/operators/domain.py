"""The domain a page belongs to.

The registered domain is the longest known public suffix plus one label.  The
suffix list is a parameter; by default every last label is a suffix, and so are
the listed ones of several labels, as the public list isn't on board.  A page's domain is that of its ``base`` element (also a
commented one in the head), else the most frequent domain of its links that
isn't blacklisted, ties going to the first in alphabetical order, else ''.

Defined results: null and unparsable links count for nothing; IP addresses and
hosts that are a suffix themselves have the domain ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common public suffixes of two labels.
SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "com.au", "net.au", "org.au", "edu.au", "co.nz", "org.nz", "co.jp", "or.jp", "ne.jp", "ac.jp", "com.br", "org.br", "com.mx", "com.ar", "com.tr", "com.cn", "com.hk", "com.sg", "com.tw",
    "co.in", "co.il", "co.kr", "co.za", "com.pl", "net.pl", "co.at", "or.at", "ac.at", "com.es", "org.es", "com.pt", "com.ua", "com.ru", "co.example",
]
# Domains many pages link to.
BLACKLIST = ["google.com", "twitter.com", "facebook.com", "youtube.com", "fonts.com", "googleapis.com", "fonts.net", "addthis.com", "flickr.com", "paypal.com", "pinterest.com", "linkedin.com"]


def host(url: Column) -> Column:
    """Host of a URL: after the scheme or ``//``, without user, port and dot."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"\A\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1), r"\.+\z", ""))


def registered_domain(url: Column, suffixes: list[str] | None = None) -> Column:
    """The registered domain of a URL or '' (an expression; no join)."""
    name = host(url)
    labels = F.split(name, r"\.")
    n = F.size(labels)
    known = F.array(*[F.lit(s) for s in (SUFFIXES if suffixes is None else suffixes)])
    deepest = max((s.count(".") + 1 for s in (SUFFIXES if suffixes is None else suffixes)), default=1)
    numeric = name.rlike(r"\A[0-9.]+\z") | name.startswith("[")
    out = F.when((n > 1) & ~numeric, F.array_join(F.slice(labels, n - 1, 2), ".")).otherwise("") if suffixes is None else F.lit("")
    for k in range(1, deepest + 1):  # the longest suffix wins
        tail = F.when(n > k, F.array_join(F.slice(labels, n - k + 1, k), "."))
        out = F.when(F.array_contains(known, tail), F.array_join(F.slice(labels, n - k, k + 1), ".")).otherwise(out)
    return F.when(url.isNull() | F.array_contains(known, name), F.lit("")).otherwise(out)


def guess_domain(links: DataFrame, doc_id: str, url: str, blacklist: list[str] | None = None) -> DataFrame:
    """``(doc_id, domain)`` of the documents with a usable link.  Counts per
    (document, domain) are partial before the shuffle; the rest is one max."""
    domains = links.select(F.col(doc_id).alias("doc_id"), registered_domain(F.col(url)).alias("domain")).where(F.col("domain") != "")
    kept = domains.where(~F.col("domain").isin(*(BLACKLIST if blacklist is None else blacklist)))
    counted = kept.groupBy("doc_id", "domain").agg(F.count("*").alias("n"))
    return counted.groupBy("doc_id").agg(F.min_by("domain", F.struct(-F.col("n"), F.col("domain"))).alias("domain"))


def base_href(html: Column) -> Column:
    """``href`` of the base element, else of a commented one in the head."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")
    real = F.regexp_extract(bare, r"(?i)<base\b[^>]*?\shref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    head = F.regexp_extract(html, r"(?is)\A(.*?)(?:</head|<body|\z)", 1)
    comment = F.regexp_extract(head, r"(?is)<!--(?:(?!-->).)*?base\s+href=\"([^\"]*)\"", 1)
    return F.when(real != "", real).when(comment != "", comment).otherwise(F.lit(""))


def page_domain(pages: DataFrame, doc_id: str, html: str) -> DataFrame:
    """``(doc_id, domain)`` of every page; '' where nothing is known."""
    hrefs = F.regexp_extract_all(F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)", ""), F.lit(r"(?i)<[a-z][^>]*?\shref\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    links = pages.select(F.col(doc_id).alias("doc_id"), F.explode(hrefs).alias("url"))
    guessed = guess_domain(links, "doc_id", "url").withColumnRenamed("domain", "guess")
    base = pages.select(F.col(doc_id).alias("doc_id"), registered_domain(base_href(F.col(html))).alias("base"))
    return base.join(guessed, "doc_id", "left").select("doc_id", F.when(F.col("base") != "", F.col("base")).otherwise(F.coalesce("guess", F.lit(""))).alias("domain"))
