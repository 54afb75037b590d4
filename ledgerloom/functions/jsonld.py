"""JSON-LD of pages as columns: variants, without a parser of pages and without Python.

The nodes of a page are those of all its blocks of JSON-LD, lists opened and the members of @graph after the node that
holds them, to DEPTH steps of nesting; a block that isn't JSON has none.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions import text as T

#: Lists and graphs within one another that are opened, at most.
DEPTH = 4
_BLOCK = r"""(?is)<script\b(?=[^>]*\btype\s*=\s*(?:"[^"]*application/ld\+json|'[^']*application/ld\+json|[^\s"'>]*application/ld\+json))[^>]*>(.*?)</script\s*>"""


def _list(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _opened(v: Column, depth: int) -> Column:
    """The objects in a variant, in order."""
    none = F.array().cast("array<variant>")
    inside = (lambda items: F.flatten(F.transform(items, lambda x: _opened(x, depth - 1)))) if depth else (lambda items: F.filter(items, _is_object))
    graph = F.coalesce(inside(_list(v, '$["@graph"]')), none)
    return F.when(_is_object(v), F.concat(F.array(v), graph)).otherwise(F.coalesce(inside(_list(v)), none))


def nodes(html: Column, depth: int = DEPTH) -> Column:
    """The JSON-LD nodes of a page as an array of variants."""
    blocks = F.regexp_extract_all(T.text(html), F.lit(_BLOCK), F.lit(1))
    parsed = F.filter(F.transform(blocks, F.try_parse_json), lambda v: v.isNotNull())
    return F.flatten(F.transform(parsed, lambda v: _opened(v, depth)))


def is_posting(node: Column) -> Column:
    """True for a node whose @type is, or has in its list, JobPosting."""
    path = '$["@type"]'
    kinds = F.coalesce(F.try_variant_get(node, path, "array<string>"), F.array(F.try_variant_get(node, path, "string")))
    return F.coalesce(F.exists(kinds, lambda k: F.lower(F.trim(k)) == "jobposting"), F.lit(False))


def _said(node: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(F.try_variant_get(node, f"$.{n}", "string"), F.lit("")) for n in names], F.lit(""))


def postings(html: Column, depth: int = DEPTH) -> Column:
    """title and link of the JobPosting nodes of a page, in order."""
    found = F.filter(nodes(html, depth), is_posting)
    return F.transform(found, lambda v: F.struct(T.squeezed(_said(v, "title")).alias("title"), F.trim(_said(v, "url", "sameAs")).alias("link")))
