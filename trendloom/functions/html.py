"""Column expressions that read HTML: its tokens, attributes and entities.

A page is one regular expression's matches in order, the states of the HTML
tokenizer as alternatives: comments (up to ``-->`` or the end of the page), other
declarations, elements whose content is raw text (a script holds no tags), and tags
with quoted, unquoted and empty attributes.  A tag that is never closed is no tag.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the elements whose content is text up to their own end tag
RAW_TEXT = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
ATTRIBUTE = r"""[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?"""
_ATTRIBUTES = rf"(?:[\s/]+|{ATTRIBUTE}|=)*+"
COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\z))"
DECLARATION = r"<[!?][^>]*+>?"
RAW_ELEMENT = rf"<({'|'.join(RAW_TEXT)})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])|\z)"
TAG = rf"</?[a-z][^\s/>]*+{_ATTRIBUTES}>"
TOKEN = rf"(?is){COMMENT}|{DECLARATION}|{RAW_ELEMENT}|{TAG}"
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?!=)))"
_PAIR, _IS = "\x01", "\x02"


def tags(html: Column) -> Column:
    """The start tags of a page in order, each as it stands; of a raw-text
    element its start tag and its text."""
    tokens = F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))
    return F.filter(tokens, lambda t: t.rlike(r"^<[A-Za-z]"))


def is_element(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?i)^<{name}[\s/>]")


def attributes(tag: Column) -> Column:
    """The attributes of a start tag as strings ``name``, ``name=value``, in order."""
    inside = F.regexp_extract(tag, rf"(?s)^<[A-Za-z][^\s/>]*+({_ATTRIBUTES})>", 1)
    return F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(0))


def attribute(found: Column, name: str) -> Column:
    """The decoded value of the first attribute called ``name`` in an array made
    by ``attributes``; '' if it has none, null without the attribute."""
    named = F.filter(found, lambda a: F.lower(F.trim(F.substring_index(a, "=", 1))) == name.lower())
    first = F.get(named, F.lit(0))
    value = F.when(F.contains(first, F.lit("=")), F.regexp_replace(first, r"^[^=]*=\s*", "")).otherwise(
        F.when(first.isNotNull(), F.lit("")))
    return unescape(F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2"))


def _entities() -> Column:
    """Name (with ';' where it needs one) -> text, from the standard library's table."""
    return F.str_to_map(F.lit(_PAIR.join(f"{k}{_IS}{v}" for k, v in html5.items())), F.lit(_PAIR), F.lit(_IS))


def _windows() -> Column:
    """The code points that numbers 128 to 159 stand for, by the HTML standard."""
    pairs = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}
    return F.str_to_map(F.lit(_PAIR.join(f"{n}{_IS}{ord(c)}" for n, c in pairs.items() if c)), F.lit(_PAIR), F.lit(_IS))


def unescape(text: Column) -> Column:
    """Character references decoded: numbers in either base and the whole named
    table.  A name without ';' counts only if all of it is one of the names that need
    none, and not before '=' (as in a query string).  Numbers that are no
    character become U+FFFD."""
    def number(ref: Column) -> Column:
        hexadecimal = ref.rlike("^&#[xX]")
        digits = F.regexp_extract(ref, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
        code = F.when(F.length(digits) > 7, F.lit(0)).when(hexadecimal, F.conv(F.concat(F.lit("0"), digits), 16, 10)).otherwise(
            F.concat(F.lit("0"), digits)).cast("int")
        code = F.coalesce(F.try_element_at(_windows(), code.cast("string")).cast("int"), code)
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")

    def one(part: Column) -> Column:
        named = F.coalesce(F.try_element_at(_entities(), F.substring(part, 2, 64)), part)
        return F.when(~part.startswith("&"), part).when(part.startswith("&#") & (F.length(part) > 2), number(part)).otherwise(named)

    parts = F.regexp_extract_all(text, F.lit(rf"{ENTITY}|[^&]+|&"), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(text)
