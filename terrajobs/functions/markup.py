"""Text of HTML pages, as columns."""

from __future__ import annotations

from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column, functions as F

#: Elements whose direct text is not shown on a page.
HIDDEN_ELEMENTS = frozenset({"noscript", "header", "html", "meta", "head", "input", "script", ""})
# Elements without content, and those whose content is text up to their own end tag.
VOID_ELEMENTS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_RAW = ("script", "style")

_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+"""
_RAW_START = r"<(?i:%s)(?=[\s/>])" + _ATTRIBUTES + "(?<!/)>"
#: Comments; raw elements with their content; declarations and end tags; start tags; text.
_TOKENS = "|".join(
    [r"<!--[\s\S]*?--\s*+>", *(_RAW_START % n + rf"[\s\S]*?(?=</(?i:{n})\s*+>|\z)" for n in _RAW), r"<[!?/](?!--)[^>]*+>", r"<[a-zA-Z][^\s/>]*+" + _ATTRIBUTES + ">", "[^<]+", "<"]
)
#: Tokens that are folded together before they join the others, so that long pages do not copy all their text for every tag.
_BLOCK = 256


@lru_cache(maxsize=1)
def _references() -> tuple[str, str]:
    """Named character references as a text of entries, short names first, and a pattern of those that need no semicolon, long names first."""
    bare = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    entries = (f"{n}\x1f{html5[n]}" for n in sorted(html5, key=lambda n: (len(n), n)))
    return "\x1e".join(entries), "^(?:" + "|".join(bare) + ")"


def _numbered(ref: Column) -> Column:
    """The character of ``&#233;`` or ``&#xE9;``; numbers that are none give U+FFFD, 128 to 159 Windows letters, other control characters nothing."""
    digits = F.regexp_extract(ref, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    code = F.when(F.length(digits) > 8, F.lit(2**31)).otherwise(F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint"))
    code = F.coalesce(code, F.lit(0))
    windows = F.array(*(F.lit(bytes([n]).decode("cp1252", "replace")) for n in range(0x80, 0xA0)))
    control = code.between(0x1, 0x8) | code.between(0xE, 0x1F) | (code == 0xB) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF) | (code % 0x10000 >= 0xFFFE)
    none = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    spelled = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(none, F.lit("�")).when(code.between(0x80, 0x9F), F.get(windows, (code - 0x80).cast("int"))).when(control, F.lit("")).otherwise(spelled)


def unescape(col: Column) -> Column:
    """Text with its character references spelled out, also such as ``&eacute`` without a semicolon; unknown names stay."""
    named, bare = _references()
    # A foldable call: the plan holds one literal map, not an expression an entry.
    known = F.str_to_map(F.lit(named), F.lit("\x1e"), F.lit("\x1f"))

    def spelled(piece: Column) -> Column:
        name = F.substr(piece, F.lit(2))
        prefix = F.regexp_extract(name, bare, 0)
        by_prefix = F.concat(F.try_element_at(known, prefix), F.substr(name, F.length(prefix) + 1))
        by_name = F.coalesce(F.try_element_at(known, name), by_prefix, piece)
        return F.when(piece.startswith("&#") & (F.length(piece) > 2), _numbered(piece)).when(piece.startswith("&"), by_name).otherwise(piece)

    pieces = F.regexp_extract_all(col, F.lit(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"), F.lit(0))
    return F.when(F.contains(col, F.lit("&")), F.array_join(F.transform(pieces, spelled), "")).otherwise(col)


def _token(t: Column) -> Column:
    """(name of the tag, whether it opens or closes an element, text)."""
    name = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1))
    raw = t.rlike("^" + _RAW_START % f"(?:{'|'.join(_RAW)})")
    closed = t.endswith("/>") & ~t.rlike(r"""=\s*[^\s"'>=][^\s>"']*/>$""")
    opens = raw | ((name != "") & ~t.startswith("</") & ~name.isin(*VOID_ELEMENTS) & ~closed)
    text = F.when(raw, F.regexp_replace(t, "^" + _RAW_START % f"(?:{'|'.join(_RAW)})", "")).when((name == "") & ~t.rlike("^<[!?/]"), t)
    return F.struct(name.alias("name"), opens.alias("opens"), t.startswith("</").alias("closes"), text.alias("text"))


def _text(html: Column, hidden: frozenset) -> Column:
    no_words = F.array().cast("array<string>")
    tokens = F.transform(F.regexp_extract_all(html, F.lit(_TOKENS), F.lit(0)), _token)

    def step(state: Column, t: Column) -> Column:
        open_, name = state["open"], t["name"]
        since = F.array_position(F.reverse(open_), name).cast("int")
        after = F.when(t["opens"], F.concat(open_, F.array(name))).when(t["closes"] & (since > 0), F.slice(open_, 1, F.size(open_) - since)).otherwise(open_)
        parent = F.when(t["opens"], name).otherwise(F.coalesce(F.get(open_, F.size(open_) - 1), F.lit("")))
        shown = t["text"].isNotNull() & (~parent.isin(*sorted(hidden)) if hidden else F.lit(True))
        said = F.when(parent.isin(*_RAW), t["text"]).otherwise(unescape(t["text"]))
        return F.struct(after.alias("open"), F.when(shown, F.concat(state["out"], F.array(said))).otherwise(state["out"]).alias("out"))

    def block(state: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(state["open"].alias("open"), no_words.alias("out")), step)
        return F.transform(F.array(done), lambda d: F.struct(d["open"].alias("open"), F.concat(state["out"], d["out"]).alias("out")))[0]

    parts = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _BLOCK).cast("int")), lambda i: F.slice(all_, i * _BLOCK + 1, _BLOCK))
    empty = F.struct(no_words.alias("open"), no_words.alias("out"))
    folded = F.transform(F.array(tokens), lambda all_: F.when(F.size(all_) > 0, F.aggregate(parts(all_), empty, block)["out"]).otherwise(no_words))[0]
    return F.when(html.isNotNull(), F.trim(F.regexp_replace(F.lower(F.array_join(folded, " ")), r"[^\p{L}\p{N}.]+", " ")))


def html_to_text(html: Column | str) -> Column:
    """Text nodes whose direct parent is shown, lower case, with single spaces for all but letters, digits and full stops.

    An end tag closes its element and all that are open within it; one without an element is left out. A script or style holds text alone,
    to its end tag or the end of the page. A tag or comment that does not end is text. Null pages are null, empty ones are empty.
    """
    return _text(F.col(html) if isinstance(html, str) else html, HIDDEN_ELEMENTS)


def html_to_all_text(html: Column | str) -> Column:
    """Text of pages, whatever element holds it."""
    return _text(F.col(html) if isinstance(html, str) else html, frozenset())
