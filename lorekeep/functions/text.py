"""Text expressions: HTML to plain text, layer references, message intent."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import strip

# --- HTML -----------------------------------------------------------------------------------

# Elements whose content is never shown as text.
_SILENT = ("script", "style", "template")

# Whatever starts first is taken, up to its closing mark or the end of the text. A quoted attribute
# may hold '>'. Possessive, so that no start is tried twice at length.
_MARKUP = "(?is)" + "|".join(
    (
        r"<!--.*?(?:-->|\z)",
        rf"<({'|'.join(_SILENT)})\b[^>]*+(?:>.*?(?:</\1\s*+>|\z)|\z)",
        r"""<[/!?A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>""",
        r"<[/!?A-Za-z][^>]*+(?:>|\z)",
    )
)

# Entities met on nearly every page are tried before the full table.
_FREQUENT = ("amp", "lt", "gt", "quot", "nbsp", "apos")

_NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
# Names that are also read without the closing ';', longest first so "notin" wins over "not".
_BARE = {name: text for name, text in html5.items() if not name.endswith(";")}
_BARE_PATTERN = "^&(" + "|".join(sorted(_BARE, key=len, reverse=True)) + ")"


def _c1_text(code: int) -> str:
    """Codes 0x80-0x9F mean the Windows-1252 character, where there is one."""
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


def _literal_map(table: dict[str, str]) -> Column:
    """Constant map; built from JSON so the plan holds one literal, folded once."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _character(code: Column) -> Column:
    """Text of a numeric character reference."""
    utf32 = F.unhex(F.lpad(F.hex(code), 8, "0"))
    c1 = F.array(*[F.lit(_c1_text(c)) for c in range(0x80, 0xA0)])
    dropped = (
        code.between(0x1, 0x8)
        | code.isin(0xB)
        | code.between(0xE, 0x1F)
        | (code == 0x7F)
        | code.between(0xFDD0, 0xFDEF)
        | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    )
    return (
        F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("�"))
        .when(code.between(0x80, 0x9F), F.get(c1, (code - 0x80).cast("int")))
        .when(dropped, F.lit(""))
        .otherwise(F.decode(utf32, "UTF-32"))
    )


def _decode_piece(piece: Column) -> Column:
    """Decode the entity a piece starts with; pieces are cut before each ``&``."""
    decimal = F.regexp_extract(piece, "^&#([0-9]+);?", 1)
    hexadecimal = F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]+);?", 1)
    named = F.regexp_extract(piece, "^&([A-Za-z][A-Za-z0-9]{1,31});", 1)
    bare = F.regexp_extract(piece, _BARE_PATTERN, 1)

    def rest(skip: Column) -> Column:
        return F.substring(piece, skip + F.lit(1), F.length(piece))

    after_number = F.regexp_replace(piece, "^&#(?:[xX][0-9a-fA-F]+|[0-9]+);?", "")
    # A number too long to read is past the last code point, and treated like code 0.
    hex_digits = F.regexp_replace(hexadecimal, "^0+(?=.)", "")
    hex_value = F.when(F.length(hex_digits) <= 8, F.conv(hex_digits, 16, 10))

    def character(number: Column) -> Column:
        code = F.coalesce(number.try_cast("bigint"), F.lit(0))
        return F.get(F.transform(F.array(code), _character), 0)  # names the code once

    out = F.when(~piece.startswith("&"), piece)
    for name in _FREQUENT:
        out = out.when(
            piece.startswith(f"&{name};"),
            F.concat(F.lit(_NAMED[name]), rest(F.lit(len(name) + 2))),
        )
    named_text = F.try_element_at(_literal_map(_NAMED), named)
    return (
        out.when(decimal != "", F.concat(character(decimal), after_number))
        .when(hexadecimal != "", F.concat(character(hex_value), after_number))
        .when(
            (named != "") & named_text.isNotNull(),
            F.concat(named_text, rest(F.length(named) + F.lit(2))),
        )
        .when(
            bare != "",
            F.concat(
                F.try_element_at(_literal_map(_BARE), bare), rest(F.length(bare) + F.lit(1))
            ),
        )
        .otherwise(piece)
    )


def unescape_html(text: Column) -> Column:
    """Decode every entity once, left to right."""
    # ``text`` is named once: a second mention would evaluate the whole chain below it again.
    return F.array_join(F.transform(F.split(text, "(?=&)"), _decode_piece), "")


def strip_markup(html: Column) -> Column:
    """Replace comments, silent elements and tags by a space, in one pass over the text."""
    return F.regexp_replace(html, _MARKUP, " ")


def html_to_text(html: Column) -> Column:
    """Readable text of an HTML fragment; null becomes an empty string.

    Entities are decoded twice, as text that was escaped twice is common in descriptions.
    """
    text = unescape_html(unescape_html(strip_markup(html)))
    return F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


# --- References to layers and items -----------------------------------------------------------


def _is_map_viewer(text: Column) -> Column:
    return text.contains("apps/mapviewer") & text.contains("url=")


def _is_service(text: Column) -> Column:
    return text.contains("/FeatureServer") | text.contains("/MapServer")


def parse_layer_ref(reference: Column) -> Column:
    """Struct (kind, url, item_id, layer_index) of an item id, service URL or map-viewer URL.

    ``layer_index`` is null for a URL that already names one layer, and 0 where a service or map
    viewer does not say which.
    """
    ref = strip(reference)
    query = F.regexp_extract(ref, r"\?([^#]*)", 1)
    raw_param = F.regexp_extract(query, r"(?:^|&)url=([^&]+)", 1)
    viewer_url = F.coalesce(F.try_url_decode(raw_param), raw_param)
    names_layer = ref.rlike("/[0-9]+/?$")

    def target(kind: str, url: Column | None, item: Column | None, index: Column | None) -> Column:
        null = F.lit(None)
        return F.struct(
            F.lit(kind).alias("kind"),
            (null if url is None else url).cast("string").alias("url"),
            (null if item is None else item).cast("string").alias("item_id"),
            (null if index is None else index).cast("int").alias("layer_index"),
        )

    return (
        F.when(_is_map_viewer(ref) & (raw_param != ""), target("service_url", viewer_url, None, F.lit(0)))
        .when(
            _is_service(ref) & names_layer,
            target("service_url", F.regexp_replace(ref, "/+$", ""), None, None),
        )
        .when(_is_service(ref), target("service_url", ref, None, F.lit(0)))
        .otherwise(target("item_id", None, ref, None))
    )


def lookup_id(item_ref: Column) -> Column:
    """The id to look up: what follows ``id=`` up to ``&``, else the reference itself."""
    return F.when(
        item_ref.contains("id="), F.regexp_extract(item_ref, "id=([^&]*)", 1)
    ).otherwise(item_ref)


def target_class(ref: Column) -> Column:
    """What a parsed reference resolves to: ``item``, ``layer`` (one layer) or ``collection``."""
    one_layer = ref["url"].rlike("(^|/)[0-9]+/*$")
    return (
        F.when(ref["kind"] == "item_id", F.lit("item"))
        .when(one_layer, F.lit("layer"))
        .otherwise(F.lit("collection"))
    )


def _service_of_word(word: Column) -> Column:
    """The service URL that begins within a word, up to the last service name and the number behind it; null without one."""
    starts = [F.nullif(F.instr(word, scheme), F.lit(0)) for scheme in ("http://", "https://")]
    url = F.substring(word, F.least(*starts), F.length(word))
    # What stands behind the last name of each kind; the shorter rest belongs to the later name.
    rests = [F.when(url.contains(name), F.substring_index(url, name, -1)) for name in ("/FeatureServer", "/MapServer")]
    rest = F.when(F.length(rests[0]) <= F.coalesce(F.length(rests[1]), F.length(url)), rests[0]).otherwise(rests[1])
    number = F.substring(rest, F.lit(2), F.length(rest))
    digits = F.length(number) - F.length(F.ltrim(number, F.lit("0123456789")))
    kept = F.when(rest.startswith("/") & (digits > 0), digits + 1).otherwise(F.lit(0))
    return F.substring(url, F.lit(1), F.length(url) - F.length(rest) + kept)


def _hex_id(text: Column) -> Column:
    return (F.length(text) == 32) & (F.translate(text, "0123456789abcdef", "") == "")


def reference_in_text(text: Column) -> Column:
    """The layer or item a message talks about, null when there is none."""
    urls = F.transform(F.split(text, r"(?U)\s+"), _service_of_word)
    service = F.try_element_at(F.array_compact(urls), F.lit(1))
    word = F.try_element_at(F.filter(F.split(text, r"(?U)\W+"), _hex_id), F.lit(1))
    named = F.split(text, "id=")
    links = F.transform(F.slice(named, F.lit(2), F.size(named)), lambda p: F.substring(p, 1, 32))
    link = F.try_element_at(F.filter(links, _hex_id), F.lit(1))
    return (
        F.when(_is_map_viewer(text), strip(text))
        .when(_is_service(text), F.coalesce(service, strip(text)))
        .otherwise(F.coalesce(word, link))
    )


# Phrases that ask for a map preview or for a row count.
PREVIEW_PHRASES = ("visualize", "preview", "map this")
COUNT_PHRASES = ("count rows", "how many rows", "record count", "how many records")


def mentions(text: Column, phrases: tuple[str, ...]) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for phrase in phrases:
        found = found | low.contains(phrase)
    return found


def wants_preview(text: Column) -> Column:
    return mentions(text, PREVIEW_PHRASES)


def wants_count(text: Column) -> Column:
    return mentions(text, COUNT_PHRASES)
