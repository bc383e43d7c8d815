"""Column expressions on longer texts: HTML, links, paths, names and chat commands."""

from __future__ import annotations

import html.entities
import json
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveframe.functions.names import FALLBACK_NAME

# Fixed values.
LINE_TAGS = ["p", "div", "tr", "br"]
LINK = r"(?U)https?://[^\s\x1c-\x1f]+"
LINK_TRAIL = "),."
TABLE_SUFFIXES = [".csv", ".tsv", ".xlsx", ".xls", ".parquet"]
TEXT_SUFFIXES = [".pdf", ".txt", ".html", ".htm"]
MIME_SUFFIXES = {
    "text/csv": ".csv",
    "application/pdf": ".pdf",
    "text/html": ".html",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/vnd.apache.parquet": ".parquet",
}
DEFAULT_SUFFIX = ".txt"
COMMAND_ALIASES = {"review": "diagnostico", "csreview": "arrumar", "decimais": "pontuacao"}
DELIMITER_NAMES = {"virgula": ",", "ponto_virgula": ";", "tab": "\t", "barra": "|"}
DIRECTION_NAMES = {"br_para_us": "br_to_us", "us_para_br": "us_to_br"}
COMMAND_OPERATIONS = {
    "arrumar": "tidy", "cabecalhos": "headers", "espacos": "trim", "linhas_vazias": "drop_empty",
    "deduplicar": "dedup", "separador": "delimiter", "pontuacao": "punctuation",
    "diagnostico": "profile", "vazios": "missing", "duplicatas": "duplicates",
}

# Non-characters of Unicode, which no text holds: a tag, and a tag that ends a line.
_TAG, _LINE = "\ufdd0", "\ufdd1"
_BODY = r"([^>=]++|=\s*+(\"[^\"]*+\"|'[^']*+')?+)*+"


@cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """Characters that decompose to one ASCII character, those characters, and what the others give."""
    several = {}
    one = []
    for ch in map(chr, range(0x80, sys.maxunicode + 1)):
        folded = "".join(c for c in unicodedata.normalize("NFKD", ch) if c.isascii())
        if len(folded) == 1:
            one.append((ch, folded))
        elif folded:
            several[ch] = folded
    return "".join(p[0] for p in one), "".join(p[1] for p in one), several


def _near(codes: list[int], gap: int = 32) -> str:
    """A character class of few ranges that holds all the codes."""
    starts = [b for a, b in zip([-gap - 1, *codes], codes) if b - a > gap]
    ends = [a for a, b in zip(codes, [*codes[1:], sys.maxunicode + gap + 1]) if b - a > gap]
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends)) + "]"


def _ascii(text: Column) -> Column:
    """The ASCII characters of the compatibility decomposition."""
    single, plain, several = _folding()
    table = F.create_map(*[F.lit(part) for pair in several.items() for part in pair])
    # Characters that give several are rare: only texts with one, or with a neighbour of one, are taken apart.
    rare = _near(sorted(map(ord, several)))
    spread = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    folded = F.translate(F.when(text.rlike(rare), spread).otherwise(text), single, plain)
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.regexp_replace(folded, r"[^\x00-\x7f]+", "")).otherwise(text)


def slug_col(text: Column) -> Column:
    """Lower-case ASCII words joined by underscores, as ``names.slug`` does for one name."""
    words = F.trim(F.regexp_replace(F.lower(_ascii(text)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(words == "", FALLBACK_NAME).otherwise(words)


def norm(text: Column) -> Column:
    """``slug_col`` with spaces, for comparing free text."""
    return F.translate(slug_col(text), "_", " ")


def _map_of(pairs: dict[str, str]) -> Column:
    """A constant map, folded from its text before it is used."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _numeric_reference(digits: Column) -> Column:
    """The character of ``#123`` or ``#x1F``, by the rules for web pages; a code that is none gives nothing."""
    hexadecimal = F.regexp_extract(digits, "^#[xX]0*([0-9A-Fa-f]*)", 1)
    code = F.when(digits.rlike("^#[xX]"), F.when(F.length(hexadecimal) < 9, F.conv(F.concat(F.lit("0"), hexadecimal), 16, 10).try_cast("bigint"))) \
        .otherwise(F.regexp_extract(digits, "^#([0-9]+)", 1).try_cast("bigint"))
    code = F.coalesce(code, F.lit(sys.maxunicode + 1))  # more digits than a number has
    # 128 to 159 mean the characters of windows-1252, where it has one.
    windows = "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0))
    surrogate = code.between(0xD800, 0xDFFF) | (code > sys.maxunicode) | (code == 0)
    none = (code < 0x20) & ~code.isin(0x9, 0xA, 0xC, 0xD) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    return (F.when(surrogate, "\ufffd").when(none, "")
            .when(code.between(0x80, 0x9F), F.substring(F.lit(windows), (code - 0x7F).cast("int"), F.lit(1)))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))


def decode_entities(text: Column) -> Column:
    """Character references replaced by their characters, in a single pass, as a browser reads them.

    All names of HTML 5 are known, the older ones also without their semicolon; then the longest name that the
    letters begin with counts, and the rest is text. Where no name fits, the text stays.
    """
    names = html.entities.html5
    every, old = _map_of({n: c for n, c in names.items() if n.endswith(";")}), _map_of({n: c for n, c in names.items() if not n.endswith(";")})
    common = _map_of({n: names[n] for n in ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;")})  # a map is searched entry by entry
    longest = max(len(n) for n in names if not n.endswith(";"))

    def decoded(piece: Column) -> Column:
        reference = F.regexp_extract(piece, r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)", 1)

        def found(size: Column, character: Column) -> Column:
            return F.when(character.isNotNull(), F.concat(character, F.substr(piece, size + 1)))

        whole = F.coalesce(F.try_element_at(common, reference), F.when(reference.endswith(";"), F.try_element_at(every, reference)))
        prefixes = [found(F.lit(n), F.when(F.length(reference) >= n, F.try_element_at(old, F.substring(reference, 1, n))))
                    for n in range(longest, 1, -1)]
        return F.when(reference == "", F.concat(F.lit("&"), piece)) \
            .when(reference.startswith("#"), F.concat(_numeric_reference(reference), F.substr(piece, F.length(reference) + 1))) \
            .otherwise(F.coalesce(found(F.length(reference), whole), *prefixes, F.concat(F.lit("&"), piece)))

    pieces = F.split(text, "&")
    return F.when(~text.contains("&"), text).otherwise(F.array_join(
        F.transform(pieces, lambda piece, at: F.when(at == 0, piece).otherwise(decoded(piece))), ""))


def html_text(source: Column) -> Column:
    """Visible text of a page: a space after each run, a newline after each block's end tag."""
    line_tags = "|".join(LINE_TAGS)
    # What is never closed runs to the end of the page.
    marked = F.regexp_replace(source, r"(?s)<!--.*?(-->|\z)", _TAG)
    for hidden in ("script", "style"):
        marked = F.regexp_replace(marked, rf"(?is)<{hidden}(\s[^>]*)?>.*?(</{hidden}\s*>|\z)", _TAG)
    marked = F.regexp_replace(marked, rf"(?i)</({line_tags})(\s[^>]*)?>|<({line_tags})(\s[^>]*)?/>", _LINE)
    marked = F.regexp_replace(marked, rf"<[a-zA-Z/!?]{_BODY}>", _TAG)
    runs = F.regexp_replace(marked, f"([^{_TAG}{_LINE}<]+|<)", "$1 ")
    return F.translate(decode_entities(runs), _LINE + _TAG, "\n")


def first_link(text: Column) -> Column:
    """First http or https link without closing punctuation; ``''`` if there is none."""
    return F.rtrim(F.regexp_extract(text, LINK, 0), F.lit(LINK_TRAIL))


def url_ok(url: Column) -> Column:
    """http or https, a host, no user name or password, and port 80 or 443."""
    return url.rlike(r"^[hH][tT][tT][pP][sS]?://(:?@)?(\[[^\]/?#]+\]|[^@:\[\]/?#]+)"
                     r"(:(0*(0|80|443))?)?([/?#][^\n]*)?\z")


def file_kind(url: Column, mime: Column) -> Column:
    """File suffix from the path of a link or a plain path, else from the MIME type."""
    path = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 2)
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    suffix = F.lower(F.regexp_extract(plain, r"[^/](\.[^./]+)/*$", 1))
    by_mime = F.create_map(*[F.lit(part) for pair in MIME_SUFFIXES.items() for part in pair])
    kind = F.trim(F.substring_index(mime, ";", 1))
    return F.when(suffix.isin(TABLE_SUFFIXES + TEXT_SUFFIXES), suffix).otherwise(
        F.coalesce(F.try_element_at(by_mime, kind), F.lit(DEFAULT_SUFFIX)))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda token: token != "")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(part) for pair in table.items() for part in pair]), key)


def command(text: Column, bot: str | None = None) -> Column:
    """Command word of a message with its aliases resolved.

    ``''`` when the message does not start with a command; NULL when it addresses another bot.
    """
    first = F.coalesce(F.try_element_at(_tokens(text), F.lit(1)), F.lit(""))
    word = F.lower(F.regexp_extract(first, "^/([^@]*)", 1))
    addressee = F.regexp_extract(first, "^/[^@]*(@.*)?$", 1)
    known = F.coalesce(_lookup(COMMAND_ALIASES, word), word)
    mine = F.lit(True) if bot is None else F.lower(addressee).isin("", f"@{bot.lower()}")
    return F.when(~first.startswith("/"), "").when(mine, known)


def request(text: Column, bot: str | None = None) -> Column:
    """A message as ``struct(operation, delimiter, column, direction, accepted)``.

    Links are not arguments. ``accepted`` is false for an unknown command or wrong arguments.
    """
    name = command(text, bot)
    arguments = F.filter(F.slice(_tokens(text), 2, 1 << 30), lambda token: ~token.rlike("^https?://"))
    first, second = (F.try_element_at(arguments, F.lit(n)) for n in (1, 2))
    delimiter = F.when(name == "separador", _lookup(DELIMITER_NAMES, first))
    direction = F.when(name == "pontuacao", _lookup(DIRECTION_NAMES, second))
    count = F.size(arguments)
    valid = (F.when(name == "separador", (count == 1) & delimiter.isNotNull())
             .when(name == "pontuacao", (count == 2) & direction.isNotNull())
             .otherwise(count == 0))
    operation = _lookup(COMMAND_OPERATIONS, name)
    return F.struct(
        operation.alias("operation"), delimiter.alias("delimiter"),
        F.when(name == "pontuacao", first).alias("column"), direction.alias("direction"),
        F.coalesce(operation.isNotNull() & valid, F.lit(False)).alias("accepted"))
