"""Bytes of a statement or invoice file to text, by the charset its own header declares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from razao.functions.money import let


def _table(codec: str) -> tuple[str, str]:
    """Bytes 0x80-0xFF where a one-byte charset differs from ISO-8859-1, taken from the codec."""
    source, target = "", ""
    for code in range(0x80, 0x100):
        try:
            char = bytes([code]).decode(codec)
        except UnicodeDecodeError:
            if code < 0xA0:
                continue  # undefined there: the control character stays
            char = "\ufffd"
        if char != chr(code):
            source, target = source + chr(code), target + char
    return source, target


# Declared names that all mean windows-1252 in practice.
WINDOWS_NAMES = (
    "1252", "CP1252", "WINDOWS-1252", "8859-1", "ISO-8859-1", "LATIN1", "USASCII", "US-ASCII",
)

WINDOWS = "windows-1252"


def _one_byte_charsets() -> dict[str, tuple[str, tuple[str, ...]]]:
    """Charset -> (codec, declared names). 9 and 11 are read as their Windows supersets."""
    supersets = {9: "cp1254", 11: "cp874"}
    out = {WINDOWS: ("cp1252", WINDOWS_NAMES)}
    for part in (*range(2, 12), *range(13, 17)):
        names = tuple(f"{stem}{part}" for stem in ("ISO-8859-", "ISO8859-", "ISO_8859-", "ISO8859", "8859-"))
        out[f"iso-8859-{part}"] = (supersets.get(part, f"iso8859_{part}"), names)
    for page in (1250, 1251, 1253, 1254, 1255, 1256, 1257, 1258):
        out[f"windows-{page}"] = (f"cp{page}", (f"WINDOWS-{page}", f"CP{page}", f"X-CP{page}", f"{page}"))
    out["koi8-r"] = ("koi8_r", ("KOI8-R", "KOI8", "KOI"))
    out["ibm866"] = ("cp866", ("IBM866", "CP866", "866"))
    return out


ONE_BYTE = _one_byte_charsets()


def _lookup(table: dict[str, Column], key: Column) -> Column:
    """A value of a constant map; null for keys it has not."""
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), v)]), key)


# How a file in UTF-16 begins: a byte order mark, or a first ASCII character with its zero byte.
UTF16_LE, UTF16_BE = "utf-16le", "utf-16be"
_START_LE = r"^(?:\xff\xfe|[\x01-\x7f]\x00)"
_START_BE = r"^(?:\xfe\xff|\x00[\x01-\x7f])"
# One valid character in group 1, or a lone surrogate in group 2, which is dropped. Matches follow each
# other without a gap, so they stay on even positions.
_UNITS_LE = r"(?s)(.[\xd8-\xdb].[\xdc-\xdf]|.[^\xd8-\xdf])|(..)"
_UNITS_BE = r"(?s)([\xd8-\xdb].[\xdc-\xdf].|[^\xd8-\xdf].)|(..)"


def _utf16_order(content: Column) -> Column:
    """The byte order of a UTF-16 file, or null."""
    start = F.decode(F.substring(content, 1, 2), "ISO-8859-1")
    return F.when(start.rlike(_START_LE), UTF16_LE).when(start.rlike(_START_BE), UTF16_BE)


def _as_utf16(content: Column, units: str, codec: str) -> Column:
    """Text of whole code units; an odd last byte and lone surrogates are left out."""
    even = F.substring(content, F.lit(1), F.octet_length(content) - F.octet_length(content) % 2)
    clean = F.regexp_replace(F.decode(even, "ISO-8859-1"), units, "$1")
    return F.regexp_replace(F.decode(F.encode(clean, "ISO-8859-1"), codec), "^\ufeff", "")


def _charset(name: Column) -> Column:
    """The charset a declared name means; what is unknown is read as UTF-8."""
    meant = {name: F.lit(charset) for charset, (_, names) in ONE_BYTE.items() for name in names}
    return F.coalesce(_lookup(meant, name), F.lit("utf-8"))


def _as_text(content: Column, charset: Column) -> Column:
    tables = {
        name: F.array(*[F.lit(chars) for chars in _table(codec)]) for name, (codec, _) in ONE_BYTE.items()
    }

    def read(pair: Column) -> Column:
        bytes_as_chars = F.decode(content, "ISO-8859-1")
        return (
            F.when(charset == UTF16_LE, _as_utf16(content, _UNITS_LE, "UTF-16LE"))
            .when(charset == UTF16_BE, _as_utf16(content, _UNITS_BE, "UTF-16BE"))
            .when(pair.isNull(), _as_utf8(content))
            .when(
                F.rlike(bytes_as_chars, F.concat(F.lit("["), pair[0], F.lit("]"))),
                F.call_function("translate", bytes_as_chars, pair[0], pair[1]),
            )
            .otherwise(bytes_as_chars)
        )

    return let(_lookup(tables, charset), read)


def _as_utf8(content: Column) -> Column:
    """Invalid bytes become U+FFFD instead of failing the job; a byte order mark is dropped."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\ufeff", "")


def _header(content: Column) -> Column:
    """Everything before the ``<OFX>`` element, one character per byte."""
    return F.regexp_extract(F.decode(content, "ISO-8859-1"), r"(?i)^(?:[^<]++|<(?!OFX>))*+", 0)


def _declared(head: Column, pattern: str) -> Column:
    return F.nullif(F.upper(F.regexp_extract(head, pattern, 1)), F.lit(""))


XML_ENCODING = r"""(?i)<\?xml[^>]*encoding\s*=\s*["']([\w-]+)["']"""


def statement_charset(content: Column) -> Column:
    """The charset by name: UTF-16 by its first bytes, then XML prolog, CHARSET, ENCODING; else ``utf-8``."""
    patterns = (XML_ENCODING, r"(?i)CHARSET\s*:\s*([\w-]+)", r"(?i)ENCODING\s*:\s*([\w-]+)")
    name = let(_header(content), lambda head: F.coalesce(*[_declared(head, pattern) for pattern in patterns]))
    return F.coalesce(_utf16_order(content), _charset(name))


def decode_statement(content: Column) -> Column:
    return _as_text(content, statement_charset(content))


def decode_invoice(content: Column) -> Column:
    """Only the first bytes and the XML prolog count for an invoice."""
    name = _declared(F.decode(content, "ISO-8859-1"), XML_ENCODING)
    return _as_text(content, F.coalesce(_utf16_order(content), _charset(name)))
