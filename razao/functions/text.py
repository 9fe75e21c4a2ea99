"""Text normalisation, similarity and document numbers as native expressions."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from razao.functions.money import let, trimmed


def _accent_table() -> tuple[str, str]:
    """Characters whose canonical decomposition is an ASCII letter plus combining marks.

    Built by that rule over the basic plane. The combining marks come last, with no
    replacement, so ``translate`` deletes them.
    """
    marks = "".join(chr(code) for code in range(0x0300, 0x0370))
    letters, plain = [], []
    for code in range(0x00C0, 0xD800):
        parts = unicodedata.normalize("NFD", chr(code))
        base, rest = parts[0], parts[1:]
        if parts != chr(code) and base in string.ascii_letters and all(c in marks for c in rest):
            letters.append(chr(code))
            plain.append(base.lower())
    return "".join(letters) + marks, "".join(plain)


ACCENTED, PLAIN = _accent_table()


def normalize_text(text: Column) -> Column:
    """Lower-case ASCII words and digits separated by single spaces."""
    accents = F.octet_length(text) != F.char_length(text)
    ascii_text = F.lower(F.when(accents, F.translate(text, ACCENTED, PLAIN)).otherwise(text))
    return F.trim(F.regexp_replace(ascii_text, "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """Distinct words longer than one character."""
    return F.array_distinct(F.filter(F.split(normalize_text(text), " "), lambda t: F.length(t) > 1))


def jaccard(left: Column, right: Column) -> Column:
    """Shared over all words of two token arrays; 0 when either is empty."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        shared / F.greatest(union, F.lit(1))
    )


def text_similarity(left: Column, right: Column) -> Column:
    return jaccard(tokens(left), tokens(right))


# Words of bank-statement jargon and month names that a rule text leaves out.
RULE_NOISE = (
    "pix", "ted", "doc", "transferencia", "transf", "pagamento", "pgto", "recebimento", "receb",
    "enviado", "enviada", "recebido", "recebida", "pago", "paga", "credito", "debito", "cred",
    "deb", "conta", "cc", "cp", "ag", "agencia", "banco", "boleto", "titulo", "cobranca", "tarifa",
    "liquidacao", "compensacao", "de", "da", "do", "para", "em", "ref", "referente", "nr", "num",
    "numero", "id", "aut", "autenticacao", "janeiro", "fevereiro", "marco", "abril", "maio",
    "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro", "jan", "fev", "mar",
    "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez",
)


def suggest_rule_text(memo: Column) -> Column:
    """The first three words of a memo that are likely to come back in the next one."""
    noise = F.array(*[F.lit(word) for word in RULE_NOISE])
    kept = F.filter(
        F.split(normalize_text(memo), " "),
        lambda t: (F.length(t) > 2) & ~t.rlike("^[0-9]+$") & ~F.array_contains(noise, t),
    )
    return F.array_join(F.slice(kept, 1, 3), " ")


# Fixed value: a punctuated CNPJ or CPF that does not touch other digits.
TAX_ID_PATTERN = (
    r"(?<![\d.])(\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}|\d{3}\.\d{3}\.\d{3}-\d{2})(?![\d-])"
)


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def extract_tax_id(text: Column) -> Column:
    """Digits of the first punctuated CNPJ or CPF in the text, or null."""
    possible = F.contains(text, F.lit(".")) & F.contains(text, F.lit("-"))
    return F.when(possible, F.nullif(only_digits(F.regexp_extract(text, TAX_ID_PATTERN, 1)), F.lit("")))


def format_tax_id(digits: Column) -> Column:
    """Punctuate 14 digits (CNPJ) or 11 digits (CPF); other text stays, null is empty."""
    return (
        F.when(digits.isNull(), "")
        .when(
            digits.rlike("^[0-9]{14}$"),
            F.regexp_replace(
                digits, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5"
            ),
        )
        .when(
            digits.rlike("^[0-9]{11}$"),
            F.regexp_replace(digits, r"^(\d{3})(\d{3})(\d{3})(\d{2})$", "$1.$2.$3-$4"),
        )
        .otherwise(digits)
    )


def normalize_tax_id(text: Column) -> Column:
    """Digits only, null when nothing is left."""
    return F.nullif(only_digits(text), F.lit(""))


def is_tax_id(digits: Column) -> Column:
    return digits.rlike("^([0-9]{11}|[0-9]{14})$")


def document_hit(memo_normal: Column, document: Column) -> Column:
    """The document number, longer than two characters, is part of the normalised memo."""
    return F.coalesce(
        (F.length(document) > 2) & F.contains(memo_normal, normalize_text(document)), F.lit(False)
    )


def memo_join(*parts: Column) -> Column:
    """Distinct non-empty parts joined with `` - ``."""
    cleaned = F.array(*[trimmed(F.coalesce(part, F.lit(""))) for part in parts])
    return F.array_join(F.array_distinct(F.filter(cleaned, lambda part: part != "")), " - ")


def xml_entities(text: Column) -> Column:
    """Decode the five named entities and decimal references, the ampersand last."""
    return F.when(F.contains(text, F.lit("&")), _decode_entities(text)).otherwise(text)


def _decode_entities(text: Column) -> Column:
    named = text
    for entity, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        named = F.regexp_replace(named, f"(?i)&{entity};", char)
    named = F.when(text.rlike("(?i)&(?:lt|gt|quot|apos);"), named).otherwise(text)

    # Each piece after a "&#" either starts with digits and a semicolon or is put back. The pieces are
    # joined at the end: text that grows piece by piece costs the square of its length.
    def piece(part: Column, place: Column) -> Column:
        number = F.regexp_extract(part, "^([0-9]{1,7});", 1)
        decoded = let(number, lambda n: F.when(n != "", F.concat(_code_point(n), F.substring(part, F.length(n) + 2, F.length(part)))))
        return F.when(place == 0, part).otherwise(F.coalesce(decoded, F.concat(F.lit("&#"), part)))

    numbered = F.array_join(F.transform(F.split(named, "&#"), piece), "")
    out = F.when(F.contains(text, F.lit("&#")), numbered).otherwise(named)
    return F.regexp_replace(out, "(?i)&amp;", "&")


def _code_point(number: Column) -> Column:
    """One UTF-16 unit as text (the reference range of a decimal reference)."""
    unit = F.pmod(number.try_cast("int"), F.lit(65536))
    wide = F.lpad(F.hex(unit.cast("bigint")), 4, "0")
    return F.when(unit < 256, F.chr(unit)).otherwise(F.decode(F.unhex(wide), "UTF-16BE"))


TRUNCATED_PATTERN = r"…|\.\.\.$"


def is_truncated_name(name: Column) -> Column:
    """The bank cut the name and left an ellipsis."""
    return F.coalesce(name.rlike(TRUNCATED_PATTERN), F.lit(False))


def strip_ellipsis(name: Column) -> Column:
    return trimmed(F.regexp_replace(name, r"\s*(…|\.\.\.)\s*$", ""))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def description_fallback(given: Column, memo: Column) -> Column:
    """Given text, else the memo, else a fixed text; blank counts as missing."""
    return F.coalesce(
        blank_to_null(given), blank_to_null(memo), F.lit("Movimento sem descricao")
    )


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def natural_key(text: Column) -> Column:
    """Sort key that orders digit runs by value: 9 before 10. Each run follows its length."""
    runs = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(
        F.transform(
            runs,
            lambda run: F.when(
                run.rlike("^[0-9]"),
                let(
                    F.regexp_replace(run, "^0+(?=.)", ""),
                    lambda value: F.concat(F.lpad(F.length(value).cast("string"), 10, "0"), value),
                ),
            ).otherwise(run),
        ),
        "",
    )
