"""Service invoices (NFS-e) in XML.

Municipal layouts name the same things differently. A field is the first leaf with one of its
names, looked up without case: the first element in document order that has such a leaf as a
direct child wins, and of its children the first. A document is flattened to its leaves once,
by a small Arrow-batched helper (an XPath per field would parse it twenty times, and fails the
job on malformed XML); choosing fields, dates, amounts and rejects are column expressions.
"""

from __future__ import annotations

from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from razao.functions.dates import nfse_date
from razao.functions.money import let, parse_tolerant_amount
from razao.functions.staging import staged
from razao.functions.text import is_tax_id, only_digits
from razao.sources.decode import decode_invoice

# Tag names by meaning, lower case.
NAMES = {
    "number": ("numero", "numeronfse", "nnfse", "nnf"),
    "series": ("serie", "serienfse"),
    "verification_code": ("codigoverificacao", "codverificacao", "cverif"),
    "date": ("dataemissao", "dhemi", "demi", "dataemissaorps"),
    "amount": ("valorservicos", "vservprest", "vserv", "valortotalservicos", "valortotalnfse"),
    "net_amount": ("valorliquidonfse", "vliq"),
    "tax_id": ("cnpj", "cpf"),
    "name": ("razaosocial", "xnome", "nome"),
}
CLIENT_NAMES = ("tomador", "tomadorservico", "toma")
WITHHELD = (
    "valorir", "valorcsll", "valorpis", "valorcofins", "valorinss", "valoriss",
    "vretcp", "vretirrf", "vretcsll", "vretpis", "vretcofins", "vretiss",
)
# Elements that hold one invoice when a file brings several.
ENVELOPES = ("CompNfse", "NFSe", "Nfse")

LEAVES = T.StructType(
    [
        T.StructField("names", T.ArrayType(T.StringType())),
        T.StructField("texts", T.ArrayType(T.StringType())),
        T.StructField("client_names", T.ArrayType(T.StringType())),
        T.StructField("client_texts", T.ArrayType(T.StringType())),
    ]
)


def _flatten(xml: str | None) -> tuple[list, list, list, list] | None:
    """Lower-case names and texts of a document's leaves, by number of the parent element and then by
    place, an empty text as None, and those of them in the client's element; None for malformed XML.

    Names keep their prefix, as written. The client's element is the first one by number of
    its parent, then by place: the same order in which a field is looked up.
    """
    stack: list[list] = []
    leaves: list[tuple] = []
    clients: list[tuple[int, int]] = []
    count = 0

    def start(name: str, _attributes: dict) -> None:
        nonlocal count
        parent = stack[-1] if stack else None
        if parent:
            parent[2] = False
        inside = parent[4] if parent else ()
        lower = name.lower()
        if lower in CLIENT_NAMES:
            clients.append((parent[0] if parent else -1, count))
            inside = (*inside, count)
        stack.append([count, lower, True, [], inside])
        count += 1

    def text(data: str) -> None:
        stack[-1][3].append(data)

    def end(_name: str) -> None:
        _, name, leaf, parts, inside = stack.pop()
        if leaf:
            leaves.append((name, stack[-1][0] if stack else -1, "".join(parts).strip() or None, inside))

    if xml is None:
        return None
    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = text
    try:
        parser.Parse(xml, True)
    except expat.ExpatError:
        return None
    client = min(clients)[1] if clients else None
    leaves.sort(key=lambda leaf: leaf[1])
    own = [leaf for leaf in leaves if client in leaf[3]]
    return [leaf[0] for leaf in leaves], [leaf[2] for leaf in leaves], [leaf[0] for leaf in own], [leaf[2] for leaf in own]


@F.arrow_udf(LEAVES)
def xml_leaves(xml: pa.Array) -> pa.Array:
    """Flatten documents, one Arrow batch at a time; everything after it runs in the JVM."""
    rows = [_flatten(text) or (None,) * 4 for text in xml.to_pylist()]
    return pa.StructArray.from_arrays(
        [pa.array([row[i] for row in rows], pa.list_(pa.string())) for i in range(4)], names=LEAVES.names
    )


def _first(names: tuple[str, ...], part: str = "") -> Column:
    """Text of the first leaf with one of the names, or null."""
    places = F.array(*[F.array_position(f"_flat.{part}names", name) for name in names])
    place = F.array_min(F.array_remove(places, 0))
    return F.try_element_at(F.col(f"_flat.{part}texts"), place.cast("int"))


def split_invoices(files: DataFrame) -> DataFrame:
    """One row per invoice element; a file with a single invoice stays whole."""
    text = decode_invoice(F.col("content"))
    body = F.regexp_replace(text, r"^\s*<\?xml[^>]*\?>", "")

    def several(tag: str) -> Column:
        """All elements of the tag, null unless there are several."""
        element = rf"<{tag}(?:\s[^>]*)?>(?:[^<]++|<(?!/{tag}>))*+</{tag}>"
        found = let(F.regexp_extract_all("_body", F.lit(element), F.lit(0)), lambda all_: F.when(F.size(all_) > 1, all_))
        return F.when(F.contains("_body", F.lit(f"</{tag}>")), found)

    parts = F.coalesce(*[several(tag) for tag in ENVELOPES], F.array("_body"))
    kept = [c for c in files.columns if c != "content"]
    whole = staged(files, {"_body": body}).drop("content")
    return (
        staged(whole, {"_parts": parts})
        .select(*kept, F.posexplode("_parts").alias("_i", "xml"))
        .withColumn("line_no", F.col("_i") + 1)
        .drop("_i")
    )


def _parsed(files: DataFrame) -> DataFrame:
    """Invoice fields, null where absent; malformed XML has none."""
    flat = staged(split_invoices(files), {"_flat": xml_leaves(F.col("xml"))}).drop("xml")
    rows = flat.withColumn("_ok", F.col("_flat.names").isNotNull())
    has_client = F.size("_flat.client_names") > 0

    def scoped(meaning: str) -> Column:
        return F.when(has_client, _first(NAMES[meaning], "client_")).otherwise(
            _first(NAMES[meaning])
        )

    found = staged(
        rows,
        {
            "number": _first(NAMES["number"]),
            "series": _first(NAMES["series"]),
            "verification_code": _first(NAMES["verification_code"]),
            "_date": _first(NAMES["date"]),
            "_amount": _first(NAMES["amount"]),
            "_net": _first(NAMES["net_amount"]),
            "_name": scoped("name"),
            "_client": scoped("tax_id"),
            "_has_client": F.coalesce(has_client, F.lit(False)),
            "_withheld": F.array_compact(F.array(*[_first((name,)) for name in WITHHELD])),
        },
    ).drop("_flat")
    any_amount = F.coalesce("_amount", "_net")
    # An unreadable withholding makes the invoice unreadable: its null goes through the sum.
    withheld = F.aggregate(
        F.transform("_withheld", parse_tolerant_amount),
        F.lit(0).cast("bigint"),
        lambda total, value: total + value,
    )
    return staged(
        found,
        {
            "issued_on": nfse_date(F.col("_date")),
            "amount": parse_tolerant_amount(any_amount),
            "withheld_amount": F.when(
                F.col("_amount").isNotNull() & F.col("_withheld").isNotNull(), withheld
            ).otherwise(F.lit(0).cast("bigint")),
            "client_tax_id": only_digits(F.col("_client")),
            "_any_amount": any_amount,
        },
    )


def _reject_reason() -> Column:
    return (
        F.when(~F.col("_ok"), "xml_ilegivel")
        .when(F.col("number").isNull(), "sem_numero")
        .when(F.col("_date").isNull(), "sem_data")
        .when(F.col("issued_on").isNull(), "data_invalida")
        .when(F.col("_any_amount").isNull(), "sem_valor")
        .when(F.col("amount").isNull() | F.col("withheld_amount").isNull(), "valor_invalido")
    )


def ingest_invoices(files: DataFrame) -> DataFrame:
    """Invoices of (file, content), with warnings about what had to be assumed."""
    warnings = F.array_compact(
        F.array(
            F.when(F.col("_amount").isNull(), "so_valor_liquido"),
            F.when(~F.col("_has_client"), "sem_tomador"),
            F.when(F.col("_name").isNull(), "sem_nome"),
            F.when(F.col("client_tax_id").isNull(), "sem_documento"),
            F.when(~is_tax_id(F.col("client_tax_id")), "documento_inesperado"),
        )
    )
    parsed = _parsed(files).withColumn("_reason", _reject_reason())
    return parsed.where(F.col("_reason").isNull()).select(
        *[c for c in files.columns if c != "content"],
        "line_no",
        "number",
        "series",
        "verification_code",
        "issued_on",
        "amount",
        "withheld_amount",
        F.coalesce("_name", F.lit("Cliente não identificado")).alias("client_name"),
        "client_tax_id",
        warnings.alias("warnings"),
    )


def rejected_invoices(files: DataFrame) -> DataFrame:
    """Invoices that could not be read, and why; the rest of their file is not affected."""
    parsed = _parsed(files).withColumn("reason", _reject_reason())
    return parsed.where(F.col("reason").isNotNull()).select("file", "line_no", "reason")
