"""Readers on small files of the shapes banks and municipalities produce."""

from __future__ import annotations

import pytest

import datetime as dt

from pyspark.sql import functions as F

from razao.operators import imports
from razao.sources import delimited, export, nfse, ofx

SGML = """OFXHEADER:100\r\nDATA:OFXSGML\r\nENCODING:USASCII\r\nCHARSET:1252\r\n\r\n<OFX>
<SIGNONMSGSRSV1><SONRS><STATUS><CODE>0<SEVERITY>INFO</STATUS><DTSERVER>20240618174500[-3:BRT]</SONRS></SIGNONMSGSRSV1>
<BANKMSGSRSV1><STMTTRNRS><STMTRS><CURDEF>BRL<BANKACCTFROM><BANKID>077<ACCTID>90417-3</BANKACCTFROM>
<BANKTRANLIST><DTSTART>20240601<DTEND>20240630
<STMTTRN>
<TRNTYPE>CREDIT
<DTPOSTED>20240607084000[-3:BRT]
<TRNAMT>731.08
<FITID>T-77A
<NAME>DEPOSITO
<MEMO>ZENÓBIA – FEIRA &amp; FILHOS 30.114.902/0001-55
</STMTTRN>
<STMTTRN><DTPOSTED>20240613<TRNAMT>-4.062,17<NAME>X<MEMO>X</STMTTRN>
<STMTTRN><DTPOSTED>20240613<TRNAMT>-4.062,17<NAME>X<MEMO>X</STMTTRN>
<STMTTRN><DTPOSTED>20240231<TRNAMT>1<FITID>a</STMTTRN>
<STMTTRN><TRNAMT>1<FITID>b</STMTTRN>
<STMTTRN><DTPOSTED>20240614<TRNAMT>abc<FITID>c</STMTTRN>
</BANKTRANLIST><LEDGERBAL><BALAMT>918.44<DTASOF>20240630</LEDGERBAL></STMTRS></STMTTRNRS></BANKMSGSRSV1></OFX>
"""
XML = """<?xml version="1.0" encoding="UTF-8"?><?OFX OFXHEADER="200"?><OFX><CCSTMTRS>
<CCACCTFROM><ACCTID>0008800412</ACCTID></CCACCTFROM><BANKTRANLIST><DTSTART>20231101</DTSTART>
<STMTTRN><DTPOSTED>20231109</DTPOSTED><TRNAMT>-58.09</TRNAMT><FITID>f1</FITID><PAYEE><NAME>inner</NAME></PAYEE>
<MEMO>PADARIA CAFÉ &amp; PÃO</MEMO></STMTTRN></BANKTRANLIST></CCSTMTRS></OFX>"""


def files(spark, **contents: bytes):
    return spark.createDataFrame(
        [(name, bytearray(content)) for name, content in contents.items()], "file string, content binary"
    )


def test_ofx(spark):
    data = files(spark, a=SGML.encode("cp1252"), b=XML.encode(), c=b"not a statement")
    lines = [r for r in ofx.ingest_ofx(data).orderBy("file", "line_no").collect()]
    assert [(r.file, r.line_no, r.amount) for r in lines] == [
        ("a", 1, 73108), ("a", 2, -406217), ("a", 3, -406217), ("b", 1, -5809),
    ]
    assert lines[0].memo == "DEPOSITO - ZENÓBIA – FEIRA & FILHOS 30.114.902/0001-55"
    assert lines[0].counterparty_document == "30114902000155"
    assert [r.dedup_key for r in lines] == [
        "fitid:T-77A", "c:2024-06-13|-406217|x|0", "c:2024-06-13|-406217|x|1", "fitid:f1",
    ]
    assert lines[3].memo == "PADARIA CAFÉ & PÃO"
    heads = {r.file: r for r in ofx.statement_header(data).collect()}
    assert (heads["a"].bank_id, heads["a"].account_id, heads["a"].ledger_balance) == ("077", "90417-3", 91844)
    assert heads["a"].period_end == heads["a"].ledger_balance_date == dt.date(2024, 6, 18)
    assert heads["a"].period_warning.startswith("O arquivo diz cobrir até 30/06/2024")
    assert (heads["b"].account_id, heads["b"].period_end, heads["b"].ledger_balance) == ("0008800412", None, None)
    assert heads["c"].reject_reason == "not_ofx"
    assert [r.line_no for r in ofx.ofx_warnings(data).orderBy("line_no").collect()] == [4, 5, 6]


SIGNED = """Extrato\nAgencia: 1  Conta: 2\n\nData;Histórico;Documento;Valor
12/08/2024;DEPOSITO EM CONTA;004410;3.219,40\n13/08/2024;"A ""B""; c
d";;-7,35\n14/08/2024;zero;;0,00\n31/06/2024;ruim;;1,00\n;sem data;;1,00\nSALDO FINAL;;;88,12\n"""
SPLIT = 'Data,Lancamento,Debito,Credito\n09/11/23,"LOJA SUL, NORTE",,462.37\n21/11/2023,X,58.09,\n28/11/2023,Y,1,1\n'


def test_csv(spark):
    data = files(spark, a=("﻿" + SIGNED).encode(), b=SPLIT.encode(), c=b"x;y\n1;2\n")
    lines = delimited.ingest_csv(data).orderBy("file", "line_no").collect()
    assert [(r.file, r.amount, r.memo, r.check_number) for r in lines] == [
        ("a", 321940, "DEPOSITO EM CONTA", "004410"), ("a", -735, 'A "B"; c\nd', None),
        ("b", 46237, "LOJA SUL, NORTE", None), ("b", -5809, "X", None),
    ]
    warned = {(r.file, r.warning) for r in delimited.csv_warnings(data).collect()}
    assert warned == {("a", "data"), ("b", "valor")}
    layout = {r.file: (r.separator, r.header_row, r.problem) for r in delimited.csv_layout(data).collect()}
    assert layout == {"a": (";", 3, None), "b": (",", 1, None), "c": (";", 0, "no_header")}


BATCH = """<?xml version="1.0" encoding="ISO-8859-1"?><Resposta><ListaNfse>
<CompNfse><Nfse><InfNfse><Numero>417</Numero><DataEmissao>2023-09-14T08:30:00</DataEmissao>
<Servico><Valores><ValorServicos>1240.50</ValorServicos><ValorIr>31,20</ValorIr><ValorInss>7.80</ValorInss></Valores></Servico>
<PrestadorServico><Cnpj>40800700000133</Cnpj><RazaoSocial>P</RazaoSocial></PrestadorServico>
<TomadorServico><CpfCnpj><Cpf>101.202.303-04</Cpf></CpfCnpj><RazaoSocial>Zenóbia</RazaoSocial></TomadorServico>
</InfNfse></Nfse></CompNfse>
<CompNfse><Nfse><InfNfse><Numero>418</Numero><DataEmissao>14/09/2023</DataEmissao>
<ValorLiquidoNfse>62</ValorLiquidoNfse></InfNfse></Nfse></CompNfse>
<CompNfse><Nfse><InfNfse><Numero>419</Numero></InfNfse></Nfse></CompNfse></ListaNfse></Resposta>"""
SINGLE = """<NFSe xmlns="http://www.sped.fazenda.gov.br/nfse"><infNFSe Id="1"><nNFSe>33</nNFSe><cVerif>Q7K</cVerif>
<DPS><infDPS><dhEmi>2023-10-02T15:45:00-03:00</dhEmi><prest><CNPJ>40800700000133</CNPJ></prest>
<toma><CNPJ>60900500000177</CNPJ><xNome>Feira Sul</xNome></toma><valores><vServPrest><vServ>954.20</vServ></vServPrest>
<trib><vRetIRRF>14.31</vRetIRRF><vRetCSLL>9.54</vRetCSLL></trib></valores></infDPS></DPS></infNFSe></NFSe>"""


def test_invoices(spark):
    data = files(spark, a=BATCH.encode("latin-1"), b=SINGLE.encode(), c=b"<NFSe><nNFSe>1</NFSe>")
    rows = nfse.ingest_invoices(data).orderBy("number").collect()
    assert [(r.number, r.amount, r.withheld_amount, r.client_name, r.client_tax_id) for r in rows] == [
        ("33", 95420, 2385, "Feira Sul", "60900500000177"),
        ("417", 124050, 3900, "Zenóbia", "10120230304"),
        ("418", 6200, 0, "Cliente não identificado", None),
    ]
    assert rows[0].verification_code == "Q7K" and rows[0].warnings == []
    assert rows[2].warnings == ["so_valor_liquido", "sem_tomador", "sem_nome", "sem_documento"]
    bad = {(r.file, r.line_no, r.reason) for r in nfse.rejected_invoices(data).collect()}
    assert bad == {("a", 3, "sem_data"), ("c", 1, "xml_ilegivel")}


def test_long_inputs_keep_their_end(spark):
    head = "OFXHEADER:100\r\n" + "NOTE:" + "x" * 900 + "\r\nCHARSET:1252\r\n<OFX><BANKTRANLIST>"
    memo = "PAGAMENTO " + "lote " * 30
    rows = "".join(f"<STMTTRN><DTPOSTED>20240613<TRNAMT>-4.10<MEMO>{memo}{end}</STMTTRN>" for end in ("é", "b"))
    lines = ofx.ingest_ofx(files(spark, a=(head + rows + "</BANKTRANLIST></OFX>").encode("cp1252"))).orderBy("line_no").collect()
    assert [r.memo[-1] for r in lines] == ["é", "b"]
    assert len({r.dedup_key for r in lines}) == 2 and all(r.dedup_key.endswith("|0") for r in lines)
    late = "a;b,c\n" + "x,y\n" * 19 + "p;q\n" * 60
    assert spark.createDataFrame([(late,)], "t string").select(delimited.detect_separator(F.col("t"))).first()[0] == ";"


def test_import_twice_adds_nothing(spark):
    data = files(spark, a=SGML.encode("cp1252"))
    lines = ofx.ingest_ofx(data)
    heads = spark.createDataFrame([("a", 1, 7, "ofx")], "file string, company_id bigint, bank_account_id bigint, source string")
    no_lines = spark.createDataFrame([], "bank_account_id bigint, dedup_key string")
    no_files = spark.createDataFrame([], "bank_account_id bigint, file_hash string")
    first = imports.import_statements(heads, lines, no_files, no_lines)
    assert (first.headers.count(), first.lines.count(), first.duplicate_lines.count()) == (1, 3, 0)
    again = imports.import_statements(heads, lines, first.headers, first.lines)
    assert (again.headers.count(), again.lines.count()) == (0, 0)
    assert again.rejected_files.first().reject_reason == "already_imported"
    # The same lines under another name and order of files: all known by their keys.
    other = imports.import_statements(heads, lines, no_files, first.lines)
    assert other.lines.count() == 0


def test_gate_has_no_limit_of_its_own(spark):
    heads = spark.createDataFrame([("a", "ofx")], "file string, source string")
    lines = spark.range(10001).selectExpr("'a' AS file", "date'2024-06-13' AS posted_at", "id + 1 AS amount", "'m' AS memo", "string(id) AS dedup_key")
    assert imports.payload_gate(heads, lines).first().reject_reason is None
    assert imports.payload_gate(heads, lines, max_lines=10000).first().reject_reason == "too_many_lines"


def test_export(spark, tmp_path):
    days = spark.createDataFrame(
        [(1, dt.date(2024, 7, 19), 123456, -1, 123455, 5)],
        "company_id int, date date, inflow bigint, outflow bigint, net bigint, balance bigint",
    )
    export.export_cash_flow(days, str(tmp_path / "out"))
    (part,) = (tmp_path / "out" / "company_id=1").glob("*.csv")
    assert part.read_bytes().decode() == (
        "﻿Data;Entradas;Saidas;Liquido;Saldo\r\n19/07/2024;1.234,56;-0,01;1.234,55;0,05\r\n"
    )


def test_declared_charsets(spark):
    """Each one-byte charset a header may name, against the same text in UTF-8."""
    from razao.sources.decode import decode_statement, statement_charset

    cases = [
        ("ISO-8859-15", "iso8859_15", "iso-8859-15", "preço 12 €"), ("1250", "cp1250", "windows-1250", "żółć"),
        ("WINDOWS-1251", "cp1251", "windows-1251", "платёж"), ("ISO-8859-9", "cp1254", "iso-8859-9", "ışık"),
        ("1252", "cp1252", "windows-1252", "tarifa “mês” €"), ("KOI8-R", "koi8_r", "koi8-r", "счёт"),
        ("NENHUM", "utf-8", "utf-8", "ação"),
    ]
    data = [
        (i, bytearray(f"OFXHEADER:100\nCHARSET:{name}\n\n<OFX>{text}".encode(codec)))
        for i, (name, codec, _, text) in enumerate(cases)
    ]
    df = spark.createDataFrame(data, "file int, content binary")
    rows = df.select("file", statement_charset(F.col("content")), decode_statement(F.col("content"))).collect()
    for file, charset, text in rows:
        assert charset == cases[file][2]
        assert text.split("<OFX>")[1] == cases[file][3]


def test_csv_with_a_stated_layout(spark):
    """Titles no hint knows, places without a header, a title that is not there."""
    files = [
        ("a", "Relatorio\nQuando|Que foi|Quanto\n03/02/2024|cafe|-4,50\n04/02/2024|venda|10,00\nTotal|x|1,00"),
        ("b", "05/02/2024;aluguel;300,00\n06/02/2024;zero;0,00"),
        ("c", "Dia;Texto;Valor\n07/02/2024;x;1,00"),
        ("d", "Dia;Texto;Valor"),
    ]
    data = spark.createDataFrame([(f, bytearray(t.encode())) for f, t in files], "file string, content binary")
    mapping = spark.createDataFrame(
        [
            ("a", "|", 1, None, None, "quando", "QUE FOI", "Quanto", None, None, None),
            ("b", None, None, False, True, None, None, None, 0, 1, 2),
            ("c", None, None, None, None, "Dia", "Texto", "Montante", None, None, None),
            ("d", None, None, None, None, "Dia", "Texto", "Valor", None, None, None),
        ],
        "file string, separator string, skip_rows int, has_header boolean, invert_sign boolean, date_title string,"
        " description_title string, amount_title string, date_position int, description_position int,"
        " amount_position int",
    )
    lines = delimited.ingest_csv(data, mapping=mapping).orderBy("file", "line_no").collect()
    assert [(r.file, str(r.posted_at), r.amount, r.memo) for r in lines] == [
        ("a", "2024-02-03", -450, "cafe"), ("a", "2024-02-04", 1000, "venda"), ("b", "2024-02-05", -30000, "aluguel"),
    ]
    warned = {(r.file, r.warning) for r in delimited.csv_warnings(data, mapping=mapping).collect()}
    assert warned == {("a", "data"), ("c", "valor")}
    problems = {r.file: r.problem for r in delimited.stated_layout(data, mapping).collect()}
    assert problems == {"a": None, "b": None, "c": None, "d": "no_lines"}


@pytest.mark.parametrize("order", ["le", "be"])
def test_utf16_by_mark_and_by_first_bytes(spark, order):
    from razao.sources.decode import decode_invoice, decode_statement, statement_charset

    text = "<OFX>é ção \U0001F600 ok</OFX>"
    raw = text.encode(f"utf-16-{order}")
    mark = "\ufeff".encode(f"utf-16-{order}")
    # a lone surrogate in the middle and half a character at the end
    lone = (b"\x00\xd8" if order == "le" else b"\xd8\x00") + raw + b"x"
    rows = [(1, mark + raw), (2, raw), (3, mark + lone), (4, mark), (5, b""), (6, b"x")]
    df = spark.createDataFrame(rows, "i int, content binary").orderBy("i")
    got = df.select(statement_charset(F.col("content")), decode_statement(F.col("content")), decode_invoice(F.col("content"))).collect()
    assert [r[0] for r in got] == [f"utf-16{order}"] * 4 + ["utf-8"] * 2
    assert [r[1] for r in got] == [text, text, text, "", "", "x"] == [r[2] for r in got]


def test_leaves_of_an_invoice_leave_python_in_lookup_order():
    """By number of the parent element, then by place; the client's own apart, empty text as None."""
    xml = "<a><b><Numero>7</Numero><Serie> </Serie></b><Tomador><x><Cnpj>1</Cnpj></x><Nome>N</Nome></Tomador><Numero>8</Numero></a>"
    assert nfse._flatten(xml) == (
        ["numero", "numero", "serie", "nome", "cnpj"], ["8", "7", None, "N", "1"], ["nome", "cnpj"], ["N", "1"],
    )
    assert nfse._flatten("<a><b></a>") is None
