"""Money, text and dates: values stated in the blueprint's fixtures."""

from __future__ import annotations

import datetime as dt
import unicodedata

from pyspark.sql import functions as F

from razao.functions import dates, money, text


def test_user_amounts(values):
    cases = {
        "1.234,56": 123456, "1234.56": 123456, "12.50": 1250, "1.234": 123400, "R$ 1.234,56": 123456,
        "  R$1234,56  ": 123456, "(1.234,56)": -123456, "(R$ 50,00)": -5000, "50": 5000, "-12,5": -1250,
        "12.": 1200, "1.234.567": 123456700,
        "": None, "   ": None, "abc": None, "12,34,56": None, "R$": None, "1e5": None, "--5": None,
    }
    assert values(cases, money.parse_user_amount) == list(cases.values())


def test_tolerant_amounts(values):
    cases = {
        "+99.90": 9990, "2500,00": 250000, "-1.800,50": -180050, "1,800.50": 180050, "1.234": 123,
        "1.235": 124, "": None, "x": None, "+": None, ".": None, ".5": 50,
    }
    assert values(cases, money.parse_tolerant_amount) == list(cases.values())


def test_from_db(values):
    cases = {"1234.56": 123456, "1.005": 101, "2.345": 235, "1.004": 100, "-0.01": -1, None: 0}
    assert values(cases, money.from_db) == list(cases.values())


def test_from_decimal_rounds_half_away(values):
    assert values([1.005, -1.005, 2.345], money.from_decimal, "double") == [101, -101, 235]


def test_allocate(values):
    def parts(n):
        return lambda v: money.allocate(v, F.lit(n).cast("bigint"))

    assert values([10000, -10000], parts(3), "bigint") == [[3334, 3333, 3333], [-3334, -3333, -3333]]
    for n in range(1, 8):
        for total in values([1, 99, 12345, -7], parts(n), "bigint"):
            assert len(total) == n and max(total) - min(total) <= 1


def test_formats(values):
    assert values([123456, -1, 0], money.format_amount, "bigint") == ["1.234,56", "-0,01", "0,00"]
    assert values([-180000], money.format_brl, "bigint") == ["-R$ 1.800,00"]
    assert values([-180005], money.to_db, "bigint") == ["-1800.05"]


def _normal(value: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", value) if not "̀" <= c <= "ͯ")
    out = "".join(c if c.isascii() and c.isalnum() else " " for c in plain.lower())
    return " ".join(out.split())


def test_normalize_follows_unicode_decomposition(values):
    samples = ["TED REC. JOÃO  SILVA", "áb", "K K Å", "ẞ straße", "日本 x", ""]
    samples += ["".join(chr(c) for c in range(start, start + 64)) for start in range(0xC0, 0x2000, 64)]
    assert values(samples, text.normalize_text) == [_normal(s) for s in samples]


def test_similarity(spark):
    rows = [("ALUGUEL MARCO", "aluguel março"), ("aluguel", "energia eletrica"), ("a b c", "x y z"), ("ab cd", "ab")]
    df = spark.createDataFrame(rows, "a string, b string")
    found = df.select(text.text_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [row.s for row in found] == [1.0, 0.0, 0.0, 0.5]


def test_rule_text(values):
    cases = {
        "PIX ENVIADO 12/03 JOAO SILVA 998877": "joao silva",
        "PAGAMENTO BOLETO 123456789 ENERGISA": "energisa",
        "PIX ENVIADO": "",
        "PAGAMENTO ALUGUEL MARCO": "aluguel",
        "HONORARIOS REFERENTE A JANEIRO": "honorarios",
    }
    assert values(cases, text.suggest_rule_text) == list(cases.values())


def test_tax_ids(values):
    cases = {
        "x 12.345.678/0001-90 y": "12345678000190",
        "123.456.789-09": "12345678909",
        "9123.456.789-09": None,
        "123.456.789-091": None,
        "12345678000190": None,
    }
    assert values(cases, text.extract_tax_id) == list(cases.values())
    assert values(["12345678000190", "12345678909", "1"], text.format_tax_id) == [
        "12.345.678/0001-90", "123.456.789-09", "1",
    ]


def test_entities_and_names(values):
    assert values(["a &lt;b&GT; &#233; &amp;lt; &#x &quot;"], text.xml_entities) == ['a <b> é &lt; &#x "']
    assert values(["Ana Mar...", "Ana …", "Ana"], text.strip_ellipsis) == ["Ana Mar", "Ana", "Ana"]
    assert values(["Ana Mar...", "A… b", "Ana", None], text.is_truncated_name) == [True, True, False, False]


def test_dates(values):
    day = dt.date
    assert values(["20250301000000[-3:BRT]", "20250230", "2025-03-05", ""], dates.ofx_date) == [
        day(2025, 3, 1), None, None, None,
    ]
    assert values(["05/03/2025", "5.3.25", "1-1-70", "31/02/2025", "2025-03-05x", "x"], dates.csv_date) == [
        day(2025, 3, 5), day(2025, 3, 5), day(1970, 1, 1), None, day(2025, 3, 5), None,
    ]
    assert values(["2025-02-30", "2025-02-28", "2025-2-8"], dates.iso_date) == [None, day(2025, 2, 28), None]
    assert values([2024, 2025, 2026], dates.easter_sunday, "int") == [
        day(2024, 3, 31), day(2025, 4, 20), day(2026, 4, 5),
    ]


def test_calendar(spark):
    rows = {r.date.isoformat(): r for r in dates.calendar(spark, "2025-01-01", "2025-12-31").collect()}
    for holiday in ("03-03", "03-04", "04-18", "06-19", "01-01", "09-07", "12-25"):
        assert rows[f"2025-{holiday}"].is_holiday
    assert rows["2025-03-08"].next_business_day == dt.date(2025, 3, 10)
    assert rows["2025-12-25"].next_business_day == dt.date(2025, 12, 26)
    assert rows["2025-03-01"].next_business_day == dt.date(2025, 3, 5)
    assert rows["2025-03-09"].previous_business_day == dt.date(2025, 3, 7)


def test_amounts_beyond_the_range_are_null(values):
    texts = ["923456781234567890123.75", "0" * 30 + "17.25", "4." + "0" * 60, "-812345678901234567890123456789"]
    for parse in (money.from_db, money.parse_tolerant_amount):
        assert values(texts, parse) == [None, 1725, 400, None]
    assert values(["923456781234567890123,75", "R$ " + "0" * 25 + "17,25"], money.parse_user_amount) == [None, 1725]


def test_long_digit_runs_keep_their_order(spark):
    texts = ["n9", "n10", f"n{10**22 + 7}", f"n{10**26}", f"n{10**26 + 1}", f"n000{10**26 + 2}"]
    df = spark.createDataFrame([(t,) for t in reversed(texts)], "v string")
    assert [r.v for r in df.orderBy(text.natural_key(F.col("v"))).collect()] == texts


def test_references_in_a_long_text_take_linear_time(values):
    """Each decoded piece used to be added to a copy of all the text before it."""
    import time

    long = "&#101;" * 400_000
    values(["&#101;"], text.xml_entities)
    started = time.monotonic()
    assert values([long, "a&#233;&#x&lt;&#8364;&#1234567890;&#65;"], text.xml_entities) == ["e" * 400_000, "aé&#x<€&#1234567890;A"]
    assert time.monotonic() - started < 10
