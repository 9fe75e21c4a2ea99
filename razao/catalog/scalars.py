"""Queries: money, dates and small text functions over whole tables.

Typed texts are built from known cents or days, so the oracle states the expected value
directly instead of repeating the parser.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from razao.adapters import Model, pick
from razao.catalog.base import query
from razao.functions import dates, money
from razao.functions import text as txt

_GROUPED = "replace(format('{{:,}}', abs({0}) // 100), ',', '.') || ',' || lpad((abs({0}) % 100)::VARCHAR, 2, '0')"


def grouped(column: str) -> str:
    return f"CASE WHEN {column} < 0 THEN '-' ELSE '' END || " + _GROUPED.format(column)


@query(
    "from_db_to_db",
    "transactions",
    """SELECT id, amount AS cents, CASE WHEN amount < 0 THEN '-' ELSE '' END
           || (abs(amount) // 100) || '.' || lpad((abs(amount) % 100)::VARCHAR, 2, '0') AS stored,
       CASE WHEN id % 3 = 0 THEN 0 ELSE abs(amount) + (id % 10 >= 5)::INTEGER END AS rounded
       FROM transactions""",
)
def from_db_to_db(m: Model):
    """Stored text and back; a third digit rounds half up; null counts as zero."""
    stored = money.to_db(F.col("amount"))
    third = F.when(F.col("id") % 3 != 0, F.concat(money.to_db(F.abs("amount")), (F.col("id") % 10).cast("string")))
    return m.transactions.select(
        "id",
        money.from_db(stored).alias("cents"),
        stored.alias("stored"),
        money.from_db(third).alias("rounded"),
    )


@query(
    "from_decimal_to_decimal",
    "transactions",
    """SELECT id, amount AS cents, (amount / 100.0)::DOUBLE AS units FROM transactions""",
)
def from_decimal_to_decimal(m: Model):
    units = money.to_decimal(F.col("amount")).cast("double")
    return m.transactions.select(
        "id", money.from_decimal(units).alias("cents"), units.alias("units")
    )


@query(
    "parse_user_amount",
    "transactions",
    """SELECT id, CASE id % 8 WHEN 0 THEN abs(amount) WHEN 1 THEN -abs(amount) WHEN 2 THEN abs(amount)
       WHEN 3 THEN (abs(amount) // 100) * 100 WHEN 4 THEN -abs(amount) WHEN 5 THEN NULL
       WHEN 6 THEN abs(amount) WHEN 7 THEN NULL END AS cents FROM transactions""",
)
def parse_user_amount(m: Model):
    shown = money.format_amount(F.abs("amount"))
    plain = money.to_db(F.abs("amount"))
    whole = F.regexp_replace(shown, ",.*$", "")
    typed = (
        F.when(F.col("id") % 8 == 0, F.concat(F.lit(" R$ "), shown, F.lit(" ")))
        .when(F.col("id") % 8 == 1, F.concat(F.lit("(R$ "), shown, F.lit(")")))
        .when(F.col("id") % 8 == 2, plain)
        .when(F.col("id") % 8 == 3, F.when(F.contains(whole, F.lit(".")), whole).otherwise(F.concat(whole, F.lit(",0"))))
        .when(F.col("id") % 8 == 4, F.concat(F.lit("-"), shown))
        .when(F.col("id") % 8 == 5, F.concat(F.lit("x"), shown))
        .when(F.col("id") % 8 == 6, F.concat(F.lit("+"), shown))
        .otherwise(F.concat(shown, F.lit(",00")))
    )
    return m.transactions.select("id", money.parse_user_amount(typed).alias("cents"))


@query(
    "parse_tolerant_amount",
    "transactions",
    """SELECT id, CASE id % 6 WHEN 0 THEN amount WHEN 1 THEN amount WHEN 2 THEN abs(amount)
       WHEN 3 THEN amount WHEN 4 THEN 123 WHEN 5 THEN NULL END AS cents FROM transactions""",
)
def parse_tolerant_amount(m: Model):
    plain, shown = money.to_db(F.col("amount")), money.format_amount(F.col("amount"))
    text = (
        F.when(F.col("id") % 6 == 0, plain)
        .when(F.col("id") % 6 == 1, F.translate(plain, ".", ","))
        .when(F.col("id") % 6 == 2, F.concat(F.lit("+"), money.to_db(F.abs("amount"))))
        .when(F.col("id") % 6 == 3, shown)
        .when(F.col("id") % 6 == 4, "1.234")
        .otherwise(F.concat(plain, F.lit("e1")))
    )
    return m.transactions.select("id", money.parse_tolerant_amount(text).alias("cents"))


@query(
    "allocate",
    "transactions",
    """SELECT id, i::INTEGER AS part, (sign(amount) * (abs(amount) // (1 + id % 7)
           + CASE WHEN i < abs(amount) % (1 + id % 7) THEN 1 ELSE 0 END))::BIGINT AS cents
       FROM transactions, unnest(range(0, 1 + id % 7)) u(i)""",
)
def allocate(m: Model):
    parts = money.allocate(F.col("amount"), 1 + F.col("id") % 7)
    return m.transactions.select("id", F.posexplode(parts).alias("part", "cents"))


@query(
    "format_brl",
    "transactions",
    f"""SELECT id, {grouped('amount')} AS plain,
       CASE WHEN amount < 0 THEN '-' ELSE '' END || 'R$' || chr(160) || {_GROUPED.format('amount')} AS brl
       FROM transactions""",
)
def format_brl(m: Model):
    amount = F.col("amount")
    return m.transactions.select(
        "id", money.format_amount(amount).alias("plain"), money.format_brl(amount).alias("brl")
    )


# Dates

_ORDERS = "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders"


def _days(m: Model):
    return m.raw("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("d")
    )


_PARSED = "CASE WHEN id % 5 = {0} THEN NULL ELSE d::VARCHAR END"


@query(
    "iso_date",
    sql=f"SELECT id, CASE WHEN id % 5 > 2 THEN NULL ELSE d::VARCHAR END AS day FROM ({_ORDERS})",
)
def iso_date(m: Model):
    text = (
        F.when(F.col("id") % 5 <= 2, F.col("d").cast("string"))
        .when(F.col("id") % 5 == 3, F.concat(F.year("d").cast("string"), F.lit("-02-30")))
        .otherwise(F.date_format("d", "yyyy-M-d'T'"))
    )
    return _days(m).select("id", dates.iso_date(text).alias("day"))


@query("ofx_date", sql=f"SELECT id, {_PARSED.format(3)} AS day FROM ({_ORDERS})")
def ofx_date(m: Model):
    text = F.when(F.col("id") % 5 == 3, F.concat(F.year("d").cast("string"), F.lit("0230"))).otherwise(
        F.concat(F.date_format("d", "yyyyMMdd"), F.lit("235959[-3:BRT]"))
    )
    return _days(m).select("id", dates.ofx_date(text).alias("day"))


@query(
    "csv_date",
    sql=f"SELECT id, CASE WHEN id % 5 = 3 THEN NULL ELSE d::VARCHAR END AS day FROM ({_ORDERS})",
)
def csv_date(m: Model):
    text = (
        F.when(F.col("id") % 5 == 0, F.date_format("d", "dd/MM/yyyy"))
        .when(F.col("id") % 5 == 1, F.date_format("d", "d.M.yy"))
        .when(F.col("id") % 5 == 2, F.date_format("d", " yyyy-MM-dd"))
        .when(F.col("id") % 5 == 3, F.concat(F.lit("31/02/"), F.year("d").cast("string")))
        .otherwise(F.date_format("d", "d-M-yyyy"))
    )
    return _days(m).select("id", dates.csv_date(text).alias("day"))


@query("nfse_date", sql=f"SELECT id, {_PARSED.format(4)} AS day FROM ({_ORDERS})")
def nfse_date(m: Model):
    text = (
        F.when(F.col("id") % 5 <= 1, F.date_format("d", "yyyy-MM-dd'T14:32:10-03:00'"))
        .when(F.col("id") % 5 <= 3, F.date_format("d", "dd/MM/yyyy"))
        .otherwise(F.date_format("d", "yyyyMMdd"))
    )
    return _days(m).select("id", dates.nfse_date(text).alias("day"))


@query(
    "date_arithmetic",
    sql=f"""SELECT id, (d + CAST(id % 400 AS INTEGER))::VARCHAR AS plus_days,
       CAST(d + to_months(CAST(id % 25 AS INTEGER)) AS DATE)::VARCHAR AS plus_months,
       date_diff('day', d, DATE '2000-01-01')::INTEGER AS gap,
       CASE WHEN d < DATE '2000-01-01' THEN -1 WHEN d > DATE '2000-01-01' THEN 1 ELSE 0 END AS compared
       FROM ({_ORDERS})""",
)
def date_arithmetic(m: Model):
    """Add days and months (clamped to the month), day distance, comparison."""
    gap = F.datediff(dates.day("2000-01-01"), F.col("d"))
    return _days(m).select(
        "id",
        F.date_add("d", (F.col("id") % 400).cast("int")).alias("plus_days"),
        F.add_months("d", (F.col("id") % 25).cast("int")).alias("plus_months"),
        gap.alias("gap"),
        (-F.signum(gap)).cast("int").alias("compared"),
    )


@query(
    "month_bounds",
    sql=f"""SELECT id, date_trunc('month', d)::DATE::VARCHAR AS first, last_day(d)::VARCHAR AS last,
       day(last_day(d))::INTEGER AS days FROM ({_ORDERS})""",
)
def month_bounds(m: Model):
    d = F.col("d")
    return _days(m).select(
        "id",
        dates.month_start(d).alias("first"),
        dates.month_end(d).alias("last"),
        dates.days_in_month(d).alias("days"),
    )


@query(
    "today_brazil",
    sql="SELECT event_id, CAST(ts - INTERVAL 3 HOUR AS DATE)::VARCHAR AS day FROM events",
)
def today_brazil(m: Model):
    """São Paulo is three hours behind UTC all through the data's month."""
    return m.raw("events").select("event_id", dates.today_brazil(F.col("ts")).alias("day"))


@query(
    "is_weekend",
    sql=f"SELECT id, d::VARCHAR AS day, isodow(d) >= 6 AS weekend FROM ({_ORDERS})",
)
def is_weekend(m: Model):
    return _days(m).select("id", F.col("d").alias("day"), dates.is_weekend(F.col("d")).alias("weekend"))


# Easter Sundays of the years in the data, as published, and the days that follow from them.
_EASTER = """(VALUES (1994, DATE '1994-04-03'), (1995, DATE '1995-04-16'), (1996, DATE '1996-04-07'), (1997, DATE '1997-03-30'),
    (1998, DATE '1998-04-12'), (1999, DATE '1999-04-04'), (2000, DATE '2000-04-23'),
    (2001, DATE '2001-04-15'), (2002, DATE '2002-03-31')) easter(y, sunday)"""
_FIXED = "('01-01', '04-21', '05-01', '09-07', '10-12', '11-02', '11-15', '11-20', '12-25')"
_HOLIDAY = f"""(strftime(d, '%m-%d') IN {_FIXED}
    OR date_diff('day', sunday, d) IN (-48, -47, -2, 60))"""


@query(
    "easter_sunday",
    sql=f"SELECT id, sunday::VARCHAR AS easter FROM ({_ORDERS}) JOIN {_EASTER} ON y = year(d)",
)
def easter_sunday(m: Model):
    return _days(m).select("id", dates.easter_sunday(F.year("d")).alias("easter"))


@query(
    "national_holidays",
    sql=f"""WITH days AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2002-12-31',
            INTERVAL 1 DAY))::DATE AS d),
        holidays AS (SELECT d FROM days JOIN {_EASTER} ON y = year(d) WHERE {_HOLIDAY})
        SELECT d::VARCHAR AS holiday, (SELECT count(*) FROM orders
               WHERE CAST(o_orderdate AS DATE) = holidays.d) AS orders
        FROM holidays WHERE year(d) IN (SELECT DISTINCT year(o_orderdate) FROM orders)""",
)
def national_holidays(m: Model):
    """Holidays of the years with movement, and how many bookings fell on each."""
    days = _days(m).groupBy("d").agg(F.count("*").alias("orders"))
    years = days.select(F.year("d").alias("year")).distinct()
    return (
        dates.national_holidays(years)
        .join(days.withColumnRenamed("d", "holiday"), "holiday", "left")
        .select("holiday", F.coalesce("orders", F.lit(0).cast("bigint")).alias("orders"))
    )


@query(
    "banking_calendar",
    sql=f"""SELECT id, d::VARCHAR AS day, {_HOLIDAY} OR (o_custkey % 25 = day(d) AND month(d) = 6)
           AS holiday, NOT (isodow(d) >= 6 OR {_HOLIDAY} OR (o_custkey % 25 = day(d) AND month(d) = 6))
           AS business
       FROM (SELECT o_orderkey AS id, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders)
       JOIN {_EASTER} ON y = year(d)""",
)
def banking_calendar(m: Model):
    """National calendar plus one extra holiday per company: its number as a day in June."""
    rows = m.transactions.select("id", "company_id", F.col("booking_date").alias("d"))
    extra = rows.where((F.dayofmonth("d") == F.col("company_id")) & (F.month("d") == 6)).select(
        "company_id", F.col("d").alias("holiday")
    )
    marked = dates.with_extra_holidays(rows, extra, "d")
    holiday = ~dates.is_weekend(F.col("d")) & ~F.col("is_business_day")
    own = (F.dayofmonth("d") == F.col("company_id")) & (F.month("d") == 6)
    return marked.select(
        "id",
        F.col("d").alias("day"),
        (holiday | dates.is_national_holiday(F.col("d")) | own).alias("holiday"),
        F.col("is_business_day").alias("business"),
    )


_NEXT = f""", days AS (SELECT unnest(generate_series(DATE '1994-12-01', DATE '2002-06-30',
        INTERVAL 1 DAY))::DATE AS d),
    open AS (SELECT d FROM days JOIN {_EASTER} ON y = year(d) WHERE isodow(d) < 6 AND NOT {_HOLIDAY}),
    near AS (SELECT days.d, (SELECT min(open.d) FROM open WHERE open.d >= days.d) AS later,
                    (SELECT max(open.d) FROM open WHERE open.d <= days.d) AS earlier FROM days) """


@query(
    "next_previous_business_day",
    "transactions",
    _NEXT + """SELECT id, later::VARCHAR AS next_day, earlier::VARCHAR AS previous_day
       FROM transactions JOIN near ON near.d = booking_date""",
)
def next_previous_business_day(m: Model):
    table = dates.calendar_of(m.transactions, "booking_date")
    return m.transactions.join(table, F.col("booking_date") == F.col("date"), "left").select(
        "id",
        F.col("next_business_day").alias("next_day"),
        F.col("previous_business_day").alias("previous_day"),
    )


_MONTHS = "[" + ", ".join(f"'{n}'" for n in dates.MONTH_NAMES) + "]"


@query(
    "format_dates",
    sql=f"""SELECT event_id, strftime(ts, '%d/%m/%Y') AS day,
       {_MONTHS}[month(ts)] || ' de ' || year(ts) AS month,
       strftime(ts - INTERVAL 3 HOUR, '%d/%m/%Y, %H:%M') AS local_time FROM events""",
)
def format_dates(m: Model):
    ts = F.col("ts")
    return m.raw("events").select(
        "event_id",
        dates.format_date(ts).alias("day"),
        dates.format_month(ts).alias("month"),
        dates.format_datetime(ts).alias("local_time"),
    )


# Small text functions


@query(
    "memo_join",
    "statement_lines",
    """SELECT id, CASE WHEN id % 3 = 0 THEN trim(memo) WHEN id % 3 = 1 THEN trim(memo)
       ELSE 'Conta ' || bank_account_id || ' - ' || trim(memo) END AS joined FROM statement_lines""",
)
def memo_join(m: Model):
    name = (
        F.when(F.col("id") % 3 == 0, F.concat(F.lit(" "), F.col("memo")))
        .when(F.col("id") % 3 == 2, F.concat(F.lit("Conta "), F.col("bank_account_id")))
    )
    return m.statement_lines.select("id", txt.memo_join(name, F.col("memo")).alias("joined"))


@query("content_hash", sql="SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(m: Model):
    return m.raw("documents").select("doc_id", txt.content_hash(F.col("text")).alias("hash"))


@query(
    "xml_entities",
    sql="""SELECT doc_id, '<' || text || '>&lt;"''é&#x' AS decoded FROM documents""",
)
def xml_entities(m: Model):
    text = F.replace(F.col("text"), F.lit("&"), F.lit("&amp;"))
    text = F.replace(text, F.lit("e"), F.lit("&#101;"))
    encoded = F.concat(F.lit("&lt;"), text, F.lit("&GT;&amp;lt;&quot;&apos;&#233;&#x"))
    return m.raw("documents").select("doc_id", txt.xml_entities(encoded).alias("decoded"))


@query(
    "truncated_name",
    "counterparties",
    """SELECT id, id % 3 < 2 AS cut, name FROM counterparties""",
)
def truncated_name(m: Model):
    shown = F.concat("name", pick(F.col("id"), ("...", " … ", "")))
    return m.counterparties.select(
        "id", txt.is_truncated_name(shown).alias("cut"), txt.strip_ellipsis(shown).alias("name")
    )


@query(
    "description_fallback",
    "statement_lines",
    """SELECT id, CASE id % 3 WHEN 0 THEN 'dado' WHEN 1 THEN memo ELSE 'Movimento sem descricao' END
       AS description FROM statement_lines""",
)
def description_fallback(m: Model):
    given = F.when(F.col("id") % 3 == 0, " dado ").when(F.col("id") % 3 == 1, "  ")
    memo = F.when(F.col("id") % 3 != 2, F.col("memo")).otherwise(" ")
    return m.statement_lines.select("id", txt.description_fallback(given, memo).alias("description"))


@query(
    "json_rows",
    "transactions",
    """SELECT id, id * 2 AS invoice_id, abs(amount) // 2 AS amount FROM transactions
       UNION ALL SELECT id, id * 2 + 1, abs(amount) // 3 FROM transactions""",
)
def json_rows(m: Model):
    from razao.operators.audit import json_rows as rows

    def half(n: int):
        size = F.abs("amount")
        return ((size - size % n) / n).cast("bigint")

    item = F.array(
        F.struct((F.col("id") * 2).alias("invoice_id"), half(2).alias("amount")),
        F.struct((F.col("id") * 2 + 1).alias("invoice_id"), half(3).alias("amount")),
    )
    asked = m.transactions.select("id", F.to_json(item).alias("allocations"))
    return rows(asked, "allocations", "invoice_id bigint, amount bigint")
