"""The ledger model on top of the given star-schema tables.

Each property is one model table derived from the given Parquet files by integer arithmetic
on keys, so another engine computes the same rows. Nothing is cached: every query plans its
own pruned scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from razao.functions.money import from_decimal
from razao.schema import ACCOUNT_KINDS, FREQUENCIES, PAYMENT_METHODS

COMPANIES = 25
AS_OF = "2000-01-01"

MEMO_WORDS = ("PIX ENVIADO", "TED RECEBIDA", "Pagto. boleto", "Débito automático", "DOC", "Tarifa")


def pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def accounts_from(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.select(
        key.alias("bank_account_id"),
        (key % COMPANIES).alias("company_id"),
        F.col("c_name").alias("name"),
        pick(key, ACCOUNT_KINDS).alias("kind"),
        from_decimal(F.col("c_acctbal")).alias("opening_balance"),
        F.date_add(F.lit("1995-01-01").cast("date"), (key % 400).cast("int")).alias(
            "opening_balance_date"
        ),
        F.when(key % 3 == 0, F.lit(100000).cast("bigint")).alias("minimum_balance"),
        (key % 10 != 0).alias("is_active"),
    )


def transactions_from(orders: DataFrame) -> DataFrame:
    key, account = F.col("o_orderkey"), F.col("o_custkey")
    company = account % COMPANIES
    booking = F.col("o_orderdate").cast("date")
    digit = F.substring("o_orderpriority", 1, 1).cast("bigint")
    transfer = key % 50 == 0
    group = (key - key % 100) / 100
    group = group.cast("bigint")
    leg = F.when(key % 100 == 0, -1).otherwise(1)
    moved = leg * (5000 + 100 * (group % 1000) + F.when((leg > 0) & (group % 7 == 0), 1).otherwise(0))
    price = from_decimal(F.col("o_totalprice"))
    amount = F.when(transfer, moved).when(key % 4 >= 2, -price).otherwise(price)
    method = pick(key, PAYMENT_METHODS)
    return orders.select(
        key.alias("id"),
        company.alias("company_id"),
        account.alias("bank_account_id"),
        F.when(~transfer & (key % 11 != 0), company * 10 + digit).alias("category_id"),
        F.when(account % 7 != 0, account).alias("counterparty_id"),
        F.when(key % 4 == 0, company * 10 + key % 3).alias("cost_center_id"),
        booking.alias("booking_date"),
        F.add_months(booking, -(key % 2).cast("int")).alias("competence_date"),
        amount.cast("bigint").alias("amount"),
        F.when(amount > 0, "entrada").otherwise("saida").alias("direction"),
        F.when(F.col("o_orderstatus") == "P", "previsto").otherwise("realizado").alias("status"),
        F.when(key % 5 == 0, "conciliado")
        .when(key % 17 == 0, "ignorado")
        .otherwise("nao_conciliado")
        .alias("reconciliation"),
        F.when(key % 8 != 0, method).alias("payment_method"),
        F.concat(
            pick(key, MEMO_WORDS), F.lit(" "), F.col("o_orderpriority"), F.lit(" cliente "), account
        ).alias("description"),
        F.when(key % 6 == 0, key.cast("string")).alias("document_number"),
        F.when(transfer, group).alias("transfer_group_id"),
        transfer.alias("is_transfer"),
        F.when(key % 13 == 0, key % 100).alias("recurrence_id"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=key % 86400)).alias("created_at"),
    )


def statement_lines_from(orders: DataFrame) -> DataFrame:
    """Bank lines: every order cleared later, a seventh three cents off, plus fees nobody booked."""
    key, account = F.col("o_orderkey"), F.col("o_custkey")
    booking = F.col("o_orderdate").cast("date")
    price = from_decimal(F.col("o_totalprice"))
    posted = F.date_add(booking, (key % 45).cast("int"))
    month = (F.year(posted) * 12 + F.month(posted) - 1 - 1995 * 12).cast("bigint")
    state = (
        F.when(key % 10 == 0, "conciliada")
        .when(key % 10 == 1, "criada")
        .when(key % 10 == 2, "ignorada")
        .otherwise("pendente")
    )
    shared = (
        (account % COMPANIES).alias("company_id"),
        (account * 1000 + month).alias("import_id"),
        account.alias("bank_account_id"),
        posted.alias("posted_at"),
    )
    real = orders.select(
        key.alias("id"),
        *shared,
        (F.when(key % 4 >= 2, -price).otherwise(price) + F.when(key % 7 == 0, 3).otherwise(0)).alias("amount"),
        F.concat(
            pick(key, MEMO_WORDS),
            F.lit(" "),
            F.lower("o_orderpriority"),
            F.lit(" Cliente "),
            account,
            F.lit(" doc "),
            key,
        ).alias("memo"),
        F.when(key % 9 != 0, F.concat(F.lit("F"), key)).alias("fitid"),
        F.concat(F.lit("fitid:F"), key).alias("dedup_key"),
        state.alias("status"),
        F.when(key % 10 < 2, key).alias("matched_transaction_id"),
        F.when((key % 10 == 2) & (key % 20 != 2), F.lit("duplicada")).alias("ignored_reason"),
    )
    fees = orders.where(key % 5 == 0).select(
        (key + 1_000_000_000_000).alias("id"),
        *shared,
        F.lit(-1250).cast("bigint").alias("amount"),
        F.lit("TARIFA MANUTENÇÃO DE CONTA").alias("memo"),
        F.lit(None).cast("string").alias("fitid"),
        F.concat(F.lit("c:fee|"), key).alias("dedup_key"),
        F.lit("pendente").alias("status"),
        F.lit(None).cast("bigint").alias("matched_transaction_id"),
        F.lit(None).cast("string").alias("ignored_reason"),
    )
    return real.unionByName(fees)


class Model:
    """Model tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    @cached_property
    def companies(self) -> DataFrame:
        key = F.col("n_nationkey").cast("bigint")
        digits = F.when(key % 10 == 7, 13).otherwise(14)
        return self.raw("nation").select(
            key.alias("company_id"),
            F.when(key % 12 == 5, F.lit(" ")).otherwise(F.col("n_name")).alias("name"),
            F.lpad((key * 7919 + 11).cast("string"), digits, F.lit("0")).alias("tax_id"),
            (key % 9 != 4).alias("is_active"),
        )

    @cached_property
    def accounts(self) -> DataFrame:
        return accounts_from(self.raw("customer"))

    @cached_property
    def transactions(self) -> DataFrame:
        return transactions_from(self.raw("orders"))

    @cached_property
    def statement_lines(self) -> DataFrame:
        return statement_lines_from(self.raw("orders"))

    @cached_property
    def categories(self) -> DataFrame:
        """Five per company: 1 is the parent of 4 and 5."""
        company = F.col("n_nationkey").cast("bigint")
        return (
            self.raw("nation")
            .select(company.alias("company_id"), F.explode(F.array(*[F.lit(i) for i in range(1, 6)])).alias("d"))
            .select(
                (F.col("company_id") * 10 + F.col("d")).alias("id"),
                "company_id",
                F.when(F.col("d") >= 4, F.col("company_id") * 10 + 1).alias("parent_id"),
                F.concat(F.lit("Categoria "), F.col("d")).alias("name"),
                pick(F.col("d"), ("entrada", "ambos", "entrada", "saida", "ambos")).alias("kind"),
                (F.col("d") != 5).alias("is_active"),
            )
        )

    @cached_property
    def cost_centers(self) -> DataFrame:
        company = F.col("n_nationkey").cast("bigint")
        return (
            self.raw("nation")
            .select(company.alias("company_id"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("d"))
            .select(
                (F.col("company_id") * 10 + F.col("d")).alias("id"),
                "company_id",
                F.concat(F.lit("Centro "), F.col("d")).alias("name"),
                (F.col("d") != 2).alias("is_active"),
            )
        )

    @cached_property
    def counterparties(self) -> DataFrame:
        key = F.col("c_custkey")
        size = F.when(key % 29 == 3, 12).when(key % 2 == 0, 14).otherwise(11)
        return self.raw("customer").select(
            key.alias("id"),
            (key % COMPANIES).alias("company_id"),
            F.col("c_name").alias("name"),
            F.when(key % 13 != 0, F.lpad((key * 7919 + 11).cast("string"), size, F.lit("0"))).alias(
                "tax_id"
            ),
            (key % 11 != 0).alias("is_active"),
        )

    @cached_property
    def imports(self) -> DataFrame:
        """One statement import per account and month with movement."""
        booking = F.col("o_orderdate").cast("date")
        month = F.trunc(booking, "MM")
        account = F.col("o_custkey")
        grouped = (
            self.raw("orders")
            .groupBy(account.alias("bank_account_id"), month.alias("period_start"))
            .agg(
                F.max(booking).alias("last"),
                F.sum(from_decimal(F.col("o_totalprice"))).alias("total"),
                F.count("*").alias("line_count"),
            )
            .withColumn(
                "id",
                F.col("bank_account_id") * 1000
                + F.year("period_start") * 12
                + F.month("period_start")
                - 1
                - 1995 * 12,
            )
        )
        key = F.col("id")
        return grouped.select(
            key,
            (F.col("bank_account_id") % COMPANIES).alias("company_id"),
            "bank_account_id",
            pick(key, ("ofx", "csv", "pdf")).alias("source"),
            F.when(key % 23 != 0, F.concat(F.lit("h"), (key - key % 2).cast("string"))).alias("file_hash"),
            "period_start",
            F.when(key % 5 == 0, None)
            .when(key % 3 == 0, F.last_day("period_start"))
            .otherwise(F.col("last"))
            .alias("period_end"),
            F.when(key % 7 != 0, F.col("total")).alias("statement_balance"),
            F.when(key % 11 != 0, F.col("last")).alias("statement_balance_date"),
            "line_count",
            (
                F.col("period_start").cast("timestamp_ntz")
                + F.make_dt_interval(days=((key * 37) % 90).cast("int"))
            ).alias("created_at"),
        )

    @cached_property
    def rules(self) -> DataFrame:
        key = F.col("p_partkey")
        text = (
            F.when(key % 8 == 0, "urgent cliente")
            .when(key % 8 == 1, "Pix Enviado")
            .when(key % 8 == 2, F.concat(F.lit("cliente "), (key % 500).cast("string")))
            .when(key % 8 == 3, "TED")
            .when(key % 8 == 4, F.col("p_name"))
            .when(key % 8 == 5, "boleto 3-medium")
            .when(key % 8 == 6, "manutenção")
            .otherwise("  ")
        )
        return self.raw("part").select(
            key.alias("id"),
            (key % COMPANIES).alias("company_id"),
            text.alias("match_text"),
            F.when(key % 31 == 0, key % 1000).alias("bank_account_id"),
            F.when(key % 6 == 0, "entrada").when(key % 6 == 1, "saida").alias("direction"),
            F.when(key % 9 != 0, (key % COMPANIES) * 10 + 1 + key % 5).alias("category_id"),
            F.when(key % 9 == 0, key % 100).alias("counterparty_id"),
            F.lit(None).cast("bigint").alias("cost_center_id"),
            F.col("p_size").alias("priority"),
            (key % 4).alias("hit_count"),
            (key % 13 != 0).alias("is_active"),
        )

    @cached_property
    def recurrences(self) -> DataFrame:
        key = F.col("s_suppkey")
        start = F.date_add(F.lit("1998-01-01").cast("date"), ((key * 17) % 700).cast("int"))
        return self.raw("supplier").select(
            key.alias("id"),
            (key % COMPANIES).alias("company_id"),
            key.alias("bank_account_id"),
            F.concat(F.lit("Recorrência "), F.col("s_name")).alias("description"),
            F.when(key % 2 == 0, from_decimal(F.col("s_acctbal")))
            .otherwise(-from_decimal(F.col("s_acctbal")))
            .alias("amount"),
            pick(key, FREQUENCIES).alias("frequency"),
            F.when(key % 3 != 0, (1 + (key * 7) % 31).cast("int")).alias("day_of_month"),
            start.alias("start_date"),
            F.when(key % 5 == 0, F.date_add(start, 400)).alias("end_date"),
            F.when(key % 4 == 0, F.lit("1999-06-30").cast("date")).alias("generated_until"),
            (key % 10 != 0).alias("is_active"),
        )

    @cached_property
    def closings(self) -> DataFrame:
        """One closing per company and month with movement; those from December 1999 on are reopened."""
        period = F.trunc(F.col("o_orderdate").cast("date"), "MM")
        months = F.col("company_id") * 1000 + F.year("period") * 12 + F.month("period") - 1 - 1995 * 12
        locked = (F.col("id") % 3 != 0) & (F.col("period") < F.lit("1999-12-01").cast("date"))
        at = F.col("period").cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(40))
        return (
            self.raw("orders")
            .select((F.col("o_custkey") % COMPANIES).alias("company_id"), period.alias("period"))
            .distinct()
            .withColumn("id", months)
            .select(
                "id",
                "company_id",
                "period",
                F.when(locked, at).alias("locked_at"),
                F.when(locked, F.col("company_id")).alias("locked_by"),
                F.when(~locked, at).alias("reopened_at"),
                F.when(~locked, F.col("company_id") + 1).alias("reopened_by"),
                F.when(~locked & (F.col("id") % 2 == 0), "ajuste").alias("reopen_reason"),
            )
        )

    @cached_property
    def invoices(self) -> DataFrame:
        key, client = F.col("o_orderkey"), F.col("o_custkey")
        amount = from_decimal(F.col("o_totalprice"))
        size = F.when(client % 29 == 3, 12).when(client % 2 == 0, 14).otherwise(11)
        return self.raw("orders").select(
            key.alias("id"),
            (client % COMPANIES).alias("company_id"),
            (key - key % 2).cast("string").alias("number"),
            F.when(key % 3 == 0, "A").alias("series"),
            F.col("o_orderdate").cast("date").alias("issued_on"),
            amount.alias("amount"),
            ((amount * 65 - (amount * 65) % 1000) / 1000).cast("bigint").alias("withheld_amount"),
            client.alias("counterparty_id"),
            F.concat(F.lit("Cliente "), client).alias("client_name"),
            F.when(
                client % 13 != 0, F.lpad((client * 7919 + 11).cast("string"), size, F.lit("0"))
            ).alias("client_tax_id"),
            F.when(key % 17 == 0, "cancelada").otherwise("aberta").alias("status"),
        )

    @cached_property
    def settlements(self) -> DataFrame:
        key, line = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")
        return (
            self.raw("lineitem")
            .groupBy(key.alias("invoice_id"), line.alias("n"))
            .agg(
                F.sum(from_decimal(F.col("l_extendedprice"))).alias("amount"),
                F.max("l_shipdate").alias("created_at"),
            )
            .select(
                (F.col("invoice_id") * 10 + F.col("n")).alias("id"),
                "invoice_id",
                (F.col("invoice_id") + F.col("n") - 1).alias("transaction_id"),
                "amount",
                "created_at",
            )
        )

    @cached_property
    def audit_log(self) -> DataFrame:
        key = F.col("event_id")
        action = (
            F.when(F.col("event_type") == "signup", "INSERT")
            .when(F.col("event_type") == "error", "DELETE")
            .otherwise("UPDATE")
        )
        old = F.concat(
            F.lit('{"k": '), (key % 100).cast("string"), F.lit(', "updated_at": "'),
            key.cast("string"), F.lit('", "gone": '), (key % 3).cast("string"), F.lit("}"),
        )
        return self.raw("events").select(
            key.alias("id"),
            (F.col("user_id") % COMPANIES).alias("company_id"),
            pick(key, ("transactions", "bank_accounts", "invoices", "monthly_closings")).alias(
                "table_name"
            ),
            F.col("user_id").alias("row_id"),
            action.alias("action"),
            F.when(action != "INSERT", old).alias("old_data"),
            F.when(action != "DELETE", F.col("props")).alias("new_data"),
            F.when(key % 6 != 0, F.col("user_id") % 40).alias("changed_by"),
            F.col("ts").alias("changed_at"),
        )

    @cached_property
    def memberships(self) -> DataFrame:
        """Each customer key is a user of two companies."""
        key = F.col("c_custkey")
        pairs = F.array(
            F.struct((key % COMPANIES).alias("c"), (key % 4).alias("r")),
            F.struct(((key + 7) % COMPANIES).alias("c"), ((key + 1) % 4).alias("r")),
        )
        return (
            self.raw("customer")
            .select(key.alias("user_id"), F.explode(pairs).alias("m"))
            .select(
                F.col("m.c").alias("company_id"),
                "user_id",
                pick(F.col("m.r"), ("cliente_leitura", "assistente", "contador", "owner")).alias("role"),
            )
        )

    @cached_property
    def profile_accounts(self) -> DataFrame:
        """Account sets: four per company, overlapping."""
        key = F.col("c_custkey")
        slot = ((key - key % COMPANIES) / COMPANIES).cast("bigint")
        ids = F.array((key % COMPANIES) * 10 + slot % 4, (key % COMPANIES) * 10 + (slot + 1) % 4)
        return (
            self.raw("customer")
            .select(key.alias("bank_account_id"), F.explode(ids).alias("profile_id"))
            .select("profile_id", "bank_account_id")
        )

    # Tables where many rows share an account and an amount, so that one-to-one matching has
    # contests to decide.

    @cached_property
    def contested_transactions(self) -> DataFrame:
        key, account = F.col("o_orderkey"), F.col("o_custkey")
        pool = ((account - account % 15) / 15).cast("bigint")
        return self.raw("orders").select(
            key.alias("id"),
            (pool % COMPANIES).alias("company_id"),
            pool.alias("bank_account_id"),
            F.col("o_orderdate").cast("date").alias("booking_date"),
            (F.when(key % 4 >= 2, -1000).otherwise(1000) * (1 + key % 3)).cast("bigint").alias("amount"),
            F.concat(pick(key, MEMO_WORDS), F.lit(" "), F.col("o_orderpriority")).alias("description"),
            F.when(key % 6 == 0, key.cast("string")).alias("document_number"),
        )

    @cached_property
    def contested_lines(self) -> DataFrame:
        key, account = F.col("o_orderkey"), F.col("o_custkey")
        pool = ((account - account % 15) / 15).cast("bigint")
        text = F.concat(pick(key, MEMO_WORDS), F.lit(" "), F.lower("o_orderpriority"))
        return (
            self.raw("orders")
            .select(
                key.alias("id"),
                (pool % COMPANIES).alias("company_id"),
                pool.alias("bank_account_id"),
                F.date_add(F.col("o_orderdate").cast("date"), (key % 9).cast("int")).alias("posted_at"),
                (
                    F.when(key % 4 >= 2, -1000).otherwise(1000) * (1 + key % 3)
                    + F.when(key % 10 == 3, 7).otherwise(0)
                    + F.when(key % 7 == 0, 11).otherwise(0)
                )
                .cast("bigint")
                .alias("amount"),
                F.when(key % 12 == 0, F.concat(text, F.lit(" nr "), key)).otherwise(text).alias("memo"),
            )
        )

    # Files. Each holds a bounded run of consecutive keys, so building one never gathers more
    # than that many rows.

    def _file_lines(self, size: int) -> DataFrame:
        key, account = F.col("o_orderkey"), F.col("o_custkey")
        price = from_decimal(F.col("o_totalprice"))
        return self.raw("orders").select(
            ((key - key % size) / size).cast("bigint").alias("no"),
            key.alias("key"),
            account.alias("account"),
            F.col("o_orderdate").cast("date").alias("day"),
            F.when(key % 4 >= 2, -price).otherwise(price).alias("cents"),
            F.concat(pick(key, MEMO_WORDS), F.lit(" & "), F.lower("o_orderpriority")).alias("memo"),
            F.concat(
                F.lit("Cliente "),
                account.cast("string"),
                F.when(key % 8 == 0, " 12.345.678/0001-90").otherwise(""),
            ).alias("name"),
        )

    @cached_property
    def ofx_files(self) -> DataFrame:
        """(file, content): SGML in windows-1252 and XML in UTF-8, with some broken entries."""
        from razao.functions.money import to_db

        key = F.col("key")
        xml = F.col("no") % 2 == 1
        escaped = F.replace(F.col("memo"), F.lit("&"), F.lit("&amp;"))
        amount = F.when(key % 6 == 1, F.translate(to_db(F.col("cents")), ".", ",")).otherwise(
            to_db(F.col("cents"))
        )
        posted = F.when(key % 97 == 5, "20250230").otherwise(
            F.concat(F.date_format("day", "yyyyMMdd"), F.lit("120000[-3:BRT]"))
        )

        def leaf(tag: str, value: Column) -> Column:
            return F.concat(
                F.lit(f"<{tag}>"), value, F.when(xml, f"</{tag}>").otherwise(""), F.lit("\r\n")
            )

        entry = F.concat(
            F.lit("<STMTTRN>\r\n"),
            leaf("TRNTYPE", F.lit("OTHER")),
            leaf("DTPOSTED", posted),
            F.when(key % 89 == 7, "").otherwise(leaf("TRNAMT", amount)),
            F.when(key % 9 == 0, "").otherwise(leaf("FITID", F.concat(F.lit("F"), key.cast("string")))),
            leaf("NAME", F.when(key % 15 == 2, escaped).otherwise(F.col("name"))),
            leaf("MEMO", escaped),
            F.lit("</STMTTRN>\r\n"),
        )
        files = self._file_lines(50).groupBy("no").agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("key", entry.alias("e")))), lambda r: r["e"]
                ),
                "",
            ).alias("entries"),
            F.min("day").alias("first"),
            F.last_day(F.max("day")).alias("last"),
            F.max("day").alias("newest"),
            F.sum("cents").alias("total"),
        )
        stamp = lambda d: F.date_format(d, "yyyyMMdd")
        made = F.when(F.col("no") % 3 == 0, F.date_sub("last", 1)).otherwise(F.date_add("last", 5))
        head = F.when(xml, '<?xml version="1.0" encoding="UTF-8"?>\r\n<?OFX OFXHEADER="200"?>\r\n').otherwise(
            "OFXHEADER:100\r\nDATA:OFXSGML\r\nENCODING:USASCII\r\nCHARSET:1252\r\n\r\n"
        )
        text = F.concat(
            head,
            F.lit("<OFX>\r\n<SIGNONMSGSRSV1>\r\n<SONRS>\r\n<STATUS>\r\n"),
            leaf("CODE", F.lit("0")),
            F.lit("</STATUS>\r\n"),
            leaf("DTSERVER", stamp(made)),
            F.lit("</SONRS>\r\n</SIGNONMSGSRSV1>\r\n<STMTRS>\r\n<BANKACCTFROM>\r\n"),
            leaf("BANKID", F.lit("341")),
            leaf("ACCTID", F.concat(F.col("no").cast("string"), F.lit("-0"))),
            F.lit("</BANKACCTFROM>\r\n<BANKTRANLIST>\r\n"),
            leaf("DTSTART", stamp(F.col("first"))),
            leaf("DTEND", stamp(F.col("last"))),
            F.col("entries"),
            F.lit("</BANKTRANLIST>\r\n<LEDGERBAL>\r\n"),
            leaf("BALAMT", to_db(F.col("total"))),
            leaf("DTASOF", stamp(F.col("last"))),
            F.lit("</LEDGERBAL>\r\n</STMTRS>\r\n</OFX>\r\n"),
        )
        content = F.when(xml, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
        return files.select(F.concat(F.lit("o"), F.col("no").cast("string")).alias("file"), content.alias("content"))

    @cached_property
    def csv_files(self) -> DataFrame:
        """(file, content): signed amounts with preamble, or debit and credit columns."""
        from razao.functions.money import format_amount, to_db

        key, split = F.col("key"), F.col("no") % 3 == 1
        quoted = F.concat(
            F.lit('"'),
            F.replace(F.col("memo"), F.lit(" & "), F.when(key % 25 == 6, '; \n""X"", ').otherwise('; ""X"", ')),
            F.lit('"'),
        )
        memo = F.when(key % 10 == 4, quoted).when(key % 25 == 6, quoted).otherwise(F.col("memo"))
        when = F.date_format("day", "dd/MM/yyyy")
        plain = to_db(F.abs("cents"))
        signed_row = F.concat_ws(
            ";", when, memo, F.lpad(key.cast("string"), 6, F.lit("0")), format_amount(F.col("cents"))
        )
        split_row = F.concat_ws(
            ",",
            when,
            memo,
            F.when(F.col("cents") < 0, plain).otherwise(""),
            F.when(F.col("cents") > 0, plain).otherwise(""),
        )
        row = F.when(split, split_row).otherwise(signed_row)
        files = self._file_lines(50).groupBy("no").agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("key", row.alias("r")))), lambda x: x["r"]
                ),
                "\r\n",
            ).alias("rows")
        )
        head = F.when(split, "Data,Lançamento,Débito,Crédito\r\n").otherwise(
            "\ufeffExtrato de Conta Corrente\r\nAgencia: 1234  Conta: 56789-0\r\n\r\n"
            "Data;Histórico;Documento;Valor\r\n"
        )
        tail = F.when(split, "").otherwise("\r\nSALDO FINAL;;;10.600,10")
        return files.select(
            F.concat(F.lit("c"), F.col("no").cast("string")).alias("file"),
            F.encode(F.concat(head, F.col("rows"), tail), "UTF-8").alias("content"),
        )

    @cached_property
    def invoice_files(self) -> DataFrame:
        """(file, company_id, content): municipal batches of ten and single national ones."""
        from razao.functions.money import to_db

        key = F.col("key")
        lines = self._file_lines(10).withColumn("cents", F.abs("cents"))
        issued = F.when(key % 23 == 5, "2025-02-30").otherwise(F.col("day").cast("string"))
        document = F.lpad((F.col("account") * 7919 + 11).cast("string"), 14, F.lit("0"))
        amount = to_db(F.col("cents"))
        number = key.cast("string")
        withheld = to_db(((F.col("cents") - F.col("cents") % 100) / 100).cast("bigint"))
        client = F.concat(
            F.lit("<Tomador><IdentificacaoTomador><CpfCnpj><Cnpj>"), document,
            F.lit("</Cnpj></CpfCnpj></IdentificacaoTomador><RazaoSocial>Cliente &amp; "),
            F.col("account").cast("string"), F.lit(" Ltda</RazaoSocial></Tomador>"),
        )
        municipal = F.concat(
            F.lit("<CompNfse><Nfse versao=\"2.03\"><InfNfse><Numero>"), number,
            F.lit("</Numero><CodigoVerificacao>AB12</CodigoVerificacao><DataEmissao>"), issued,
            F.lit("T14:32:10</DataEmissao><ValoresNfse><ValorServicos>"), amount,
            F.lit("</ValorServicos><ValorLiquidoNfse>1.00</ValorLiquidoNfse></ValoresNfse><ValorIr>"),
            withheld,
            F.lit("</ValorIr><ValorInss>0.10</ValorInss><Prestador><Cnpj>11222333000181</Cnpj>"
                  "<RazaoSocial>Prestador Ltda</RazaoSocial></Prestador>"),
            F.when(key % 19 == 4, "").otherwise(client),
            F.lit("</InfNfse></Nfse></CompNfse>"),
        )
        batches = (
            lines.where(F.col("no") % 2 == 0)
            .groupBy("no")
            .agg(
                F.array_join(
                    F.transform(
                        F.array_sort(F.collect_list(F.struct("key", municipal.alias("x")))), lambda r: r["x"]
                    ),
                    "\n",
                ).alias("body")
            )
            .select(
                F.concat(F.lit("b"), F.col("no").cast("string")).alias("file"),
                (F.col("no") % COMPANIES).alias("company_id"),
                F.encode(
                    F.concat(
                        F.lit('<?xml version="1.0" encoding="ISO-8859-1"?>\n<ConsultarNfseResposta>'
                              '<ListaNfse>'),
                        F.col("body"),
                        F.lit("</ListaNfse></ConsultarNfseResposta>"),
                    ),
                    "ISO-8859-1",
                ).alias("content"),
            )
        )
        national = F.concat(
            F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<NFSe xmlns="http://www.sped.fazenda.gov.br/nfse">'
                  "<infNFSe><nNFSe>"), number,
            F.lit("</nNFSe><DPS><infDPS><dhEmi>"), issued,
            F.lit("T09:00:00-03:00</dhEmi><prest><CNPJ>11222333000181</CNPJ><xNome>Prestador</xNome></prest>"
                  "<toma><CNPJ>"), document,
            F.lit("</CNPJ><xNome>Cliente "), F.col("account").cast("string"),
            F.lit("</xNome></toma><valores><vServPrest><vServ>"), amount,
            F.lit("</vServ></vServPrest><trib><tribFed><vRetIRRF>"), withheld,
            F.lit("</vRetIRRF></tribFed></trib></valores></infDPS></DPS></infNFSe>"),
            F.when(key % 31 == 6, "").otherwise("</NFSe>"),
        )
        singles = lines.where(F.col("no") % 2 == 1).select(
            F.concat(F.lit("n"), number).alias("file"),
            (F.col("no") % COMPANIES).alias("company_id"),
            F.encode(national, "UTF-8").alias("content"),
        )
        return batches.unionByName(singles)

    @cached_property
    def contested_invoices(self) -> DataFrame:
        """Open invoices with few distinct amounts, so that sums and withholdings occur."""
        key, client = F.col("o_orderkey"), F.col("o_custkey")
        return self.raw("orders").select(
            key.alias("id"),
            (client % COMPANIES).alias("company_id"),
            key.cast("string").alias("number"),
            F.col("o_orderdate").cast("date").alias("issued_on"),
            (100 * (1 + key % 97)).alias("outstanding"),
            F.when(client % 13 != 0, F.lpad((client + 11).cast("string"), 14, F.lit("0"))).alias(
                "client_tax_id"
            ),
        )

    @cached_property
    def contested_credits(self) -> DataFrame:
        key, client = F.col("o_orderkey"), F.col("o_custkey")
        amount = (
            F.when(key % 3 == 0, 100 * (1 + key % 97))
            .when(key % 3 == 1, 100 * (2 + key % 150))
            .otherwise(90 * (1 + key % 97))
        )
        return self.raw("orders").select(
            key.alias("id"),
            (client % COMPANIES).alias("company_id"),
            F.date_add(F.col("o_orderdate").cast("date"), 20).alias("booking_date"),
            amount.alias("amount"),
            F.when(key % 5 != 0, F.lpad((client + 11).cast("string"), 14, F.lit("0"))).alias(
                "payer_tax_id"
            ),
        )
