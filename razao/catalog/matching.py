"""Queries: text, statement matching and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from razao.adapters import Model
from razao.catalog.base import query
from razao.catalog.model_sql import NORMAL, TAX_ID
from razao.functions import text as txt
from razao.functions.money import direction_of
from razao.operators import matching as mat
from razao.operators import rules as rul
from razao.plans import reconcile as rec


def _norm(column: str) -> str:
    return NORMAL.format(column)


def _tokens(column: str) -> str:
    return f"list_distinct(list_filter(string_split({_norm(column)}, ' '), lambda w: length(w) > 1))"


@query("normalize_text", sql=f"SELECT doc_id, {_norm('text')} AS normal FROM documents")
def normalize_text(m: Model):
    return m.raw("documents").select("doc_id", txt.normalize_text(F.col("text")).alias("normal"))


_JACCARD = """CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0::DOUBLE
    ELSE len(list_intersect({0}, {1}))::DOUBLE
         / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"""

# Lines and transactions of one order, compared as texts.
_TEXT_PAIRS = f""", texts AS (
    SELECT l.id, l.memo, t.description, t.document_number,
           abs(date_diff('day', l.posted_at, t.booking_date)) AS day_gap,
           {_norm('l.memo')} AS memo_norm, {_tokens('l.memo')} AS a, {_tokens('t.description')} AS b
    FROM statement_lines l JOIN transactions t USING (id)),
scored AS (SELECT *, {_JACCARD.format('a', 'b')} AS similarity,
           coalesce(length(document_number) > 2
               AND contains(memo_norm, {_norm('document_number')}), false) AS document_hit
           FROM texts) """


def _text_pairs(m: Model):
    lines = m.statement_lines.select("id", "memo", "posted_at")
    txns = m.transactions.select("id", "description", "document_number", "booking_date")
    pairs = lines.join(txns, "id").withColumn(
        "day_gap", F.abs(F.datediff("posted_at", "booking_date"))
    )
    similarity = txt.text_similarity(F.col("memo"), F.col("description"))
    hit = txt.document_hit(txt.normalize_text(F.col("memo")), F.col("document_number"))
    return pairs.withColumn("similarity", similarity).withColumn("document_hit", hit)


@query(
    "text_similarity",
    "statement_lines transactions",
    _TEXT_PAIRS + "SELECT id, round(similarity, 6) AS similarity FROM scored",
)
def text_similarity(m: Model):
    return _text_pairs(m).select("id", F.round("similarity", 6).alias("similarity"))


@query(
    "token_sets",
    "statement_lines transactions",
    _TEXT_PAIRS + """SELECT id, array_to_string(list_sort(list_intersect(a, b)), ' ') AS shared,
       len(list_distinct(list_concat(a, b))) AS all_words FROM scored""",
)
def token_sets(m: Model):
    a, b = txt.tokens(F.col("memo")), txt.tokens(F.col("description"))
    return _text_pairs(m).select(
        "id",
        F.array_join(F.array_sort(F.array_intersect(a, b)), " ").alias("shared"),
        F.size(F.array_union(a, b)).cast("bigint").alias("all_words"),
    )


@query(
    "document_hit",
    "statement_lines transactions",
    _TEXT_PAIRS + "SELECT id, document_hit FROM scored",
)
def document_hit(m: Model):
    return _text_pairs(m).select("id", "document_hit")


_SCORE = """round(greatest(0, 100 - day_gap * 8) + similarity * 40
    + CASE WHEN document_hit THEN 50 ELSE 0 END, 6)"""
_REASON = """concat_ws(', ', 'mesmo valor',
    CASE WHEN day_gap = 0 THEN 'mesma data'
         ELSE day_gap || CASE WHEN day_gap = 1 THEN ' dia' ELSE ' dias' END || ' de diferença' END,
    CASE WHEN document_hit THEN 'número do documento no histórico' END,
    CASE WHEN similarity >= 0.5 THEN 'descrição parecida' END,
    CASE WHEN day_gap > 3 THEN 'confirme antes de aceitar' END)"""


@query(
    "match_score",
    "statement_lines transactions",
    _TEXT_PAIRS + f"SELECT id, {_SCORE} AS score FROM scored",
)
def match_score(m: Model):
    score = mat.match_score(F.col("day_gap"), F.col("similarity"), F.col("document_hit"))
    return _text_pairs(m).select("id", score.alias("score"))


@query(
    "match_reason",
    "statement_lines transactions",
    _TEXT_PAIRS + f"SELECT id, {_REASON} AS reason FROM scored",
)
def match_reason(m: Model):
    reason = mat.match_reason(F.col("day_gap"), F.col("similarity"), F.col("document_hit"), 3)
    return _text_pairs(m).select("id", reason.alias("reason"))


# Matching on the contested tables: the sequential scan over all sorted pairs of a group.
_PAIRS = f""", l AS (SELECT *, {_norm('memo')} AS memo_norm, {_tokens('memo')} AS a
         FROM contested_lines),
t AS (SELECT *, {_tokens('description')} AS b, {_norm('document_number')} AS document_norm
      FROM contested_transactions),
pairs AS (
    SELECT l.company_id, l.bank_account_id, l.amount, l.id AS line_id, t.id AS transaction_id,
           posted_at, memo, booking_date, description, document_number,
           abs(date_diff('day', posted_at, booking_date)) AS day_gap,
           {_JACCARD.format('a', 'b')} AS similarity,
           coalesce(length(document_number) > 2 AND contains(memo_norm, document_norm), false)
               AS document_hit
    FROM l JOIN t ON l.company_id = t.company_id AND l.bank_account_id = t.bank_account_id
      AND l.amount = t.amount AND abs(date_diff('day', posted_at, booking_date)) <= 30),
scored AS (SELECT *, {_SCORE} AS score, {_REASON} AS reason FROM pairs) """
_GREEDY = _PAIRS + """, assigned AS (
    SELECT list_reduce(list_transform(p, lambda x: {'l': [x.l], 't': [x.t]}),
        lambda done, x: CASE WHEN list_contains(done.l, x.l[1]) OR list_contains(done.t, x.t[1])
            THEN done ELSE {'l': list_concat(done.l, x.l), 't': list_concat(done.t, x.t)} END) AS m
    FROM (SELECT list({'l': line_id, 't': transaction_id} ORDER BY -score, day_gap, posted_at, memo,
              line_id, booking_date, description, coalesce(document_number, ''), transaction_id) AS p
          FROM scored GROUP BY company_id, bank_account_id, amount)),
matches AS (
    SELECT s.* FROM scored s JOIN (SELECT unnest(m.l) AS line_id, unnest(m.t) AS transaction_id
                                   FROM assigned) USING (line_id, transaction_id)) """
_MATCH_COLUMNS = """company_id, bank_account_id, line_id, transaction_id, amount,
    posted_at::VARCHAR AS posted_at, booking_date::VARCHAR AS booking_date,
    CASE WHEN day_gap <= 3 THEN 'exact' ELSE 'likely' END AS confidence, day_gap::INTEGER AS day_gap,
    score, reason"""
_CONTESTED = "contested_lines contested_transactions"


def _matches(m: Model, **options):
    return mat.match_statement(m.contested_lines, m.contested_transactions, **options)


@query(
    "match_candidates",
    _CONTESTED,
    _PAIRS + """SELECT company_id, bank_account_id, amount, posted_at::VARCHAR AS posted_at, memo,
       booking_date::VARCHAR AS booking_date, description, document_number,
       count(DISTINCT line_id) AS n_lines, count(DISTINCT transaction_id) AS n_transactions,
       min(line_id) AS first_line_id, min(transaction_id) AS first_transaction_id,
       any_value(day_gap)::INTEGER AS day_gap, any_value(similarity) AS similarity,
       any_value(document_hit) AS document_hit, any_value(score) AS score,
       any_value(reason) AS reason,
       CASE WHEN any_value(day_gap) <= 3 THEN 'exact' ELSE 'likely' END AS confidence
       FROM scored GROUP BY company_id, bank_account_id, amount, scored.posted_at, memo,
                            scored.booking_date, description, document_number""",
)
def match_candidates(m: Model):
    return mat.match_candidates(m.contested_lines, m.contested_transactions)


@query("match_statement", _CONTESTED, _GREEDY + f"SELECT {_MATCH_COLUMNS} FROM matches")
def match_statement(m: Model):
    return _matches(m)


@query("greedy_order", _CONTESTED, _GREEDY + "SELECT line_id, transaction_id FROM matches")
def greedy_order(m: Model):
    """The same assignment through the path for large groups, from a low bound on."""
    return mat.assign_lines(
        m.contested_lines, m.contested_transactions, small_group_pairs=200
    ).select("line_id", "transaction_id")


@query(
    "all_matches",
    _CONTESTED,
    _GREEDY + """SELECT CASE WHEN day_gap <= 3 THEN 'exact' ELSE 'likely' END AS confidence,
       count(*) AS matches, sum(amount)::BIGINT AS total FROM matches GROUP BY 1""",
)
def all_matches(m: Model):
    return _matches(m).groupBy("confidence").agg(
        F.count("*").alias("matches"), F.sum("amount").alias("total")
    )


@query(
    "unmatched_lines",
    _CONTESTED,
    _GREEDY + """SELECT id, bank_account_id, amount, memo FROM contested_lines
       WHERE id NOT IN (SELECT line_id FROM matches)""",
)
def unmatched_lines(m: Model):
    return mat.unmatched_lines(m.contested_lines, _matches(m)).select(
        "id", "bank_account_id", "amount", "memo"
    )


@query(
    "unmatched_txns",
    _CONTESTED,
    _GREEDY + """SELECT id, bank_account_id, amount, description FROM contested_transactions
       WHERE id NOT IN (SELECT transaction_id FROM matches)""",
)
def unmatched_txns(m: Model):
    return mat.unmatched_transactions(m.contested_transactions, _matches(m)).select(
        "id", "bank_account_id", "amount", "description"
    )


_DIVERGENCES = _GREEDY + """, found AS (
    SELECT 'missing_in_system' AS kind, company_id, bank_account_id, posted_at AS date, amount,
           memo AS description, id AS source_id FROM contested_lines
    WHERE id NOT IN (SELECT line_id FROM matches)
    UNION ALL
    SELECT 'missing_in_statement', company_id, bank_account_id, booking_date, amount, description, id
    FROM contested_transactions WHERE id NOT IN (SELECT transaction_id FROM matches)) """


def _divergences(m: Model):
    return mat.divergences(m.contested_lines, m.contested_transactions, _matches(m))


@query(
    "divergences",
    _CONTESTED,
    _DIVERGENCES + """SELECT kind, company_id, bank_account_id, date::VARCHAR AS date, amount,
       description, source_id FROM found""",
)
def divergences(m: Model):
    return _divergences(m)


@query(
    "divergence_order",
    _CONTESTED,
    _DIVERGENCES + """SELECT kind, bank_account_id, date::VARCHAR AS date, amount, source_id FROM found
       ORDER BY bank_account_id, found.date, amount, kind = 'missing_in_statement', source_id""",
)
def divergence_order(m: Model):
    from razao.operators.ordering import divergence_order as order

    return order(_divergences(m)).select(
        "kind", "bank_account_id", "date", "amount", "source_id"
    )


@query(
    "divergence_sum",
    _CONTESTED,
    _DIVERGENCES + """SELECT company_id, bank_account_id, count(*) AS divergences,
       sum(CASE kind WHEN 'missing_in_system' THEN amount ELSE -amount END)::BIGINT AS explained
       FROM found GROUP BY ALL""",
)
def divergence_sum(m: Model):
    return mat.divergence_sum(_divergences(m))


# Rules

_APPLIES = f""", r AS (SELECT *, {_norm('match_text')} AS needle FROM rules WHERE is_active),
item AS (SELECT *, {_norm('memo')} AS memo_norm,
                CASE WHEN amount > 0 THEN 'entrada' ELSE 'saida' END AS direction
         FROM statement_lines WHERE status = 'pendente'),
applied AS (
    SELECT item.id AS line_id, item.company_id, r.id AS rule_id, r.category_id, r.priority,
           length(r.match_text)::INTEGER AS text_length
    FROM item JOIN r ON r.company_id = item.company_id AND needle <> ''
      AND (r.bank_account_id IS NULL OR r.bank_account_id = item.bank_account_id)
      AND (r.direction IS NULL OR r.direction = item.direction) AND contains(memo_norm, needle)),
top AS (SELECT * FROM applied QUALIFY row_number() OVER (PARTITION BY line_id
        ORDER BY priority, text_length DESC, rule_id) = 1) """


def _pending(m: Model):
    return m.statement_lines.where("status = 'pendente'")


@query(
    "rule_join",
    "rules statement_lines",
    _APPLIES + "SELECT line_id, company_id, rule_id, priority, text_length FROM applied",
)
def rule_join(m: Model):
    return rul.rule_join(_pending(m), m.rules)


@query(
    "top_rule",
    "rules statement_lines",
    _APPLIES + """SELECT item.id, item.company_id, rule_id AS applied_rule_id,
       category_id AS rule_category_id FROM item LEFT JOIN top ON top.line_id = item.id""",
)
def top_rule(m: Model):
    return rul.top_rule(_pending(m), m.rules).select(
        "id", "company_id", "applied_rule_id", "rule_category_id"
    )


@query(
    "rule_hits",
    "rules statement_lines",
    _APPLIES + """SELECT id, company_id, hit_count + (SELECT count(*) FROM top
           WHERE top.rule_id = rules.id AND top.category_id IS NOT NULL) AS hit_count FROM rules""",
)
def rule_hits(m: Model):
    applied = rul.top_rule(_pending(m), m.rules).where("rule_category_id IS NOT NULL")
    hits = applied.select("company_id", F.col("applied_rule_id").alias("rule_id"))
    return rul.rule_hits(m.rules, hits).select("id", "company_id", "hit_count")


_NOISE = "[" + ", ".join(f"'{w}'" for w in txt.RULE_NOISE) + "]"


def _suggest(column: str) -> str:
    return f"""array_to_string(list_filter(string_split({_norm(column)}, ' '), lambda w: length(w) > 2
        AND NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains({_NOISE}, w))[1:3], ' ')"""


@query(
    "suggest_rule_text",
    "statement_lines",
    f"""SELECT 'line' AS kind, id, {_suggest('memo')} AS rule_text FROM statement_lines
        UNION ALL SELECT 'document', doc_id, {_suggest('text')} FROM documents""",
)
def suggest_rule_text(m: Model):
    lines = m.statement_lines.select(
        F.lit("line").alias("kind"), "id", txt.suggest_rule_text(F.col("memo")).alias("rule_text")
    )
    documents = m.raw("documents").select(
        F.lit("document"), "doc_id", txt.suggest_rule_text(F.col("text"))
    )
    return lines.union(documents)


@query(
    "learn_rule",
    "statement_lines transactions",
    f"""SELECT DISTINCT l.company_id, l.bank_account_id,
       CASE WHEN l.amount > 0 THEN 'entrada' ELSE 'saida' END AS direction, t.category_id,
       {_suggest('l.memo')} AS match_text
       FROM statement_lines l JOIN transactions t ON t.id = l.matched_transaction_id
       WHERE l.status = 'criada' AND t.category_id IS NOT NULL AND {_suggest('l.memo')} <> ''""",
)
def learn_rule(m: Model):
    confirmed = m.statement_lines.where("status = 'criada'").join(
        m.transactions.select(F.col("id").alias("matched_transaction_id"), "category_id"),
        "matched_transaction_id",
    )
    return rul.learn_rule(confirmed)


@query(
    "direction_of",
    "statement_lines",
    """SELECT id, CASE WHEN amount > 0 THEN 'entrada' ELSE 'saida' END AS direction,
       amount > 0 AS is_inflow, amount < 0 AS is_outflow FROM statement_lines""",
)
def direction_of_query(m: Model):
    from razao.functions.money import is_inflow, is_outflow

    amount = F.col("amount")
    return m.statement_lines.select(
        "id",
        direction_of(amount).alias("direction"),
        is_inflow(amount).alias("is_inflow"),
        is_outflow(amount).alias("is_outflow"),
    )


# Plans

_PLAN = _GREEDY + f""", r AS (SELECT *, {_norm('match_text')} AS needle FROM rules WHERE is_active),
item AS (SELECT *, {_norm('memo')} AS memo_norm,
                CASE WHEN amount > 0 THEN 'entrada' ELSE 'saida' END AS direction
         FROM contested_lines WHERE id NOT IN (SELECT line_id FROM matches)),
top AS (
    SELECT item.id AS line_id, r.id AS rule_id, r.category_id
    FROM item JOIN r ON r.company_id = item.company_id AND needle <> ''
      AND (r.bank_account_id IS NULL OR r.bank_account_id = item.bank_account_id)
      AND (r.direction IS NULL OR r.direction = item.direction) AND contains(memo_norm, needle)
    QUALIFY row_number() OVER (PARTITION BY item.id
        ORDER BY r.priority, length(r.match_text) DESC, r.id) = 1) """


@query(
    "plan_auto_apply",
    _CONTESTED + " rules",
    _PLAN + """SELECT company_id, bank_account_id, line_id,
       CASE WHEN day_gap <= 3 THEN 'reconcile' ELSE 'suggested' END AS action, transaction_id,
       NULL::BIGINT AS category_id, NULL::BIGINT AS rule_id FROM matches
       UNION ALL
       SELECT company_id, bank_account_id, item.id,
              CASE WHEN category_id IS NOT NULL THEN 'create' ELSE 'uncategorized' END, NULL,
              category_id, CASE WHEN category_id IS NOT NULL THEN rule_id END
       FROM item LEFT JOIN top ON top.line_id = item.id""",
)
def plan_auto_apply(m: Model):
    plan = rec.plan_auto_apply(m.contested_lines, m.contested_transactions, m.rules)
    return rec.plan_decisions(plan)


@query(
    "review_queue",
    _CONTESTED + " rules",
    _PLAN + """SELECT 'match' AS kind, company_id, posted_at::VARCHAR AS posted_at, line_id,
       transaction_id, NULL::BIGINT AS category_id FROM matches
       UNION ALL SELECT 'categorize', company_id, posted_at::VARCHAR, item.id, NULL, category_id
       FROM item LEFT JOIN top ON top.line_id = item.id""",
)
def review_queue(m: Model):
    return rec.review_queue(m.contested_lines, m.contested_transactions, m.rules)


# Documents in text

_TAX_SQL = (
    f"nullif(regexp_replace(regexp_extract(body, '{TAX_ID}', 1), '[^0-9]', '', 'g'), '')"
)
_PUNCTUATED = """CASE length({0}) WHEN 14 THEN substr({0}, 1, 2) || '.' || substr({0}, 3, 3) || '.'
        || substr({0}, 6, 3) || '/' || substr({0}, 9, 4) || '-' || substr({0}, 13, 2)
    WHEN 11 THEN substr({0}, 1, 3) || '.' || substr({0}, 4, 3) || '.' || substr({0}, 7, 3) || '-'
        || substr({0}, 10, 2)
    ELSE coalesce({0}, '') END"""


@query(
    "extract_tax_id",
    "counterparties",
    f""", texts AS (SELECT id, 'PIX ' || {_PUNCTUATED.format('tax_id')} || ' de ' || name AS body
                    FROM counterparties
                    UNION ALL SELECT -1 - doc_id, text FROM documents)
    SELECT id, {_TAX_SQL} AS tax_id FROM texts""",
)
def extract_tax_id(m: Model):
    parties = m.counterparties.select(
        "id",
        F.concat(
            F.lit("PIX "), txt.format_tax_id(F.col("tax_id")), F.lit(" de "), F.col("name")
        ).alias("body"),
    )
    documents = m.raw("documents").select((-1 - F.col("doc_id")).alias("id"), "text")
    texts = parties.union(documents)
    return texts.select("id", txt.extract_tax_id(F.col("body")).alias("tax_id"))


@query(
    "format_tax_id",
    "counterparties",
    f"SELECT id, {_PUNCTUATED.format('tax_id')} AS shown FROM counterparties",
)
def format_tax_id(m: Model):
    return m.counterparties.select("id", txt.format_tax_id(F.col("tax_id")).alias("shown"))


@query(
    "normalize_tax_id",
    "counterparties",
    """SELECT id, tax_id AS digits, tax_id IS NOT NULL AND length(tax_id) IN (11, 14) AS valid
       FROM counterparties""",
)
def normalize_tax_id(m: Model):
    shown = m.counterparties.select(
        "id", F.concat(F.lit(" n. "), txt.format_tax_id(F.col("tax_id"))).alias("typed")
    )
    digits = txt.normalize_tax_id(F.col("typed"))
    return shown.select(
        "id", digits.alias("digits"), F.coalesce(txt.is_tax_id(digits), F.lit(False)).alias("valid")
    )
