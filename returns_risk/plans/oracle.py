"""SQL twins of the registered queries, for an independent engine (DuckDB)."""

from __future__ import annotations

import re
from string import Formatter

from returns_risk import constants as c
from returns_risk.plans.oracle_trees import FEATURE_NAMES, tree_ctes, whole_ctes
from returns_risk.sources.tables import PHRASES, TYPE_OF_EVENT


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _hits(text: str, terms: tuple[str, ...]) -> str:
    branches = "|".join(re.escape(term).replace("\\ ", " ") for term in terms)
    return f"CAST(len(regexp_extract_all(lower({text}), '\\b(?:{branches})\\b')) AS INTEGER)"


def _filled(template: str) -> str:
    parts = []
    for text, field, spec, _ in Formatter().parse(template):
        if text:
            parts.append(_quoted(text))
        if field is not None:
            parts.append(f"CAST({field} AS VARCHAR)" if spec == "d" else f"printf('%{spec}', {field})")
    return " || ".join(parts)


_CONDITIONS = {
    "rule_a": "rule_a = 1",
    "rule_b": "rule_b = 1",
    "rule_c": "rule_c = 1",
    "items_rate": "RefundRate_by_Items > 0.3",
    "value_rate": "RefundRate_by_Value > 0.2",
    "refund_tickets": "Tickets_TypeRefundRequest >= 2",
    "sentiment": "MinTicketSentimentScore < -0.5",
    "returned_items": "TotalItemsReturned > 5",
    "missing": "Tickets_KeywordMissingCount > 0",
    "damage": "Tickets_KeywordDamageCount > 0",
    "missing_or_damage": "Tickets_KeywordMissingCount > 0 OR Tickets_KeywordDamageCount > 0",
}


def _reasons(texts: tuple[tuple[str, str], ...]) -> str:
    cases = [f"CASE WHEN {_CONDITIONS[name]} THEN {_filled(text)} END" for name, text in texts]
    return "concat_ws(chr(10), " + ", ".join(cases) + ")"


_TYPE_CASES = " ".join(f"WHEN event_type = {_quoted(k)} THEN {_quoted(v)}" for k, v in TYPE_OF_EVENT.items())
_PHRASE_CASES = " ".join(
    f"WHEN {number} THEN {_quoted(text)}" for number, text in enumerate(PHRASES) if text is not None
)


def _tickets(long_text: bool) -> str:
    phrase = f"CASE (event_id * 7919) % 10 {_PHRASE_CASES} END"
    if long_text:
        phrase = f"coalesce({phrase}, '') || ' ' || coalesce(text, '')"
    source = "events LEFT JOIN documents ON doc_id = event_id" if long_text else "events"
    return f"""
    SELECT event_id AS TicketID,
           CASE WHEN event_id % 97 = 0 THEN NULL
                ELSE 'user' || user_id || '.' || (event_id % 20) || '@example.com' END AS CustomerEmail,
           CASE {_TYPE_CASES} END AS TicketType,
           {phrase} AS TicketDescription,
           CAST(CAST(ts AS DATE) AS VARCHAR) AS DateOfPurchase
    FROM {source}"""


def _scored_text(source: str) -> str:
    return f"""
    SELECT *,
           CASE WHEN p + n = 0 THEN 0.0::DOUBLE ELSE (p - n)::DOUBLE / (p + n) END AS TicketSentimentScore,
           CASE WHEN p + n8 = 0 THEN 0.0::DOUBLE ELSE (p - n8)::DOUBLE / (p + n8) END AS ShortScore
    FROM (
        SELECT *,
               {_hits('d', c.REFUND_TERMS)} AS Keywords_RefundCount,
               {_hits('d', c.DAMAGE_TERMS)} AS Keywords_DamageCount,
               {_hits('d', c.MISSING_TERMS)} AS Keywords_MissingCount,
               {_hits('d', c.POSITIVE_TERMS)} AS p,
               {_hits('d', c.NEGATIVE_TERMS)} AS n,
               {_hits('d', c.NEGATIVE_TERMS_SHORT)} AS n8
        FROM (SELECT *, coalesce(TicketDescription, '') AS d FROM {source}))"""


def _ticket_stats(key: str, source: str) -> str:
    types = ", ".join(
        f"count(*) FILTER (WHERE TicketType = {_quoted(kind)}) AS {name}" for name, kind in c.TICKET_TYPES.items()
    )
    return f"""
    SELECT {key}, count(TicketID) AS TotalTickets, {types},
           CAST(sum(Keywords_RefundCount) AS BIGINT) AS Tickets_KeywordRefundCount,
           CAST(sum(Keywords_DamageCount) AS BIGINT) AS Tickets_KeywordDamageCount,
           CAST(sum(Keywords_MissingCount) AS BIGINT) AS Tickets_KeywordMissingCount,
           round(avg(TicketSentimentScore), 6) AS AvgTicketSentimentScore,
           min(TicketSentimentScore) AS MinTicketSentimentScore
    FROM {source} GROUP BY {key}"""


def _feature_rows(stats: str, on: str) -> str:
    counts = ", ".join(f"coalesce(t.{name}, 0) AS {name}" for name in c.TICKET_COUNTS)
    scores = ", ".join(f"coalesce(t.{name}, 0.0) AS {name}" for name in c.TICKET_SCORES)
    return f"""
    SELECT s.CustomerID AS Simulated_CustomerID, FirstTransactionDate, LastTransactionDate,
           TotalUniqueOrders, TotalItemsPurchased, TotalItemsReturned, TotalPurchaseValue, TotalRefundValue,
           RefundRate_by_Items, RefundRate_by_Value, AccountAgeDays, {counts}, {scores}
    FROM numbered s LEFT JOIN {stats} t ON {on}"""


# Common table expressions, each with the ones it needs.
_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "retail": ((), """
    SELECT CASE WHEN (ret AND l_orderkey % 29 <> 0) OR l_orderkey % 31 = 0
                THEN 'C' || l_orderkey ELSE CAST(l_orderkey AS VARCHAR) END AS InvoiceNo,
           CAST(CASE WHEN ret THEN -l_quantity ELSE l_quantity END AS INTEGER) AS Quantity,
           CASE WHEN l_orderkey % 41 = 0 THEN 'not a date'
                ELSE substr(CAST(l_shipdate AS VARCHAR), 1, 10) || ' '
                     || lpad(CAST(l_linenumber * 3 AS VARCHAR), 2, '0') || ':15:00' END AS InvoiceDate,
           CAST(p_retailprice AS DECIMAL(12,2)) AS UnitPrice,
           CASE WHEN l_orderkey % 37 = 0 THEN NULL ELSE o_custkey END AS CustomerID
    FROM (SELECT *, CASE WHEN o_custkey % 50 = 3 THEN TRUE WHEN o_custkey % 4 = 0 THEN FALSE
                         ELSE l_returnflag = 'R' AND l_linestatus = 'F' END AS ret
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""),
    "clean": (("retail",), """
    SELECT InvoiceNo, Quantity, TRY_CAST(InvoiceDate AS TIMESTAMP) AS InvoiceDate, UnitPrice, CustomerID,
           InvoiceNo LIKE 'C%' OR Quantity < 0 AS IsReturn,
           CASE WHEN Quantity > 0 THEN Quantity ELSE 0 END AS PurchaseQuantity,
           CASE WHEN Quantity < 0 THEN -Quantity ELSE 0 END AS ReturnQuantity,
           Quantity * UnitPrice AS LineTotal
    FROM retail WHERE CustomerID IS NOT NULL AND TRY_CAST(InvoiceDate AS TIMESTAMP) IS NOT NULL"""),
    "summary": (("clean",), """
    SELECT *,
           CASE WHEN TotalItemsPurchased = 0 THEN 0.0::DOUBLE
                ELSE TotalItemsReturned::DOUBLE / TotalItemsPurchased END AS RefundRate_by_Items,
           CASE WHEN TotalPurchaseValue = 0 THEN 0.0::DOUBLE
                ELSE TotalRefundValue / TotalPurchaseValue END AS RefundRate_by_Value,
           coalesce(date_sub('day', FirstTransactionDate, LastTransactionDate), 0) AS AccountAgeDays
    FROM (SELECT CustomerID, count(DISTINCT InvoiceNo) AS TotalUniqueOrders,
                 CAST(sum(PurchaseQuantity) AS BIGINT) AS TotalItemsPurchased,
                 CAST(sum(ReturnQuantity) AS BIGINT) AS TotalItemsReturned,
                 CAST(sum(CASE WHEN LineTotal > 0 THEN LineTotal ELSE 0 END) AS DOUBLE) AS TotalPurchaseValue,
                 CAST(sum(CASE WHEN LineTotal < 0 THEN -LineTotal ELSE 0 END) AS DOUBLE) AS TotalRefundValue,
                 min(InvoiceDate) AS FirstTransactionDate, max(InvoiceDate) AS LastTransactionDate
          FROM clean GROUP BY CustomerID)"""),
    "numbered": (("summary",), """
    SELECT *, row_number() OVER (ORDER BY CustomerID) - 1 AS slot, count(*) OVER () AS customers FROM summary"""),
    "tickets": ((), _tickets(False)),
    "tickets_long": ((), _tickets(True)),
    "texts": (("tickets",), _scored_text("tickets")),
    "texts_long": (("tickets_long",), _scored_text("tickets_long")),
    "slots": (("texts", "numbered"), """
    SELECT *, ('0x' || substr(md5(CustomerEmail), 1, 15))::BIGINT % (SELECT count(*) FROM numbered) AS slot
    FROM texts WHERE CustomerEmail IS NOT NULL"""),
    "slot_stats": (("slots",), _ticket_stats("slot", "slots")),
    "features": (("numbered", "slot_stats"), _feature_rows("slot_stats", "s.slot = t.slot")),
    "links": ((), """
    SELECT 'user' || c_custkey || '.' || k || '@example.com' AS CustomerEmail, c_custkey AS Simulated_CustomerID
    FROM customer, range(10) AS r(k)"""),
    "linked_texts": (("texts", "links"), "SELECT * FROM texts JOIN links USING (CustomerEmail)"),
    "linked_stats": (("linked_texts",), _ticket_stats("Simulated_CustomerID", "linked_texts")),
    "features_linked": (
        ("numbered", "linked_stats"), _feature_rows("linked_stats", "s.CustomerID = t.Simulated_CustomerID")
    ),
    "labelled": (("features",), """
    SELECT *, CAST(rule_a = 1 OR rule_b = 1 OR rule_c = 1 AS INTEGER) AS is_refund_abuser
    FROM (SELECT *,
                 CAST(RefundRate_by_Items > 0.3 AND Tickets_TypeRefundRequest >= 2 AS INTEGER) AS rule_a,
                 CAST(RefundRate_by_Value > 0.2 AND (Tickets_KeywordMissingCount > 0
                      OR Tickets_KeywordDamageCount > 0) AS INTEGER) AS rule_b,
                 CAST(MinTicketSentimentScore < -0.5 AND TotalItemsReturned > 5 AS INTEGER) AS rule_c
          FROM features)"""),
}


def _score(source: str) -> str:
    return f"""
    SELECT *, CAST(Predicted_Probability > 0.5 AS INTEGER) AS Predicted_Abuser
    FROM (SELECT *, greatest(0.05::DOUBLE, least(0.95::DOUBLE,
                 RefundRate_by_Items * 0.7::DOUBLE + MinTicketSentimentScore * (-0.2)::DOUBLE
                 + Tickets_TypeRefundRequest * 0.1::DOUBLE)) AS Predicted_Probability
          FROM {source})"""


def _classes() -> str:
    lines = []
    for name, hit, alarm, miss in (("0", "n00", "n10", "n01"), ("1", "n11", "n01", "n10")):
        lines.append(f"""
        SELECT '{name}' AS class,
               CASE WHEN {hit} + {alarm} = 0 THEN 0.0::DOUBLE ELSE {hit}::DOUBLE / ({hit} + {alarm}) END AS precision,
               CASE WHEN {hit} + {miss} = 0 THEN 0.0::DOUBLE ELSE {hit}::DOUBLE / ({hit} + {miss}) END AS recall,
               CASE WHEN 2 * {hit} + {alarm} + {miss} = 0 THEN 0.0::DOUBLE
                    ELSE (2 * {hit})::DOUBLE / (2 * {hit} + {alarm} + {miss}) END AS f1_score,
               {hit} + {miss} AS support
        FROM confusion""")
    return " UNION ALL ".join(lines)


def _confusion(rows: str) -> str:
    return f"""
    SELECT count(*) FILTER (WHERE is_refund_abuser = 1 AND Predicted_Abuser = 1) AS n11,
           count(*) FILTER (WHERE is_refund_abuser = 1 AND Predicted_Abuser = 0) AS n10,
           count(*) FILTER (WHERE is_refund_abuser = 0 AND Predicted_Abuser = 1) AS n01,
           count(*) FILTER (WHERE is_refund_abuser = 0 AND Predicted_Abuser = 0) AS n00
    FROM {rows}"""


def _by_score(rows: str) -> str:
    return f"""
    SELECT *, coalesce(sum(zeros) OVER (ORDER BY Predicted_Probability ROWS BETWEEN UNBOUNDED PRECEDING
                                        AND 1 PRECEDING), 0) AS below
    FROM (SELECT Predicted_Probability, count(*) FILTER (WHERE is_refund_abuser = 1) AS ones,
                 count(*) FILTER (WHERE is_refund_abuser = 0) AS zeros
          FROM {rows} GROUP BY Predicted_Probability)"""


def _mean_score(known: str) -> str:
    """Mean clipped score over the background; ``known`` has a letter per feature with the row's own value."""
    parts = [
        f"{'x' if letter in known else 'b'}.{name} * ({weight})::DOUBLE"
        for letter, (name, weight) in zip("ist", c.SCORE_WEIGHTS.items())
    ]
    return f"avg(greatest(0.05::DOUBLE, least(0.95::DOUBLE, {' + '.join(parts)})))"


def _phi(letter: str) -> str:
    """Shapley value of one of three features from the eight mean scores m_<known>."""
    first, second = (other for other in "ist" if other != letter)

    def mean(letters: str) -> str:
        return "m_" + "".join(sorted(letters, key="ist".index))

    return (
        f"(({mean(letter)} - m_) * 2 + ({mean(first + letter)} - {mean(first)})"
        f" + ({mean(second + letter)} - {mean(second)}) + ({mean('ist')} - {mean(first + second)}) * 2) / 6"
    )


_SETS = ("", "i", "s", "t", "is", "it", "st", "ist")
_PHI_LINES = " UNION ALL ".join(
    "SELECT Simulated_CustomerID, '{0}' AS feature, m_ AS base, {1} AS phi FROM means".format(
        name,
        _phi("ist"[list(c.SCORE_WEIGHTS).index(name)]) if name in c.SCORE_WEIGHTS else "0.0::DOUBLE",
    )
    for name in c.FEATURES
)

_CTES |= {
    "scored": (("labelled",), _score("labelled")),
    "scored_linked": (("features_linked",), _score("features_linked")),
    "typed_in": (("features",), """
    SELECT * REPLACE (
        CAST(printf('%.2f', TotalItemsReturned::DOUBLE
             / CASE WHEN TotalItemsPurchased > 0 THEN TotalItemsPurchased ELSE 1 END) AS DOUBLE) AS RefundRate_by_Items,
        CAST(printf('%.2f', TotalRefundValue
             / CASE WHEN TotalPurchaseValue > 0 THEN TotalPurchaseValue ELSE 1 END) AS DOUBLE) AS RefundRate_by_Value)
    FROM features"""),
    "scored_typed_in": (("typed_in",), _score("typed_in")),
    "split": (("scored",), """
    SELECT *, CAST(row_number() OVER (PARTITION BY is_refund_abuser ORDER BY md5('42:' || Simulated_CustomerID))
                   <= round(0.2 * count(*) OVER (PARTITION BY is_refund_abuser)) AS INTEGER) AS is_test
    FROM scored"""),
    "confusion": (("split",), _confusion("split WHERE is_test = 1")),
    "classes": (("confusion",), _classes()),
    "by_score": (("scored",), _by_score("scored")),
    "background": (("scored",), """
    SELECT * FROM scored ORDER BY md5('42:' || Simulated_CustomerID), Simulated_CustomerID LIMIT 100"""),
    "means": (("background",), "SELECT x.Simulated_CustomerID, " + ", ".join(
        f"{_mean_score(known)} AS m_{known}" for known in _SETS
    ) + " FROM scored x, background b GROUP BY x.Simulated_CustomerID"),
    "phi": (("means",), _PHI_LINES),
}


def _needed(names: tuple[str, ...], seen: dict[str, None]) -> dict[str, None]:
    for name in names:
        _needed(_CTES[name][0], seen)
        seen[name] = None
    return seen


def _sql(names: str | tuple[str, ...], select: str) -> str:
    names = (names,) if isinstance(names, str) else names
    ctes = ", ".join(f"{name} AS ({_CTES[name][1]})" for name in _needed(names, {}))
    return f"WITH {ctes} {select}" if ctes else select


def _tree_sql(select: str) -> str:
    """``select`` on the tables of :mod:`oracle_trees`; each is computed once."""
    shared = [f"{name} AS ({_CTES[name][1]})" for name in _needed(("split",), {})]
    steps = [f"{name} AS MATERIALIZED ({text})" for name, text in tree_ctes().items()]
    return f"WITH {', '.join(shared + steps)} {select}"


def _whole_tree_sql(select: str) -> str:
    shared = [f"{name} AS ({_CTES[name][1]})" for name in _needed(("split",), {})]
    steps = [
        f"grown USING KEY (id) AS ({text})" if name == "grown" else f"{name} AS MATERIALIZED ({text})"
        for name, text in whole_ctes().items()
    ]
    return f"WITH RECURSIVE {', '.join(shared + steps)} {select}"


def _report(rows: str) -> str:
    """The classification report of the table ``rows``."""
    tables = f"confusion AS ({_confusion(rows)}), classes AS ({_classes()})"
    return f"SELECT * FROM (WITH {tables} {_REPORT})"


def _auc(rows: str) -> str:
    return f"SELECT * FROM (WITH by_score AS ({_by_score(rows)}) {_AUC})"


_FEATURE_COLUMNS = (
    "Simulated_CustomerID, CAST(FirstTransactionDate AS VARCHAR) AS FirstTransactionDate, "
    "CAST(LastTransactionDate AS VARCHAR) AS LastTransactionDate, " + ", ".join(c.FEATURES)
)
_KEYWORDS = "Keywords_RefundCount, Keywords_DamageCount, Keywords_MissingCount"
_LIKELIHOOD = (
    f"CASE WHEN rule_a + rule_b + rule_c > 0 THEN ['reasons', ''] "
    f"WHEN Predicted_Probability > 0.6 THEN ['likely', {_quoted(c.LIKELY_TEXT)}] "
    f"WHEN Predicted_Probability < 0.4 THEN ['unlikely', {_quoted(c.UNLIKELY_TEXT)}] "
    f"ELSE ['neutral', {_quoted(c.NEUTRAL_TEXT)}] END"
)
_ANY_FACTOR = " OR ".join(_CONDITIONS[name] for name, _ in c.FACTOR_REASONS_FORM)
_PREDICTION = (
    f"CASE WHEN Predicted_Abuser = 1 AND ({_ANY_FACTOR}) "
    f"THEN ['flagged_with_reasons', {_filled(c.FLAGGED_WITH_REASONS_TEXT)}] "
    f"WHEN Predicted_Abuser = 1 THEN ['flagged_no_reasons', {_filled(c.FLAGGED_NO_REASONS_TEXT)}] "
    f"WHEN NOT ({_ANY_FACTOR}) THEN ['clear_no_reasons', {_filled(c.CLEAR_NO_REASONS_TEXT)}] "
    f"ELSE ['clear_with_reasons', {_filled(c.CLEAR_WITH_REASONS_TEXT)}] END"
)

_CELLS = " UNION ALL ".join(
    f"SELECT Simulated_CustomerID, '{name}' AS feature, {name}::DOUBLE AS x FROM scored" for name in c.FEATURES
)
# The values at nine ranks of each feature.
_LIMITS = f"""
SELECT DISTINCT feature, k, x
FROM (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) AS place, count(*) OVER (PARTITION BY feature) AS n
      FROM ({_CELLS})), (SELECT unnest(range(1, 10)) AS k)
WHERE place = greatest(1, ceil((k / 10)::DOUBLE * n))"""
_REPORT = """SELECT * FROM classes
           UNION ALL
           SELECT 'accuracy', a, a, a, total
           FROM (SELECT (n11 + n00)::DOUBLE / (n11 + n10 + n01 + n00) AS a, n11 + n10 + n01 + n00 AS total FROM confusion)
           UNION ALL
           SELECT 'macro avg', (z.precision + o.precision) / 2, (z.recall + o.recall) / 2,
                  (z.f1_score + o.f1_score) / 2, z.support + o.support
           FROM classes z, classes o WHERE z.class = '0' AND o.class = '1'
           UNION ALL
           SELECT 'weighted avg',
                  (z.precision * z.support + o.precision * o.support) / (z.support + o.support),
                  (z.recall * z.support + o.recall * o.support) / (z.support + o.support),
                  (z.f1_score * z.support + o.f1_score * o.support) / (z.support + o.support),
                  z.support + o.support
           FROM classes z, classes o WHERE z.class = '0' AND o.class = '1'"""
_AUC = (
    "SELECT CAST(sum(ones * (2 * below + zeros)) AS DOUBLE) / (sum(ones)::DOUBLE * sum(zeros)::DOUBLE * 2) "
    "AS roc_auc, CAST(sum(ones) AS BIGINT) AS ones, CAST(sum(zeros) AS BIGINT) AS zeros FROM by_score"
)

ORACLE_SQL: dict[str, str] = {
    "scan_retail": _sql(
        "retail",
        "SELECT InvoiceNo, Quantity, InvoiceDate, CAST(UnitPrice AS DOUBLE) AS UnitPrice, "
        "CAST(CustomerID AS VARCHAR) AS CustomerID FROM retail",
    ),
    "scan_tickets": _sql("tickets", "SELECT * FROM tickets"),
    "scan_tickets_split": _sql("tickets_long", "SELECT * FROM tickets_long"),
    "retail_clean": _sql(
        "clean",
        "SELECT InvoiceNo, Quantity, CAST(InvoiceDate AS VARCHAR) AS InvoiceDate, "
        "CAST(UnitPrice AS DOUBLE) AS UnitPrice, CustomerID FROM clean",
    ),
    "retail_flags": _sql(
        "clean",
        "SELECT InvoiceNo, CustomerID, CAST(IsReturn AS INTEGER) AS IsReturn, PurchaseQuantity, ReturnQuantity, "
        "CAST(LineTotal AS DOUBLE) AS LineTotal FROM clean",
    ),
    "date_parse_variants": """
    SELECT *, CAST(try_strptime(text, '%m/%d/%Y %H:%M') AS VARCHAR) AS month_first,
           CAST(try_strptime(text, '%d/%m/%Y %H:%M') AS VARCHAR) AS day_first,
           CAST(CASE WHEN text <> 'not a date' THEN strptime(text, '%m/%d/%Y %H:%M') END AS VARCHAR) AS strict
    FROM (SELECT l_orderkey, l_linenumber,
                 CASE WHEN l_orderkey % 41 = 0 THEN 'not a date'
                      ELSE strftime(l_shipdate, '%-m/%-d/%Y %-H:%M') END AS text
          FROM lineitem)""",
    "dq_dropped": _sql(
        "retail",
        "SELECT count(*) AS rows_read, count(*) FILTER (WHERE CustomerID IS NULL) AS missing_customer, "
        "count(*) FILTER (WHERE CustomerID IS NOT NULL AND TRY_CAST(InvoiceDate AS TIMESTAMP) IS NULL) AS bad_date "
        "FROM retail",
    ),
    "dq_shape": _sql(
        "features",
        'SELECT count(*) AS "rows", CAST(20 AS BIGINT) AS "columns", CAST(17 AS BIGINT) AS features FROM features',
    ),
    "sanitize": _sql(
        "summary",
        """SELECT CustomerID,
                  CASE WHEN TotalItemsPurchased > 0 THEN TotalItemsReturned::DOUBLE / TotalItemsPurchased
                       ELSE 0.0 END AS rate,
                  CASE WHEN TotalItemsPurchased = 0 OR TotalItemsReturned = 0 OR TotalUniqueOrders = 1 THEN 0.0
                       ELSE TotalItemsReturned::DOUBLE / TotalItemsPurchased END AS broken_rate
           FROM summary""",
    ),
    "retail_summary": _sql(
        "summary",
        "SELECT CustomerID, TotalUniqueOrders, TotalItemsPurchased, TotalItemsReturned, TotalPurchaseValue, "
        "TotalRefundValue, CAST(FirstTransactionDate AS VARCHAR) AS FirstTransactionDate, "
        "CAST(LastTransactionDate AS VARCHAR) AS LastTransactionDate FROM summary",
    ),
    "derived_rates": _sql("summary", "SELECT CustomerID, RefundRate_by_Items, RefundRate_by_Value FROM summary"),
    "account_age": _sql("summary", "SELECT CustomerID, AccountAgeDays FROM summary"),
    "keyword_counts": _sql("texts", f"SELECT TicketID, {_KEYWORDS} FROM texts"),
    "ticket_sentiment": _sql(
        "texts", "SELECT TicketID, TicketSentimentScore AS score, ShortScore AS score_short FROM texts"
    ),
    "keyword_counts_long_text": _sql(
        "texts_long",
        f"SELECT TicketID, length(d) AS characters, {_KEYWORDS}, TicketSentimentScore FROM texts_long",
    ),
    "link_map": _sql(
        "slots",
        "SELECT DISTINCT CustomerEmail, CustomerID AS Simulated_CustomerID "
        "FROM slots JOIN numbered ON slots.slot = numbered.slot",
    ),
    "link_tickets": _sql("linked_texts", "SELECT TicketID, CustomerEmail, Simulated_CustomerID FROM linked_texts"),
    "link_tickets_all": _sql(
        ("texts", "links"),
        "SELECT TicketID, CustomerEmail, CAST(Simulated_CustomerID AS VARCHAR) AS Simulated_CustomerID "
        "FROM texts LEFT JOIN links USING (CustomerEmail)",
    ),
    "ticket_summary": _sql("linked_stats", "SELECT * FROM linked_stats"),
    "features": _sql("features", f"SELECT {_FEATURE_COLUMNS} FROM features"),
    "features_linked": _sql("features_linked", f"SELECT {_FEATURE_COLUMNS} FROM features_linked"),
    "features_incremental": _sql("features_linked", f"SELECT {_FEATURE_COLUMNS} FROM features_linked"),
    "abuse_label": _sql(
        "labelled", "SELECT Simulated_CustomerID, rule_a, rule_b, rule_c, is_refund_abuser FROM labelled"
    ),
    "label_totals": _sql(
        "labelled",
        "SELECT count(*) AS total_customers, CAST(sum(is_refund_abuser) AS BIGINT) AS abusers, "
        "CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE sum(is_refund_abuser)::DOUBLE / count(*) * 100 END AS percent "
        "FROM labelled",
    ),
    "label_dist": _sql(
        "labelled",
        "SELECT is_refund_abuser, count(*) AS customers, "
        "count(*)::DOUBLE / (SELECT count(*) FROM labelled) AS share FROM labelled GROUP BY 1 ORDER BY 2 DESC, 1",
    ),
    "flagged_top": _sql(
        "labelled",
        "SELECT Simulated_CustomerID, TotalItemsPurchased, TotalItemsReturned, RefundRate_by_Items, "
        "RefundRate_by_Value, TotalTickets, Tickets_TypeRefundRequest, Tickets_KeywordMissingCount, "
        "AvgTicketSentimentScore, is_refund_abuser FROM labelled WHERE is_refund_abuser = 1 "
        "ORDER BY Simulated_CustomerID LIMIT 10",
    ),
    "scored": _sql(
        "scored",
        "SELECT Simulated_CustomerID, is_refund_abuser, Predicted_Probability, Predicted_Abuser FROM scored",
    ),
    "score_new": _sql(
        "scored_linked", "SELECT Simulated_CustomerID, Predicted_Probability, Predicted_Abuser FROM scored_linked"
    ),
    "flag_threshold": _sql(
        "scored",
        "SELECT Simulated_CustomerID, Predicted_Probability, "
        "CAST(Predicted_Probability > 0.7 AS INTEGER) AS flagged FROM scored",
    ),
    "manual_score": _sql(
        "scored_typed_in",
        "SELECT Simulated_CustomerID, RefundRate_by_Items, RefundRate_by_Value, Predicted_Probability, "
        "Predicted_Abuser FROM scored_typed_in",
    ),
    "reasons_rules": _sql(
        "labelled",
        f"SELECT Simulated_CustomerID, {_reasons(c.RULE_REASONS_BATCH)} AS reasons, "
        f"{_reasons(c.RULE_REASONS_FORM)} AS reasons_form FROM labelled WHERE is_refund_abuser = 1",
    ),
    "reasons_factors": _sql(
        "scored",
        f"SELECT Simulated_CustomerID, Predicted_Probability, {_reasons(c.FACTOR_REASONS_BATCH)} AS reasons "
        "FROM scored WHERE Predicted_Abuser = 1",
    ),
    "reasons_factors7": _sql(
        "scored", f"SELECT Simulated_CustomerID, {_reasons(c.FACTOR_REASONS_FORM)} AS reasons FROM scored"
    ),
    "verdict": _sql(
        "scored",
        f"""SELECT Simulated_CustomerID,
                   CASE WHEN Predicted_Abuser = 1 THEN 'FLAGGED' ELSE 'NOT FLAGGED' END AS verdict,
                   l[1] AS category_likelihood, l[2] AS text_likelihood,
                   p[1] AS category_prediction, p[2] AS text_prediction
            FROM (SELECT *, {_LIKELIHOOD} AS l, {_PREDICTION} AS p FROM scored)""",
    ),
    "score_stored": _sql(
        "scored_linked", "SELECT Simulated_CustomerID, Predicted_Probability, Predicted_Abuser FROM scored_linked"
    ),
    "tickets_typed": _sql(
        "tickets",
        "SELECT TicketID, coalesce(TicketDescription, '') AS TicketDescription, "
        "CASE WHEN TicketID % 41 <> 0 THEN DateOfPurchase END AS DateOfPurchase FROM tickets",
    ),
    "dq_purchase_dates": _sql(
        "tickets", "SELECT count(*) AS tickets, count(*) FILTER (TicketID % 41 = 0) AS bad_purchase_date FROM tickets"
    ),
    "gbt_facts": _sql(
        "split",
        "SELECT Simulated_CustomerID, 1 AS in_range, 1 AS class_agrees, 1 AS loaded_agrees, 1 AS adds_up "
        "FROM split WHERE is_test",
    ),
    "stratified_split": _sql("split", "SELECT Simulated_CustomerID, is_refund_abuser, is_test FROM split"),
    "class_report": _sql(
        ("confusion", "classes"),
        _REPORT,
    ),
    "roc_auc": _sql("by_score", _AUC),
    "linear_shapley": _sql(
        "phi",
        "SELECT Simulated_CustomerID, feature, round(base, 8) + 0.0 AS base, round(phi, 8) + 0.0 AS phi FROM phi",
    ),
    "shapley_global": _sql(
        "phi", "SELECT feature, round(avg(abs(phi)), 8) + 0.0 AS importance FROM phi GROUP BY feature"
    ),
    "shapley_one": _sql(
        "phi",
        "SELECT Simulated_CustomerID, feature, round(base, 8) + 0.0 AS base, round(phi, 8) + 0.0 AS phi FROM phi "
        "WHERE Simulated_CustomerID = (SELECT min(Simulated_CustomerID) FROM scored WHERE Predicted_Abuser = 1)",
    ),
    "shapley_summary": _sql("phi", f"""
        SELECT feature, CAST(rank_bin AS INTEGER) AS rank_bin, CAST(floor(round(phi, 8) / 0.05::DOUBLE) AS INTEGER) AS phi_bin,
               count(*) AS customers
        FROM (SELECT Simulated_CustomerID, feature, (SELECT count(*) FROM limits l WHERE l.feature = v.feature AND l.x < v.x) AS rank_bin
              FROM cells v) JOIN phi USING (Simulated_CustomerID, feature)
        GROUP BY ALL""".replace("FROM cells v", f"FROM ({_CELLS}) v").replace("FROM limits l", f"FROM ({_LIMITS}) l")),
    "sampled_facts": _sql(
        "scored", "SELECT Simulated_CustomerID, 1 AS same_base, 1 AS near_exact, 1 AS errors_small, 1 AS others_zero FROM scored"
    ),
    "gbt_scored": _whole_tree_sql(
        "SELECT Simulated_CustomerID, is_refund_abuser, round(Predicted_Probability, 8) AS Predicted_Probability, "
        "Predicted_Abuser FROM tested"
    ),
    "gbt_report": _tree_sql(_report("tested")),
    "gbt_auc": _tree_sql(_auc("tested")),
    "gbt_shapley": _tree_sql(
        f"SELECT id AS Simulated_CustomerID, {FEATURE_NAMES} AS feature, value, round(base, 8) + 0.0 AS base, "
        "round(phi, 8) + 0.0 AS phi FROM tree_phi"
    ),
    "gbt_shapley_global": _tree_sql(
        f"SELECT {FEATURE_NAMES} AS feature, round(avg(abs(phi)), 8) + 0.0 AS importance FROM tree_phi GROUP BY feature"
    ),
}
