"""The registered queries: (spark, folder of the test tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returns_risk import constants as c
from returns_risk.operators import boosting, clean, evaluate, features, link, rules, scoring, shapley
from returns_risk.operators.sampled_shapley import sampled_shapley
from returns_risk.operators.state import add_batch, state_features
from returns_risk.operators.text_features import score_text
from returns_risk.operators.tree_patterns import explain_trees
from returns_risk.operators.tree_shapley import tree_shapley
from returns_risk.plans.compose import build_features, numbered_summary, score_new as score_new_tables
from returns_risk.sources import csv, tables
from returns_risk.sources.store import new_path, write_once

COUNTS = list(c.KEYWORD_LISTS)
#: Bytes of one written file of long tickets, about: one task writes it, several read it.
TICKET_FILE = 1 << 28


# --- inputs and shared steps ------------------------------------------------------------------

def _retail(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_retail(tables.retail_lines(spark, folder))


def _tickets(spark: SparkSession, folder: str, long_text: bool = False) -> DataFrame:
    return clean.clean_tickets(tables.support_tickets(spark, folder, long_text))


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return build_features(tables.retail_lines(spark, folder), tables.support_tickets(spark, folder))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return rules.abuse_label(_features(spark, folder))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.linear_score(_labelled(spark, folder))


def _stored_scores(spark: SparkSession, folder: str) -> DataFrame:
    return write_once(_scored(spark, folder), "scored")


def _text_dates(df: DataFrame) -> DataFrame:
    return df.withColumns({name: F.expr(f"string({name})") for name in c.DATES})


def _mean_to_six(df: DataFrame) -> DataFrame:
    return df.withColumn("AvgTicketSentimentScore", F.expr("round(AvgTicketSentimentScore, 6)"))


def _lines(name: str) -> str:
    return f"concat_ws('\\n', {name}) AS {name}"


# --- scans ------------------------------------------------------------------------------------

def scan_retail(spark: SparkSession, folder: str) -> DataFrame:
    """Invoice lines written as CSV files in ISO-8859-1 and read back."""
    path = new_path(spark, "retail_csv")
    lines = tables.retail_lines(spark, folder)
    lines.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return csv.read_retail(spark, path).selectExpr(
        "InvoiceNo", "Quantity", "InvoiceDate", "double(UnitPrice) AS UnitPrice", "string(CustomerID) AS CustomerID"
    )


def scan_tickets(spark: SparkSession, folder: str) -> DataFrame:
    """Tickets written as UTF-8 CSV files under their original headers and read back."""
    path = new_path(spark, "tickets_csv")
    renamed = tables.support_tickets(spark, folder).withColumnsRenamed(
        {new: old for old, new in c.TICKET_COLUMNS.items()}
    )
    renamed.write.option("header", True).option("escape", '"').csv(path)
    return csv.read_tickets(spark, path)


def scan_tickets_split(spark: SparkSession, folder: str) -> DataFrame:
    """Tickets with whole documents, line breaks and quotes included, as CSV files that many tasks may read each.

    Up to ``TICKET_FILE`` bytes they are one file. More make more files, so that no task writes more than about that.
    """
    path = new_path(spark, "tickets_long_csv")
    renamed = tables.support_tickets(spark, folder, long_text=True).withColumnsRenamed(
        {new: old for old, new in c.TICKET_COLUMNS.items()}
    )
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    files = 1 + tables.long_ticket_bytes(spark, folder) // TICKET_FILE
    renamed.coalesce(files).write.options(**options).csv(path)
    return csv.read_tickets(spark, path, split=True)


# --- cleaning ---------------------------------------------------------------------------------

def retail_clean(spark: SparkSession, folder: str) -> DataFrame:
    return _retail(spark, folder).selectExpr(
        "InvoiceNo", "Quantity", "string(InvoiceDate) AS InvoiceDate", "double(UnitPrice) AS UnitPrice", "CustomerID"
    )


def retail_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _retail(spark, folder).selectExpr(
        "InvoiceNo", "CustomerID", "int(IsReturn) AS IsReturn", "PurchaseQuantity", "ReturnQuantity",
        "double(LineTotal) AS LineTotal",
    )


def date_parse_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Ship dates as slash text, read month first, day first (rows kept), and strictly."""
    slashed = tables.table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber",
        "if(l_orderkey % 41 = 0, 'not a date', date_format(l_shipdate, 'M/d/yyyy H:mm')) AS text",
        "if(l_orderkey % 41 = 0, NULL, date_format(l_shipdate, 'M/d/yyyy H:mm')) AS good_text",
    )
    return slashed.selectExpr(
        "l_orderkey", "l_linenumber", "text",
        f"string({clean.parse_date('text', c.MONTH_FIRST)}) AS month_first",
        f"string({clean.parse_date('text', c.DAY_FIRST)}) AS day_first",
        f"string({clean.parse_date_strict('good_text', c.MONTH_FIRST)}) AS strict",
    )


def dq_dropped(spark: SparkSession, folder: str) -> DataFrame:
    return clean.dropped_rows(tables.retail_lines(spark, folder))


def dq_shape(spark: SparkSession, folder: str) -> DataFrame:
    frame = _features(spark, folder)
    return frame.selectExpr(
        "count(1) AS rows", f"bigint({len(frame.columns)}) AS columns", f"bigint({len(c.FEATURES)}) AS features"
    )


def sanitize(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rates, with null, infinite and NaN values among them, made fit for a model."""
    rates = features.retail_summary(_retail(spark, folder)).selectExpr(
        "CustomerID",
        "try_divide(double(TotalItemsReturned), TotalItemsPurchased) AS rate",
        """CASE WHEN TotalItemsPurchased = 0 THEN double('inf')
                WHEN TotalItemsReturned = 0 THEN double('nan')
                WHEN TotalUniqueOrders = 1 THEN double('-inf')
                ELSE double(TotalItemsReturned) / TotalItemsPurchased END AS broken_rate""",
    )
    return features.sanitize(rates, ("rate", "broken_rate"))


# --- customer summaries -----------------------------------------------------------------------

def retail_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = features.retail_summary(_retail(spark, folder))
    return _text_dates(summary).drop("RefundRate_by_Items", "RefundRate_by_Value", "AccountAgeDays")


def derived_rates(spark: SparkSession, folder: str) -> DataFrame:
    return features.retail_summary(_retail(spark, folder)).select(
        "CustomerID", "RefundRate_by_Items", "RefundRate_by_Value"
    )


def account_age(spark: SparkSession, folder: str) -> DataFrame:
    return features.retail_summary(_retail(spark, folder)).select("CustomerID", "AccountAgeDays")


# --- ticket text ------------------------------------------------------------------------------

def keyword_counts(spark: SparkSession, folder: str) -> DataFrame:
    return score_text(_tickets(spark, folder)).select("TicketID", *COUNTS)


def ticket_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    """Sentiment with the full and with the short list of negative terms."""
    full = score_text(_tickets(spark, folder))
    return full.withColumnRenamed("TicketSentimentScore", "score").transform(
        score_text, keyword_lists={}, negative=c.NEGATIVE_TERMS_SHORT, score="score_short"
    ).select("TicketID", "score", "score_short")


def keyword_counts_long_text(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword counts and sentiment of tickets that carry a whole document each."""
    return score_text(_tickets(spark, folder, long_text=True)).selectExpr(
        "TicketID", "bigint(length(TicketDescription)) AS characters", *COUNTS, "TicketSentimentScore"
    )


def tickets_typed(spark: SparkSession, folder: str) -> DataFrame:
    """Every ticket with its purchase date as a date; every 41st cannot be read and is null."""
    raw = tables.support_tickets(spark, folder).withColumn(
        "DateOfPurchase", F.expr("if(TicketID % 41 = 0, 'not a date', DateOfPurchase)")
    )
    return clean.clean_tickets(raw, on_bad_date="keep").selectExpr(
        "TicketID", "TicketDescription", "string(DateOfPurchase) AS DateOfPurchase"
    )


def dq_purchase_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Tickets, and how many have a purchase date that cannot be read."""
    raw = tables.support_tickets(spark, folder).withColumn(
        "DateOfPurchase", F.expr("if(TicketID % 41 = 0, 'not a date', DateOfPurchase)")
    )
    return clean.unreadable_dates(raw)


# --- linking ----------------------------------------------------------------------------------

def link_map(spark: SparkSession, folder: str) -> DataFrame:
    """The simulated customer of every distinct address."""
    numbered, customers = numbered_summary(_retail(spark, folder))
    return link.simulated_links(tables.support_tickets(spark, folder), numbered, customers)


def link_tickets(spark: SparkSession, folder: str) -> DataFrame:
    """Every ticket whose address is in the link table, with its customer."""
    return link.link_tickets(_tickets(spark, folder), tables.account_links(spark, folder)).select(
        "TicketID", "CustomerEmail", c.CUSTOMER
    )


def link_tickets_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every ticket, with its customer where the link table has one."""
    return link.link_tickets(_tickets(spark, folder), tables.account_links(spark, folder), "left").selectExpr(
        "TicketID", "CustomerEmail", f"string({c.CUSTOMER}) AS {c.CUSTOMER}"
    )


def ticket_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Ticket aggregates per customer of the link table."""
    summary = features.ticket_summary(
        score_text(_tickets(spark, folder)), tables.account_links(spark, folder)
    )
    return _mean_to_six(summary)


# --- feature rows -----------------------------------------------------------------------------

def feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _mean_to_six(_text_dates(_features(spark, folder)))


def feature_rows_linked(spark: SparkSession, folder: str) -> DataFrame:
    linked = build_features(
        tables.retail_lines(spark, folder), tables.support_tickets(spark, folder),
        tables.account_links(spark, folder),
    )
    return _mean_to_six(_text_dates(linked))


def features_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Feature rows from a stored state that two batches were added to, the second of them twice."""
    state, retail, tickets = new_path(spark, "state"), tables.retail_lines(spark, folder), tables.support_tickets(spark, folder)
    for name, rest in (("first", 0), ("second", 1), ("second", 1)):
        later = f"% 2 = {rest}"
        add_batch(state, name, retail.where(f"crc32(binary(InvoiceNo)) {later}"), tickets.where(f"TicketID {later}"))
    return _mean_to_six(_text_dates(state_features(spark, state, tables.account_links(spark, folder))))


# --- label, score, flags ----------------------------------------------------------------------

def abuse_label(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder).selectExpr(
        c.CUSTOMER, *[f"int({rule}) AS {rule}" for rule in rules.RULES], c.LABEL
    )


def label_totals(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.label_totals(_labelled(spark, folder))


def label_dist(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.label_distribution(_labelled(spark, folder))


def flagged_top(spark: SparkSession, folder: str) -> DataFrame:
    """Display columns of the first ten customers that the rules flag."""
    shown = (
        c.CUSTOMER, "TotalItemsPurchased", "TotalItemsReturned", "RefundRate_by_Items",
        "RefundRate_by_Value", "TotalTickets", "Tickets_TypeRefundRequest",
        "Tickets_KeywordMissingCount", "AvgTicketSentimentScore", c.LABEL,
    )
    return _mean_to_six(rules.first_customers(rules.flagged(_labelled(spark, folder)), 10, shown))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select(c.CUSTOMER, c.LABEL, c.PROBABILITY, c.PREDICTION)


def score_new(spark: SparkSession, folder: str) -> DataFrame:
    """Raw tables with a given link table to scores, as for new data."""
    return score_new_tables(
        tables.retail_lines(spark, folder), tables.support_tickets(spark, folder),
        tables.account_links(spark, folder),
    ).select(c.CUSTOMER, c.PROBABILITY, c.PREDICTION)


def score_stored(spark: SparkSession, folder: str) -> DataFrame:
    """As ``score_new``, by weights that were saved and loaded."""
    path = new_path(spark, "weights")
    scoring.save_linear(spark, path)
    return score_new_tables(
        tables.retail_lines(spark, folder), tables.support_tickets(spark, folder),
        tables.account_links(spark, folder), scoring.load_linear(spark, path),
    ).select(c.CUSTOMER, c.PROBABILITY, c.PREDICTION)


def flag_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.flag_accounts(_scored(spark, folder)).selectExpr(
        c.CUSTOMER, c.PROBABILITY, "int(flagged) AS flagged"
    )


def manual_score(spark: SparkSession, folder: str) -> DataFrame:
    """Scores with the refund rates recomputed as for typed-in rows."""
    return scoring.score_features(scoring.typed_in_rates(_features(spark, folder))).select(
        c.CUSTOMER, "RefundRate_by_Items", "RefundRate_by_Value", c.PROBABILITY, c.PREDICTION
    )


# --- reasons ----------------------------------------------------------------------------------

def reasons_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rule reasons of flagged customers, in both wordings."""
    flagged = rules.flagged(_labelled(spark, folder))
    both = rules.reasons_rules(rules.reasons_rules(flagged), c.RULE_REASONS_FORM, "reasons_form")
    return both.selectExpr(c.CUSTOMER, _lines("reasons"), _lines("reasons_form"))


def reasons_factors(spark: SparkSession, folder: str) -> DataFrame:
    flagged = rules.flagged(_scored(spark, folder), c.PREDICTION)
    return rules.reasons_factors(flagged).selectExpr(c.CUSTOMER, c.PROBABILITY, _lines("reasons"))


def reasons_factors7(spark: SparkSession, folder: str) -> DataFrame:
    return rules.reasons_factors7(_scored(spark, folder)).selectExpr(c.CUSTOMER, _lines("reasons"))


def verdict(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict and explanation category of every customer, in the two single-customer styles."""
    frame = rules.reasons_factors7(rules.reasons_rules(_scored(spark, folder), c.RULE_REASONS_FORM, "by_rule"), "by_factor")
    likelihood = rules.verdict(frame, "likelihood", "by_rule").withColumnsRenamed(
        {"category": "category_likelihood", "explanation": "text_likelihood"}
    )
    return rules.verdict(likelihood.drop("verdict"), "prediction", "by_factor").selectExpr(
        c.CUSTOMER, "verdict", "category_likelihood", "text_likelihood",
        "category AS category_prediction", "explanation AS text_prediction",
    )


# --- split and evaluation ---------------------------------------------------------------------

def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    split = evaluate.stratified_split(_stored_scores(spark, folder))
    return split.selectExpr(c.CUSTOMER, c.LABEL, "int(is_test) AS is_test")


def class_report(spark: SparkSession, folder: str) -> DataFrame:
    """Linear class against rule label, on the test rows of the split."""
    split = evaluate.stratified_split(_stored_scores(spark, folder))
    return evaluate.classification_report(split.where("is_test"))


def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.roc_auc(_scored(spark, folder))


# --- attribution ------------------------------------------------------------------------------

def _explained(spark: SparkSession, folder: str) -> DataFrame:
    frame = _stored_scores(spark, folder)
    return shapley.linear_shapley(frame, shapley.background_sample(frame))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Eight decimals, so that the order of summation does not show; -0.0 becomes 0.0."""
    return df.withColumns({name: F.expr(f"round({name}, 8) + 0D") for name in columns})


def linear_shapley(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(shapley.by_feature(_explained(spark, folder)).drop("value"), "base", "phi")


def shapley_global(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(shapley.global_importance(_explained(spark, folder)), "importance")


def shapley_one(spark: SparkSession, folder: str) -> DataFrame:
    """Base value and contributions of the first customer that the score flags."""
    frame = _stored_scores(spark, folder)
    first = rules.first_customers(rules.flagged(frame, c.PREDICTION), 1)
    explained = shapley.linear_shapley(first, shapley.background_sample(frame))
    return _rounded(shapley.by_feature(explained).drop("value"), "base", "phi")


def shapley_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Customers by feature, tenth of the feature's value and bin of the attribution."""
    return shapley.attribution_summary(_explained(spark, folder))


def sampled_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold for the sampled attribution of every customer: close to the exact one, within its own errors.

    The scorer is the linear one, passed as a function; a customer draws until its errors are at most 0.02.
    """
    frame = _stored_scores(spark, folder)
    background = write_once(shapley.background_sample(frame), "background")
    sampled = sampled_shapley(frame, background, scoring.linear_score, tuple(c.SCORE_WEIGHTS), error=0.02)
    exact = shapley.linear_shapley(frame, background).selectExpr(c.CUSTOMER, "base AS exact_base", "phi AS exact")
    places = ", ".join(str(c.FEATURES.index(name)) for name in c.SCORE_WEIGHTS)
    near = "abs(phi[k] - exact[k]) <= 6 * phi_error[k] + 0.02"
    return sampled.join(exact, c.CUSTOMER).selectExpr(
        c.CUSTOMER, "int(abs(base - exact_base) < 1e-9) AS same_base",
        f"int(forall(array({places}), k -> {near})) AS near_exact",
        "int(forall(phi_error, e -> e <= 0.02) OR pairs = 512) AS errors_small",
        "int(size(filter(phi, v -> v <> 0)) <= 3) AS others_zero",
    )


# --- boosted trees ----------------------------------------------------------------------------

def _split(spark: SparkSession, folder: str) -> DataFrame:
    split = write_once(evaluate.stratified_split(_mean_to_six(_stored_scores(spark, folder))), "split")
    return split.drop(c.PROBABILITY, c.PREDICTION)


def _boosted(spark: SparkSession, folder: str, **size: int) -> tuple[DataFrame, DataFrame]:
    """The test rows, and a model trained on the others, saved and loaded; without a size as many trees as by default."""
    split = _split(spark, folder)
    model = boosting.train_trees(split.where("NOT is_test"), **size)
    path = new_path(spark, "model")
    boosting.save_trees(model, path)
    return split.where("is_test"), boosting.load_trees(spark, path)


def _few_trees(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return _boosted(spark, folder, rounds=c.TREE_ROUNDS, leaves=c.TREE_LEAVES)


def _tested(spark: SparkSession, folder: str) -> DataFrame:
    return boosting.score_trees(*_few_trees(spark, folder))


def gbt_scored(spark: SparkSession, folder: str) -> DataFrame:
    """Probability and class of the test rows, by 100 trees of 31 leaves."""
    return _rounded(boosting.score_trees(*_boosted(spark, folder)), c.PROBABILITY).select(
        c.CUSTOMER, c.LABEL, c.PROBABILITY, c.PREDICTION
    )


def gbt_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold for every test customer, whatever trees Spark's own classifier has trained."""
    split = _split(spark, folder)
    model = scoring.train_gbt(split.where("NOT is_test"))
    path = new_path(spark, "model")
    scoring.save_model(model, path)
    explained = tree_shapley(scoring.score_gbt(split.where("is_test"), model), model)
    again = scoring.score_gbt(split.where("is_test"), scoring.load_model(path)).selectExpr(
        c.CUSTOMER, f"{c.PROBABILITY} AS _again"
    )
    log_odds = f"ln({c.PROBABILITY} / (1 - {c.PROBABILITY}))"
    return explained.join(again, c.CUSTOMER).selectExpr(
        c.CUSTOMER,
        f"int({c.PROBABILITY} > 0 AND {c.PROBABILITY} < 1) AS in_range",
        f"int({c.PREDICTION} = int({c.PROBABILITY} > 0.5)) AS class_agrees",
        f"int(abs({c.PROBABILITY} - _again) < 1e-12) AS loaded_agrees",
        f"int(abs(base + aggregate(phi, 0D, (s, v) -> s + v) - {log_odds}) < 1e-6) AS adds_up",
    )


def gbt_report(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.classification_report(_tested(spark, folder))


def gbt_auc(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.roc_auc(_tested(spark, folder))


def gbt_shapley(spark: SparkSession, folder: str) -> DataFrame:
    """Attribution of the trees, in log-odds, per test customer and feature."""
    return _rounded(shapley.by_feature(explain_trees(*_few_trees(spark, folder))), "base", "phi")


def gbt_shapley_global(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(shapley.global_importance(explain_trees(*_few_trees(spark, folder))), "importance")


QUERIES = {
    "scan_retail": scan_retail,
    "scan_tickets": scan_tickets,
    "scan_tickets_split": scan_tickets_split,
    "retail_clean": retail_clean,
    "retail_flags": retail_flags,
    "date_parse_variants": date_parse_variants,
    "dq_dropped": dq_dropped,
    "dq_shape": dq_shape,
    "sanitize": sanitize,
    "retail_summary": retail_summary,
    "derived_rates": derived_rates,
    "account_age": account_age,
    "keyword_counts": keyword_counts,
    "ticket_sentiment": ticket_sentiment,
    "keyword_counts_long_text": keyword_counts_long_text,
    "tickets_typed": tickets_typed,
    "dq_purchase_dates": dq_purchase_dates,
    "link_map": link_map,
    "link_tickets": link_tickets,
    "link_tickets_all": link_tickets_all,
    "ticket_summary": ticket_summary,
    "features": feature_rows,
    "features_linked": feature_rows_linked,
    "features_incremental": features_incremental,
    "abuse_label": abuse_label,
    "label_totals": label_totals,
    "label_dist": label_dist,
    "flagged_top": flagged_top,
    "scored": scored,
    "score_new": score_new,
    "score_stored": score_stored,
    "flag_threshold": flag_threshold,
    "manual_score": manual_score,
    "reasons_rules": reasons_rules,
    "reasons_factors": reasons_factors,
    "reasons_factors7": reasons_factors7,
    "verdict": verdict,
    "stratified_split": stratified_split,
    "class_report": class_report,
    "roc_auc": roc_auc,
    "linear_shapley": linear_shapley,
    "shapley_global": shapley_global,
    "shapley_one": shapley_one,
    "shapley_summary": shapley_summary,
    "sampled_facts": sampled_facts,
    "gbt_scored": gbt_scored,
    "gbt_facts": gbt_facts,
    "gbt_report": gbt_report,
    "gbt_auc": gbt_auc,
    "gbt_shapley": gbt_shapley,
    "gbt_shapley_global": gbt_shapley_global,
}
