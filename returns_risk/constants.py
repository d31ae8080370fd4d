"""Names, word lists, thresholds, weights and texts that the results depend on."""

# ---------------------------------------------------------------------------
# Column names of the two input tables
# ---------------------------------------------------------------------------
# Invoice lines: InvoiceNo, Quantity, InvoiceDate, UnitPrice, CustomerID.
# Header names in the ticket file -> names used everywhere after the scan.
TICKET_COLUMNS = {
    "Ticket ID": "TicketID",
    "Customer Email": "CustomerEmail",
    "Ticket Type": "TicketType",
    "Ticket Description": "TicketDescription",
    "Date of Purchase": "DateOfPurchase",
}

# Cells that count as missing when a CSV file is read.
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# ---------------------------------------------------------------------------
# The feature row, in order
# ---------------------------------------------------------------------------
CUSTOMER = "Simulated_CustomerID"
DATES = ("FirstTransactionDate", "LastTransactionDate")
FEATURES = (
    "TotalUniqueOrders",
    "TotalItemsPurchased",
    "TotalItemsReturned",
    "TotalPurchaseValue",
    "TotalRefundValue",
    "RefundRate_by_Items",
    "RefundRate_by_Value",
    "AccountAgeDays",
    "TotalTickets",
    "Tickets_TypeRefundRequest",
    "Tickets_TypeDeliveryIssue",
    "Tickets_TypeProductInquiry",
    "Tickets_KeywordRefundCount",
    "Tickets_KeywordDamageCount",
    "Tickets_KeywordMissingCount",
    "AvgTicketSentimentScore",
    "MinTicketSentimentScore",
)
TICKET_COUNTS = FEATURES[8:15]
TICKET_SCORES = FEATURES[15:17]
LABEL = "is_refund_abuser"
PROBABILITY = "Predicted_Probability"
PREDICTION = "Predicted_Abuser"

# ---------------------------------------------------------------------------
# Word lists
# ---------------------------------------------------------------------------
REFUND_TERMS = ("refund", "return", "cancel", "money back", "send back", "credit")
DAMAGE_TERMS = ("damaged", "broken", "faulty", "defective", "not working", "malfunction")
MISSING_TERMS = ("missing", "never arrived", "lost package", "not received", "where is my order")
POSITIVE_TERMS = ("happy", "satisfied", "resolved", "excellent", "great", "thank you")
NEGATIVE_TERMS = (
    "bad", "poor", "unhappy", "frustrated", "terrible", "issue", "problem",
    "unresolved", "damaged", "broken", "missing", "refund", "return",
)
NEGATIVE_TERMS_SHORT = (
    "bad", "poor", "unhappy", "frustrated", "terrible", "issue", "problem", "unresolved",
)
KEYWORD_LISTS = {
    "Keywords_RefundCount": REFUND_TERMS,
    "Keywords_DamageCount": DAMAGE_TERMS,
    "Keywords_MissingCount": MISSING_TERMS,
}

# Ticket types that are counted, by feature.
TICKET_TYPES = {
    "Tickets_TypeRefundRequest": "Refund request",
    "Tickets_TypeDeliveryIssue": "Delivery issue",
    "Tickets_TypeProductInquiry": "Product inquiry",
}

# ---------------------------------------------------------------------------
# Thresholds, weights, seed
# ---------------------------------------------------------------------------
ITEMS_RATE_LIMIT = 0.3       # strict >
VALUE_RATE_LIMIT = 0.2       # strict >
REFUND_TICKETS_MIN = 2       # >=
SENTIMENT_LIMIT = -0.5       # strict <
RETURNED_ITEMS_LIMIT = 5     # strict >
SCORE_WEIGHTS = {
    "RefundRate_by_Items": 0.7,
    "MinTicketSentimentScore": -0.2,
    "Tickets_TypeRefundRequest": 0.1,
}
SCORE_RANGE = (0.05, 0.95)
CLASS_THRESHOLD = 0.5        # strict >
FLAG_THRESHOLD = 0.7         # strict >
LIKELY_ABOVE = 0.6           # strict >
UNLIKELY_BELOW = 0.4         # strict <
TEST_FRACTION = 0.2
SEED = 42
BACKGROUND_ROWS = 100
# Size of the trees in gbt_report, gbt_auc and the gbt_shapley queries, whose SQL twins train them step by step.
TREE_ROUNDS, TREE_LEAVES = 5, 7

# ---------------------------------------------------------------------------
# Date formats. "iso" is Spark's own reading of ISO text.
# ---------------------------------------------------------------------------
MONTH_FIRST = ("iso", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy")
DAY_FIRST = ("iso", "d/M/yyyy H:mm", "d/M/yyyy H:mm:ss", "d/M/yyyy")

# ---------------------------------------------------------------------------
# Reason texts. Each list is in output order; the first word names
# the condition (operators/rules.py), the braces are feature values.
# ---------------------------------------------------------------------------
RULE_REASONS_BATCH = (
    ("rule_a", "  - **High Item Refund Rate ({RefundRate_by_Items:.2f})** combined with **multiple Refund Request Tickets ({Tickets_TypeRefundRequest:d})**."),
    ("rule_b", "  - **High Value Refund Rate ({RefundRate_by_Value:.2f})** and **tickets mentioning missing/damaged items** (Missing: {Tickets_KeywordMissingCount:d}, Damaged: {Tickets_KeywordDamageCount:d})."),
    ("rule_c", "  - **Very Negative Ticket Sentiment ({MinTicketSentimentScore:.2f})** and **significant items returned ({TotalItemsReturned:d})**."),
)
RULE_REASONS_FORM = (
    ("rule_a", "- **High Item Refund Rate ({RefundRate_by_Items:.2f})** and **multiple Refund Request Tickets ({Tickets_TypeRefundRequest:d})** are strong indicators."),
    ("rule_b", "- **High Value Refund Rate ({RefundRate_by_Value:.2f})** combined with **tickets mentioning missing/damaged items** (Missing: {Tickets_KeywordMissingCount:d}, Damaged: {Tickets_KeywordDamageCount:d})."),
    ("rule_c", "- **Very Negative Ticket Sentiment ({MinTicketSentimentScore:.2f})** and **significant items returned ({TotalItemsReturned:d})** are highly suspicious."),
)
FACTOR_REASONS_BATCH = (
    ("items_rate", "- **High Refund Rate by Items:** ({RefundRate_by_Items:.2f}) - Suggests frequent returns."),
    ("sentiment", "- **Very Negative Ticket Sentiment:** ({MinTicketSentimentScore:.2f}) - Indicates strong dissatisfaction or aggressive communication."),
    ("refund_tickets", "- **Multiple Refund Request Tickets:** ({Tickets_TypeRefundRequest:d}) - Direct indication of refund-related interactions."),
    ("missing_or_damage", "- **Tickets Mentioning Missing/Damaged Items:** (Missing: {Tickets_KeywordMissingCount:d}, Damaged: {Tickets_KeywordDamageCount:d}) - Common red flags for abuse."),
    ("returned_items", "- **High Number of Items Returned:** ({TotalItemsReturned:d}) - Consistent pattern of merchandise not being kept."),
)
FACTOR_REASONS_FORM = (
    ("items_rate", "- **High Refund Rate by Items:** ({RefundRate_by_Items:.2f}) is a strong indicator of frequent returns."),
    ("sentiment", "- **Very Negative Ticket Sentiment:** ({MinTicketSentimentScore:.2f}) indicates dissatisfaction or potentially aggressive communication in support tickets."),
    ("refund_tickets", "- **Multiple Refund Request Tickets:** ({Tickets_TypeRefundRequest:d}) directly points to a history of seeking refunds."),
    ("value_rate", "- **High Refund Rate by Value:** ({RefundRate_by_Value:.2f}) suggests significant financial value of returns."),
    ("returned_items", "- **High Total Items Returned:** ({TotalItemsReturned:d}) indicates a consistent pattern of not keeping merchandise."),
    ("missing", "- **Tickets Mentioning 'Missing' Items:** ({Tickets_KeywordMissingCount:d} counts) can be a common red flag."),
    ("damage", "- **Tickets Mentioning 'Damaged' Items:** ({Tickets_KeywordDamageCount:d} counts) can also be a red flag for false claims."),
)
NO_REASON_BATCH_RULES = "##### Factors for flagging (based on heuristic): No specific conditions met for this customer's sample values to clearly define the exact heuristic path. (This would be more precise with real SHAP values)."
NO_REASON_BATCH_FACTORS = "No dominant conceptual factors found for this flagged customer based on simplified conditions."
LIKELY_TEXT = "Based on the overall combination of features, this customer has a high likelihood of being an abuser. (A real SHAP plot would pinpoint exact feature contributions)."
UNLIKELY_TEXT = "The combination of features suggests a low likelihood of abuse for this customer. (A real SHAP plot would pinpoint exact feature contributions)."
NEUTRAL_TEXT = "Based on the entered values, the conceptual model doesn't find a strong reason to flag this customer under the defined heuristics. (A real SHAP analysis would offer more nuanced explanations)."
FLAGGED_WITH_REASONS_TEXT = "##### Reasons for Flagging as Potential Abuser:"
FLAGGED_NO_REASONS_TEXT = "Based on the combination of entered features, the conceptual model predicts a high likelihood of abuse (Probability: {Predicted_Probability:.4f}), even if specific heuristic conditions weren't individually met strongly. (A real SHAP analysis would offer more nuanced explanations)."
CLEAR_NO_REASONS_TEXT = "Based on the entered values, the conceptual model predicts a low likelihood of abuse (Probability: {Predicted_Probability:.4f}). Features indicate a legitimate customer profile."
CLEAR_WITH_REASONS_TEXT = "While some factors might slightly push towards abuse, the overall combination of features for this customer suggests a low likelihood of abuse (Probability: {Predicted_Probability:.4f}). (A real SHAP analysis would highlight counteracting features)."
FLAGGED_TEXT = "FLAGGED"
NOT_FLAGGED_TEXT = "NOT FLAGGED"
