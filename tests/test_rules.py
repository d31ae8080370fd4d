import pytest

from returns_risk import constants as c
from returns_risk.operators import rules
from returns_risk.operators.scoring import (
    feature_rows, flag_accounts, load_linear, save_linear, score_features, typed_in_rates,
)

G1 = (12345, 10, 100, 5, 1000.0, 50.0, 0.05, 0.05, 300, 3, 1, 0, 0, 2, 0, 1, -0.2, -0.8)
G3 = (10001, 15, 150, 40, 2500.0, 600.0, 0.27, 0.24, 450, 5, 3, 0, 0, 5, 1, 2, -0.6, -0.9)


def rows(spark, *changes, base=G1):
    names = [c.CUSTOMER, *c.FEATURES]
    made = []
    for number, change in enumerate(changes):
        made.append(tuple({**dict(zip(names, base)), **change, c.CUSTOMER: number}[n] for n in names))
    return feature_rows(spark, made)


def test_golden_rows(spark):
    frame = flag_accounts(score_features(rules.abuse_label(feature_rows(spark, [G1, G3]))))
    one, three = frame.orderBy(c.PROBABILITY).collect()
    assert (round(one[c.PROBABILITY], 12), one[c.PREDICTION], one.flagged) == (0.295, 0, False)
    assert (one.rule_a, one.rule_b, one.rule_c, one[c.LABEL]) == (False, False, False, 0)
    assert (round(three[c.PROBABILITY], 12), three[c.PREDICTION], three.flagged) == (0.669, 1, False)
    assert (three.rule_a, three.rule_b, three.rule_c, three[c.LABEL]) == (False, True, True, 1)


def test_rates_of_typed_in_rows(spark):
    got = typed_in_rates(rows(
        spark, {}, {"TotalItemsReturned": 1, "TotalItemsPurchased": 8}, {"TotalItemsPurchased": 0}, {"TotalPurchaseValue": 0.0},
    )).orderBy(c.CUSTOMER).collect()
    assert [r.RefundRate_by_Items for r in got] == [0.05, 0.12, 5.0, 0.05]
    assert [r.RefundRate_by_Value for r in got] == [0.05, 0.05, 0.05, 50.0]


def test_boundaries_are_strict(spark):
    quiet = {"MinTicketSentimentScore": 0.0, "Tickets_KeywordMissingCount": 0}
    frame = rows(
        spark,
        quiet | {"RefundRate_by_Items": 0.3, "Tickets_TypeRefundRequest": 2},
        quiet | {"RefundRate_by_Items": 0.31, "Tickets_TypeRefundRequest": 2},
        quiet | {"RefundRate_by_Items": 0.31, "Tickets_TypeRefundRequest": 1},
        quiet | {"RefundRate_by_Value": 0.2, "Tickets_KeywordDamageCount": 1},
        quiet | {"RefundRate_by_Value": 0.21, "Tickets_KeywordDamageCount": 1},
        quiet | {"RefundRate_by_Value": 0.21},
        quiet | {"MinTicketSentimentScore": -0.5, "TotalItemsReturned": 6},
        quiet | {"MinTicketSentimentScore": -0.51, "TotalItemsReturned": 5},
        quiet | {"MinTicketSentimentScore": -0.51, "TotalItemsReturned": 6},
    )
    got = rules.abuse_label(frame).orderBy(c.CUSTOMER).collect()
    assert [(r.rule_a, r.rule_b, r.rule_c) for r in got] == [
        (False,) * 3, (True, False, False), (False,) * 3, (False,) * 3, (False, True, False), (False,) * 3,
        (False,) * 3, (False,) * 3, (False, False, True),
    ]
    assert [r[c.LABEL] for r in got] == [0, 1, 0, 0, 1, 0, 0, 0, 1]


def test_score_is_clipped_and_sanitized(spark):
    nan = float("nan")
    calm = {"MinTicketSentimentScore": 0.0, "Tickets_TypeRefundRequest": 0}
    frame = rows(spark, calm | {"RefundRate_by_Items": 9.0}, calm | {"RefundRate_by_Items": 0.0}, calm | {"RefundRate_by_Items": nan}, calm | {"RefundRate_by_Items": None})
    got = [r[c.PROBABILITY] for r in score_features(frame).orderBy(c.CUSTOMER).collect()]
    assert got == [0.95, 0.05, 0.05, 0.05]
    thresholds = score_features(rows(spark, calm | {"RefundRate_by_Items": 1.0}), {"RefundRate_by_Items": 0.5})
    assert thresholds.first()[c.PREDICTION] == 0
    assert flag_accounts(score_features(rows(spark, calm | {"RefundRate_by_Items": 1.0}), {"RefundRate_by_Items": 0.7})).first().flagged is False


def test_reasons(spark):
    g1, g3 = feature_rows(spark, [G1]), feature_rows(spark, [G3])
    assert rules.reasons_rules(g1).first().reasons == []
    assert rules.reasons_rules(g3).first().reasons == [
        "  - **High Value Refund Rate (0.24)** and **tickets mentioning missing/damaged items** (Missing: 2, Damaged: 1).",
        "  - **Very Negative Ticket Sentiment (-0.90)** and **significant items returned (40)**.",
    ]
    seven = rules.reasons_factors7(g3).first().reasons
    assert len(seven) == 6 and seven[0].startswith("- **Very Negative Ticket Sentiment:** (-0.90)")
    assert seven[-2] == "- **Tickets Mentioning 'Missing' Items:** (2 counts) can be a common red flag."
    five = rules.reasons_factors(g3).first().reasons
    assert len(five) == 4 and "(Missing: 2, Damaged: 1)" in five[2]


def verdicts(df, style):
    return [(r.verdict, r.category, r.explanation) for r in rules.verdict(df, style).orderBy(c.CUSTOMER).collect()]


def test_verdicts(spark):
    quiet = {"MinTicketSentimentScore": 0.0, "Tickets_KeywordMissingCount": 0, "Tickets_TypeRefundRequest": 0}
    frame = rows(
        spark, {}, quiet | {"RefundRate_by_Items": 0.9}, quiet | {"RefundRate_by_Items": 0.7}, quiet,
    )
    likelihood = verdicts(rules.reasons_rules(score_features(frame), c.RULE_REASONS_FORM), "likelihood")
    assert [v[:2] for v in likelihood] == [
        ("NOT FLAGGED", "unlikely"), ("FLAGGED", "likely"), ("NOT FLAGGED", "neutral"), ("NOT FLAGGED", "unlikely"),
    ]
    prediction = verdicts(rules.reasons_factors7(score_features(frame)), "prediction")
    assert [v[1] for v in prediction] == ["clear_with_reasons", "flagged_with_reasons", "clear_with_reasons", "clear_no_reasons"]
    assert "(Probability: 0.2950)" in prediction[0][2]
    flagged = score_features(rows(spark, quiet), {"TotalUniqueOrders": 1.0})
    assert verdicts(rules.reasons_factors7(flagged), "prediction")[0][1] == "flagged_no_reasons"
    assert verdicts(rules.reasons_factors(flagged), "factors")[0][1:] == ("none", c.NO_REASON_BATCH_FACTORS)
    assert verdicts(rules.reasons_rules(flagged), "rules")[0][1:] == ("none", c.NO_REASON_BATCH_RULES)
    with pytest.raises(ValueError):
        rules.verdict(flagged, "loud")


def test_linear_weights_as_a_table(spark, tmp_path):
    save_linear(spark, str(tmp_path / "w"))
    assert load_linear(spark, str(tmp_path / "w")) == c.SCORE_WEIGHTS
    assert list(load_linear(spark, str(tmp_path / "w"))) == list(c.SCORE_WEIGHTS)
