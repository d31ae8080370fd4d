"""Returns-risk analytics on Spark: from invoice lines and support tickets to scored customers."""

from returns_risk.plans.compose import build_features, score_new
from returns_risk.sources.csv import read_retail, read_tickets

__all__ = ["build_features", "read_retail", "read_tickets", "score_new"]
