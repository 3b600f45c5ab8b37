"""Temporal valuation and paired evaluation over trade logs, as Spark DataFrame functions."""
