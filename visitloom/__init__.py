"""Longitudinal cohorts, features, metrics and models as Spark DataFrame operators."""
