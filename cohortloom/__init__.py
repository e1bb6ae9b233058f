"""Cohort selection, exploration and pattern mining over coded event histories, on Spark."""
