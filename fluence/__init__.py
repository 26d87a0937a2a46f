"""Dose analytics for cohorts, as Spark DataFrame operators."""
