"""Estimators and calibrators over Spark ML."""
