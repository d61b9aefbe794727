"""Verification of shipping documents at scale, written as Spark DataFrame jobs."""
