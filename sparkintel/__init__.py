"""Threat-intelligence triage on Spark DataFrames."""
