"""Whole plans: trace lists and their evaluation over the facts."""
