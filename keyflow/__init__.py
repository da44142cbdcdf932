"""Keyed, expiring data and command-log replay as Spark DataFrame operators."""
