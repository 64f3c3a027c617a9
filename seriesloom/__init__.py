"""Ordered-signal, interval and cohort analytics written as Spark plans."""
