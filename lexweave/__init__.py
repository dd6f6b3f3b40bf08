"""Lexweave: a text-analytics engine made of Spark plans."""
