"""Lexweave functions."""
