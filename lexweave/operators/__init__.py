"""Lexweave operators."""
