"""Operators for building training corpora. Nothing else in lexweave imports this subpackage."""
