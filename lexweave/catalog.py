"""Registry of the library's own queries: name -> (function, SQL)."""

from __future__ import annotations

from lexweave.operators import analysis, facts, kb, learn, lookups, names, neardup, ngrams, relations, scalars, sentences, values
from lexweave.plans import patterns
from lexweave.streaming import queues

MODULES = (values, analysis, learn, names, ngrams, neardup, kb, facts, lookups, relations, scalars, sentences, patterns, queues)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
FLAGSHIP = "value_counts"
