"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import decontaminate, htmltext, language, linededup, packing, quality, secrets, simhash, substrings, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": secrets.query,
    "op2_simhash": simhash.query,
    "op3_language": language.query,
    "op4_substrings": substrings.query,
    "op5_toxicity": toxicity.query,
    "op6_quality": quality.query,
    "op7_linededup": linededup.query,
    "op8_decontaminate": decontaminate.query,
    "op9_htmltext": htmltext.query,
    "op10_packing": packing.query,
}
ORACLE_SQL: dict[str, str] = {}
