"""The queries of this folder and their SQL."""

from __future__ import annotations

from ledgerloom.llm import chat, collocations, compression, linededup, oddsketch, packing, pieces, rankedsearch, repetition, rollups, secrets, spotsigs, toxicity

_MODULES = [chat, collocations, compression, linededup, oddsketch, packing, pieces, rankedsearch, repetition, rollups, secrets, spotsigs, toxicity]


def queries() -> dict:
    return {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
