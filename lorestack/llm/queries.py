"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lorestack.llm import mixture, names, near_duplicates, scans, spam, split, tokenizer

MODULES = (near_duplicates, split, names, scans, tokenizer, mixture, spam)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
