"""The queries of this folder and their SQL."""

from . import decontaminate, exact_dedup, html_text, licenses, packing, periodic, pii, quality, sharding, simhash, toxicity, wand, warc

MODULES = (toxicity, quality, packing, warc, html_text, decontaminate, licenses, simhash, pii, exact_dedup, periodic, sharding, wand)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
