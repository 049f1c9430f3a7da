"""Every registered query: name -> (spark, sf_dir) -> DataFrame, and its DuckDB SQL."""

from __future__ import annotations

from . import accounts, retrieval, rulings, scalars, search, stems, stores, streams, texts, usage

MODULES = (search, retrieval, stems, stores, usage, accounts, texts, rulings, scalars, streams)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
