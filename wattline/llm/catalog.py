"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from wattline.llm import (decontamination, exact_dedup, html_extraction, language_id, mixing, near_dedup, periodic_runs, quality, sharding,
                          substring_dedup, vector_dedup, warc_revisits, whitening)

_MODULES = (decontamination, exact_dedup, html_extraction, language_id, mixing, near_dedup, periodic_runs, quality, sharding, substring_dedup,
            vector_dedup, warc_revisits, whitening)
QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
