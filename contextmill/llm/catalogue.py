"""All queries of this subpackage."""

from __future__ import annotations

from ..plans.catalogue import Catalogue
from . import (decontaminate, kdtree, mixing, near_dedup, pivots, quality, secret_scan, spelling, suffix_dedup, token_counts, tool_calls, toxicity,
               url_rules)


def llm_queries() -> Catalogue:
    merged = Catalogue()
    for module in (quality, suffix_dedup, mixing, token_counts, toxicity, tool_calls, near_dedup, decontaminate, url_rules, kdtree,
                   secret_scan, spelling, pivots):
        merged.queries.update(module.CATALOGUE.queries)
        merged.sql.update(module.CATALOGUE.sql)
    return merged
