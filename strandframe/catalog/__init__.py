"""The registered queries: every one runs an operator on the given tables."""

from importlib import import_module

from strandframe.catalog.base import ORACLES, QUERIES

_FIELDS = (
    "sequences", "intervals", "variants", "design", "alignments", "structures", "hypotheses",
    "profiles", "expression", "enrichment", "microbiome", "survival", "learning", "records", "files", "verbs",
)


def load() -> tuple[dict, dict]:
    for field in _FIELDS:
        import_module(f"strandframe.catalog.{field}")
    return QUERIES, ORACLES
