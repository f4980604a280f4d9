"""A corpus pipeline: toxic documents go, poor ones go, near copies go, sources are mixed, texts become tokens.

The stages are in ``larkspur.llm.pipeline``; here are the names by which a driver finds them.
"""

from larkspur.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
