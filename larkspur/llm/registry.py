"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .queries import op1, op10, op2, op3, op4, op5, op6, op7, op8, op9, pipeline

_MODULES = (op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, pipeline)
QUERIES = {m.NAME: m.run for m in _MODULES}
ORACLES = {m.NAME: m.SQL for m in _MODULES if m.SQL}
