"""The queries of this subpackage, and SQL for those that SQL can express."""

from quarry.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10

_ALL = (op1, op2, op3, op4, op5, op6, op7, op8, op9, op10)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _ALL for k, v in m.ORACLES.items()}
