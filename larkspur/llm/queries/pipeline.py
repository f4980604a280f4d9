from ..pipeline import ORACLE_SQL as SQL
from ..pipeline import run

NAME = "pipeline"
__all__ = ["NAME", "SQL", "run"]
