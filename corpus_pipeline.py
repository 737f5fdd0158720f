"""The corpus pipeline: see oreweave/llm/pipeline.py."""

from oreweave.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
