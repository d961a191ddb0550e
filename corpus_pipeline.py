"""The pipeline over the table `documents`; its stages are in feedweave.llm.pipeline."""

from feedweave.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
