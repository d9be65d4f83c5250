"""Corpus pipeline: from raw documents to packed training sequences. The stages are in ``raterscope.llm.stages``."""

from raterscope.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
