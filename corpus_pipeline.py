"""A training-data pipeline of the subpackage's operators."""

from vellum.llm import pipeline as _pipeline

STAGES, ORACLE_SQL, run = _pipeline.STAGES, _pipeline.ORACLE_SQL, _pipeline.run
