"""The corpus pipeline; see ``tabflow.llm.pipeline``."""

from tabflow.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
