"""Imports every query module so their ``@query`` registrations run."""
from . import q_chunks, q_extract, q_judge, q_ledger, q_misc, q_prompts, q_runs, q_sources, q_streaming, q_usage  # noqa: F401
