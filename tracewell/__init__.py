"""A PySpark-native engine for provenance auditing of recorded agent runs."""

from tracewell.audit import Audit, audit, check_trace
from tracewell.operators.balance import injection_points, trial_balance
from tracewell.operators.gates import verify
from tracewell.operators.ledger import close_books
from tracewell.operators.report import chain_view, summary
from tracewell.plans.model import Runs
from tracewell.sources.files import load_runs, read_runs, write_runs

__all__ = ["Audit", "Runs", "audit", "chain_view", "check_trace", "close_books", "injection_points", "load_runs", "read_runs", "summary", "trial_balance", "verify", "write_runs"]
