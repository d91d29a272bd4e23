"""tradetally: two-feed trade reconciliation on Spark DataFrames.

Every public function takes and returns DataFrames; nothing is collected
to the driver except scalar counts and plan-time schema checks.
"""

from tradetally.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
