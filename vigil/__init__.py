"""vigil: security-event analytics on Spark DataFrames.

Raw audit events are validated (bad ones become dead letters with a reason),
enriched with exact per-event sliding-window features by user, IP and account,
scored by an isolation forest, turned into explained alerts, folded by
fingerprint into suppression sessions, and summarised by triage queries.
The same functions run on a batch table and inside a streaming micro-batch.
"""

__all__ = ["session"]
