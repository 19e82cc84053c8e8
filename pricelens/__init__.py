"""pricelens: offer extraction, ranking and price comparison as Spark DataFrame jobs.

Every public function takes and returns DataFrames. Scalar rules are Column
expressions (so they stay inside whole-stage codegen); the only Python that runs
on executors is the container splitter (``operators.containers``) and the
stateful stream operator (``streaming.reuse``).
"""

__version__ = "0.1.0"
