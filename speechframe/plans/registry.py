"""All registered queries."""

from __future__ import annotations

from speechframe.plans import evaluation, operations, recordings, services, transcripts

QUERIES = {**transcripts.QUERIES, **evaluation.QUERIES, **operations.QUERIES, **services.QUERIES, **recordings.QUERIES}
ORACLES = {**transcripts.ORACLES, **evaluation.ORACLES, **operations.ORACLES, **services.ORACLES, **recordings.ORACLES}
