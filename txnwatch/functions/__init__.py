"""Scalar column helpers."""

from txnwatch.functions.expr import (  # noqa: F401
    differs, epoch_seconds, is_multiple, keyed_hash, one_hot, parse_ts, round6, safe_ratio,
    typology_from_header,
)
