"""Scalar column functions."""

from .labels import LABEL_NAMES, encode_id, label_name
from .seeded import pick, seeded_key, unit_interval
from .text import clean_text, default_text, strict_double

__all__ = [
    "LABEL_NAMES",
    "clean_text",
    "default_text",
    "encode_id",
    "label_name",
    "pick",
    "seeded_key",
    "strict_double",
    "unit_interval",
]
