"""Rating-label analytics on Spark: tell machine raters from human raters by the shape of their ratings."""

__version__ = "0.1.0"
