"""Typed errors raised on the driver before any job runs."""


class RaterscopeError(Exception):
    """Base class of every error this package raises itself."""


class MissingColumnsError(RaterscopeError, ValueError):
    """Columns the caller named are not in the DataFrame."""

    def __init__(self, missing, available):
        self.missing = list(missing)
        self.available = list(available)
        super().__init__(f"columns not found: {self.missing}; available: {self.available}")


class NotEnoughUsersError(RaterscopeError, ValueError):
    """An exact sample asks for more users than the source holds."""


class NoDataError(RaterscopeError, ValueError):
    """A path or filter that must yield rows yields none."""
