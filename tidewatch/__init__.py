"""Fleet telemetry analytics expressed as Spark DataFrame operators."""

from tidewatch.roles import DEFAULT_ROLES, Roles

__all__ = ["DEFAULT_ROLES", "Roles"]
