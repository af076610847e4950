"""Sources: billing exports as CSV, any DataFrame, and synthetic series."""

from .billing import Billing, Roles, from_dataframe, parse_billing_csv, read_billing_csv, resolve_roles
from .synthetic import make_series

__all__ = ["Billing", "Roles", "from_dataframe", "make_series", "parse_billing_csv", "read_billing_csv", "resolve_roles"]
