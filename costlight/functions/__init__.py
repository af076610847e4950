"""Column functions: parsing of dates and costs, severity, medians, rounding."""

from .scalars import center_of, parse_cost, parse_date, register_sql_functions, rounded, rounded_number, severity, severity_rank, tidy

__all__ = ["center_of", "parse_cost", "parse_date", "register_sql_functions", "rounded", "rounded_number", "severity", "severity_rank", "tidy"]
