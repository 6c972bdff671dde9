"""Numeric kernels as plain numpy functions, and the tables that they share with the SQL forms."""
