"""Registered queries: the operators applied to the test tables, with the SQL they must agree with."""
