"""Queries run by the driver contract, each with the SQL it has to agree with."""
