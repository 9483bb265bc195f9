"""Compositions of operators into the read-side plans (batch) ."""
