"""The queries offered to the driver, and the SQL that states what each must return."""

from termspire.registered.oracles import oracle_sql
from termspire.registered.queries import entry, queries

__all__ = ["entry", "oracle_sql", "queries"]
