"""Text backends: the same queries for other databases, as texts or documents with bound literals."""

from .documents import Elastic, Mongo
from .sql import MySql, Postgres

TEXT_BACKENDS = (Postgres(), MySql(), Mongo(), Elastic("elasticsearch"), Elastic("opensearch"))
