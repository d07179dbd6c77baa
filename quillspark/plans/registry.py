"""All registered queries of the engine and the SQL that each is checked against."""

from . import answers, labelling, preparation, retrieval, scoring, searching, streams

_MODULES = (retrieval, answers, scoring, labelling, searching, preparation, streams)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
