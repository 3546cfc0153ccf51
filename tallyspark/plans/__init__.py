"""Queries over the driver's tables: orders are batches, line items their files, events the audit log."""

from .audit import QUERIES as _AUDIT
from .checks import QUERIES as _CHECKS
from .details import QUERIES as _DETAILS
from .documents import QUERIES as _DOCUMENTS
from .lists import QUERIES as _LISTS
from .receipts import QUERIES as _RECEIPTS
from .report import QUERIES as _REPORT
from .review import QUERIES as _REVIEW
from .tables import QUERIES as _TABLES

_ALL = _REPORT | _REVIEW | _AUDIT | _TABLES | _DOCUMENTS | _LISTS | _CHECKS | _DETAILS | _RECEIPTS
QUERIES = {name: f for name, (f, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
