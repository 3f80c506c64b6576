"""Every registered query, and the SQL each is checked against."""

from lumberline.queries import lookups, parsing, relational, temporal  # noqa: F401
from lumberline.queries.base import ORACLES, QUERIES  # noqa: F401
