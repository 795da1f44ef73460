"""Every query of the library, by name."""

from .operators import catalog, contents, entries, ledger, lifecycle, mining, packages, publishing, shelf, structure, texts  # noqa: F401
from .plans.registry import ORACLES, QUERIES  # noqa: F401
from .sources import queries as sources  # noqa: F401
from .streaming import queries as streams  # noqa: F401
