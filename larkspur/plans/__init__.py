"""Every query of the library, by name."""

from larkspur.plans import catalog, flows, state, text  # noqa: F401
from larkspur.plans.registry import QUERIES, SQL  # noqa: F401
