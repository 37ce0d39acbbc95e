"""The queries of the library; importing the package registers them."""

from sheaf.plans import audits, correlate, graph, leak, memory, metadata, rewrites  # noqa: F401
