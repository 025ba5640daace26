from . import collapsed, corpus, headed, hosted, indexed, ordered, queries, recovered, refreshed, walked, zoned  # noqa: F401  all register their queries
