"""DataFrame operators of literature-evidence analysis."""
