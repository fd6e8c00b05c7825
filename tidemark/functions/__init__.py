"""Part of tidemark; see the package README."""
