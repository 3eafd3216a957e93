"""The jobs of the package: build, lay out, look up, rank, compare, sample and report."""
