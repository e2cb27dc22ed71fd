"""Query plans over the test tables."""


def load() -> None:
    """Import the modules that register queries."""
    from vigil.plans import core, extra, models, more, tables  # noqa: F401
