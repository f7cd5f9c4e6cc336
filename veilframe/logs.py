"""Logging of a run: what was done to how much, never what it says."""

from __future__ import annotations

import logging

LOGGER = logging.getLogger("veilframe")
#: Loggers of libraries, which are held to warnings.
NOISY = ("py4j", "pyspark", "urllib3")


def setup(level: str = "INFO", file: str | None = None) -> logging.Logger:
    """Log to the standard error, and to a file that is begun anew; an unknown level counts as INFO."""
    known = logging.getLevelNamesMapping().get(level.upper(), logging.INFO)
    LOGGER.setLevel(known)
    for old in list(LOGGER.handlers):
        LOGGER.removeHandler(old)
        old.close()
    for handler in [logging.StreamHandler(), *([logging.FileHandler(file, mode="w", encoding="utf-8")] if file else [])]:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        LOGGER.addHandler(handler)
    for name in NOISY:
        logging.getLogger(name).setLevel(logging.WARNING)
    return LOGGER
