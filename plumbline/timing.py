"""A logger and a timer for the stages of a run."""

from __future__ import annotations

import logging
import time


def get_logger(name: str = "plumbline") -> logging.Logger:
    """The logger of that name; its handler is put in place once."""
    logger = logging.getLogger(name)
    if not logger.handlers:
        out = logging.StreamHandler()
        out.setFormatter(logging.Formatter("[%(levelname)s] %(message)s"))
        logger.addHandler(out)
        logger.setLevel(logging.INFO)
        logger.propagate = False
    return logger


class StageTimer:
    """Seconds since it was made, by a clock that never goes back."""

    def __init__(self) -> None:
        self.began = time.monotonic()

    def elapsed(self) -> float:
        return time.monotonic() - self.began
