"""Settings and logging."""

from __future__ import annotations

import logging
import os
import sys
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    #: How far inside the number range parameters stay: limits' logs are divided by it.
    margin: float = 2.5
    #: Feature blocks of a fit; 0: by the session's shuffle partitions.
    blocks: int = 0

    @staticmethod
    def from_env(env=os.environ) -> Settings:
        return Settings(float(env.get("TESSERA_MARGIN", 2.5)), int(env.get("TESSERA_BLOCKS", 0)))


SETTINGS = Settings.from_env()

FORMAT = "%(asctime)s %(name)s %(levelname)s %(message)s"


def setup_logging(verbosity: int | str = "INFO", stream=None, format: str = FORMAT) -> logging.Handler:
    """Log the package's messages to a stream (stderr by default); returns the handler."""
    unconfigure_logging()
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(logging.Formatter(format))
    handler.set_name("tessera")
    log = logging.getLogger("tessera")
    log.addHandler(handler)
    log.setLevel(verbosity)
    return handler


def unconfigure_logging() -> None:
    log = logging.getLogger("tessera")
    for h in [h for h in log.handlers if h.get_name() == "tessera"]:
        log.removeHandler(h)
    log.setLevel(logging.NOTSET)
