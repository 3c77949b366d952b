"""What surrounds a run: settings from a file of KEY=VALUE lines and the environment, and logs without secrets."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping


def settings(lines: Iterable[str], environment: Mapping[str, str]) -> dict[str, str]:
    """The file's values (quotes around them go, empty lines and comments are passed over), with those of the environment in their place where it has them."""
    pairs = (line.split("=", 1) for line in map(str.strip, lines) if "=" in line and not line.startswith("#"))
    found: dict[str, str] = {}
    for key, value in pairs:
        found.setdefault(key.strip(), value.strip().strip('"').strip("'"))
    return {key: environment.get(key, value) for key, value in found.items()}


class Redacted(logging.Filter):
    """Puts stars for secrets in log records, in messages as well as in their arguments."""

    def __init__(self, secrets: Iterable[str], least: int = 6):
        super().__init__()
        self.secrets = sorted((s for s in secrets if len(s) >= least), key=len, reverse=True)

    def filter(self, record: logging.LogRecord) -> bool:
        said = record.getMessage()
        for secret in self.secrets:
            said = said.replace(secret, "***")
        record.msg, record.args = said, ()
        return True
