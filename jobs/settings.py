"""Settings of a job: its config file, overridden by command-line options of the same names."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path


def read(config: str, argv: list[str] | None, about: str) -> dict:
    """The values of the JSON file ``config`` (a file of the driver's), those of ``--name value`` in place of its own."""
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", default=config, help=f"JSON file with the settings (default {config})")
    defaults = json.loads(Path(config).read_text())
    for name, value in defaults.items():
        if not isinstance(value, list | dict):
            parser.add_argument(f"--{name}", type=type(value), default=None, help=f"default {value!r}")
    given = vars(parser.parse_args(argv))
    chosen = defaults | json.loads(Path(given.pop("config")).read_text())
    if unknown := set(chosen) - set(defaults):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return chosen | {k: v for k, v in given.items() if v is not None}
