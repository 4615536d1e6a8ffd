"""Settings from the environment."""

from __future__ import annotations

import os
import re

# Names of the variables.
ENV_BASEDIR = "PALIMPSEST_BASEDIR"
ENV_CATALOG = "PALIMPSEST_CATALOG"


def basedir(master: str = "local") -> str:
    """Folder of the catalog and its archives; by default in the home folder, which only a local session's tasks can write."""
    found = os.environ.get(ENV_BASEDIR)
    if not found and not re.match(r"local($|\[)", master):
        raise ValueError(f"set {ENV_BASEDIR} to a folder that the driver and all executors share")
    return found or os.path.join(os.path.expanduser("~"), ".palimpsest")


def catalog_database() -> str | None:
    """SQLite file of the catalog, where one is used instead of the JSON file."""
    return os.environ.get(ENV_CATALOG) or None
