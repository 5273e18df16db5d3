"""A project's tests, run on the driver; the output goes to `fitness.test_pass_rate` as a column."""

from __future__ import annotations

import json
import os
import subprocess
from pathlib import Path

TIMEOUT_S = 30.0
COMMAND = ("bun", "test", "--bail", "0")


def has_tests(folder: str | Path) -> bool:
    """Whether the folder's package.json names a test script; not so if it is missing or corrupt."""
    try:
        scripts = json.loads((Path(folder) / "package.json").read_text(encoding="utf-8")).get("scripts")
        return bool(scripts.get("test"))
    except (OSError, ValueError, AttributeError):
        return False


def run_tests(folder: str | Path, command: tuple[str, ...] = COMMAND, timeout: float = TIMEOUT_S) -> tuple[str | None, int]:
    """Output (standard output, then errors) and exit code; no output where there are no tests, they cannot start or take too long."""
    if not has_tests(folder):
        return None, 0
    try:
        done = subprocess.run(command, cwd=folder, capture_output=True, timeout=timeout, env=os.environ | {"CI": "true"}, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None, 0
    return (done.stdout + done.stderr).decode("utf-8", "replace"), done.returncode
