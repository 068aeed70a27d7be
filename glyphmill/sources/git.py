"""Git repositories as a source."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import Column

URL = r"^(?:https?|ssh|git|git\+ssh|file)://|^[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+:(?!/)"


def is_git_url(url: Column) -> Column:
    """Whether a column's values are remote: a known scheme, or user@host:path without a slash after the colon."""
    return url.rlike(URL)


def looks_remote(source: str) -> bool:
    """The same for one string."""
    return re.search(URL, source) is not None


def clone(url: str, folder: str, ref: str | None = None) -> None:
    """A shallow clone that asks for nothing; a ref that could be taken for an option is refused."""
    if ref and ref.startswith("-"):
        raise ValueError(f"Invalid git ref (must not start with '-'): {ref}")
    branch = ["--branch", ref] if ref else []
    try:
        done = subprocess.run(["git", "clone", "--depth", "1", *branch, "--", url, folder], capture_output=True, text=True, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
    except OSError as e:
        raise RuntimeError(f"git clone failed for {url}: {e}") from e
    if done.returncode:
        raise RuntimeError(f"git clone failed for {url}: {done.stderr.strip() or 'unknown error'}")
