"""Where an index may come from: local folders or git URLs."""

from __future__ import annotations

import contextlib
import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterator

from ..config import DEFAULT, EngineConfig

# Fixed values.
SCHEMES = ("https://", "http://", "ssh://", "git://", "git+ssh://", "file://")
_SCP = re.compile(r"[\w.-]+@[\w.-]+:(?!/)")


def is_git_url(source: str) -> bool:
    return source.startswith(SCHEMES) or bool(_SCP.match(source))


def is_allowed(source: str, config: EngineConfig = DEFAULT) -> bool:
    """Local paths and https; http if the configuration says so."""
    return not is_git_url(source) or source.startswith("https://") or (source.startswith("http://") and config.allow_http_git)


def check_workspace(path: str, config: EngineConfig = DEFAULT) -> None:
    """Local paths must stay inside the workspace, if there is one."""
    if not config.workspace_root or is_git_url(path):
        return
    root, at = os.path.abspath(config.workspace_root), os.path.abspath(path)
    if at != root and not at.startswith(root.rstrip(os.sep) + os.sep):
        raise ValueError(f"outside the workspace: {path}")


def resolve(source: str) -> str:
    return source if is_git_url(source) else os.path.abspath(source)


def source_key(source: str, ref: str | None = None) -> str:
    return (f"{source}@{ref}" if ref else source) if is_git_url(source) else os.path.abspath(source)


def indexed_path(path: str, root: str | None) -> str:
    """An absolute or relative path as the index has it."""
    if not root:
        return path
    top = os.path.abspath(root)
    at = os.path.abspath(os.path.join(top, path))
    if at == top:
        return ""
    return os.path.relpath(at, top).replace(os.sep, "/") if at.startswith(top.rstrip(os.sep) + os.sep) else path


@contextlib.contextmanager
def cloned(url: str, ref: str | None = None, config: EngineConfig = DEFAULT) -> Iterator[str]:
    """A shallow clone in a temporary folder, gone afterwards."""
    if not is_allowed(url, config):
        raise ValueError(f"not an allowed source: {url}")
    folder = tempfile.mkdtemp(prefix="tesserae-clone-")
    try:
        branch = ["--branch", ref] if ref else []
        done = subprocess.run(["git", "clone", "--depth", "1", *branch, "--", url, folder], capture_output=True, text=True, timeout=config.clone_timeout_s)
        if done.returncode:
            raise RuntimeError(f"git clone failed: {done.stderr.strip()}")
        yield folder
    finally:
        shutil.rmtree(folder, ignore_errors=True)
