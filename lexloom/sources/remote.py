"""Connectors that run on the driver and land files for Spark to read: HTTP with retries, git, version histories, JSON outlines."""

from __future__ import annotations

import hashlib
import json
import subprocess
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

WAITS = (5, 15, 30, 60, 120)


def http_get(url: str, token: str | None = None, timeout: float = 60, waits: tuple = WAITS, sleep: Callable = time.sleep, opener: Callable = urllib.request.urlopen) -> str:
    """Body of a page; after each failure the next wait, after the last the error."""
    request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
    for wait in (*waits, None):
        try:
            with opener(request, timeout=timeout) as r:
                return r.read().decode("utf-8")
        except (urllib.error.URLError, TimeoutError):
            if wait is None:
                raise
            sleep(wait)
    raise AssertionError


def git(*args: str, cwd: str | Path | None = None) -> str:
    return subprocess.run(["git", *args], cwd=cwd, check=True, capture_output=True, text=True, encoding="utf-8").stdout


def ensure_clone(url: str, target: Path) -> tuple[str, str]:
    """Shallow, sparse clone without blobs, reused if it is there; the head's id and date."""
    if not (target / ".git").is_dir():
        target.parent.mkdir(parents=True, exist_ok=True)
        git("clone", "-q", "--depth=1", "--sparse", "--filter=blob:none", "-c", "core.autocrlf=false", url, str(target))
    commit, day = git("show", "-s", "--format=%H %cI", "HEAD", cwd=target).split()
    return commit, day


def tracked(repo: str | Path, below: str | None = None, recursive: bool = False) -> list[str]:
    """Names in the head's tree."""
    out = git("ls-tree", "--name-only", "-z", *(["-r"] if recursive else []), "HEAD", *([below] if below else []), cwd=repo)
    return list(filter(None, out.split("\0")))


class DiskCache:
    """Fetched texts by name, kept in a folder."""

    def __init__(self, folder: Path):
        self.folder = folder

    def get(self, name: str, fetch: Callable[[], str]) -> str:
        p = self.folder / name
        if not p.exists():
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(fetch(), encoding="utf-8")
        return p.read_text(encoding="utf-8")


def history(path: str, pages: Callable[[int], str], content: Callable[[str], str], cache: DiskCache) -> Iterator[dict]:
    """Versions of one file from the newest commit on: path, commit, text. Pages and contents are cached; ends at an empty page."""
    tag = hashlib.sha1(path.encode()).hexdigest()[:12]
    number = 0
    while True:
        number += 1
        commits = json.loads(cache.get(f"pages/{tag}-{number}.json", lambda n=number: pages(n)))
        if not commits:
            return
        for c in commits:
            yield {"path": path, "commit": c["sha"], "text": cache.get(f"texts/{c['sha']}-{tag}.md", lambda sha=c["sha"]: content(sha))}


def outline(obj, depth: int = 3, indent: int = 0) -> list[str]:
    """Names and kinds of a nested JSON value, a level per indent; of lists the first element."""
    pad = "  " * indent
    if isinstance(obj, dict) and depth:
        out = []
        for k, v in obj.items():
            out.append(f"{pad}{k}: {type(v).__name__}")
            out += outline(v, depth - 1, indent + 1) if isinstance(v, (dict, list)) else []
        return out
    if isinstance(obj, list) and obj and depth:
        return [f"{pad}[{len(obj)}]", *outline(obj[0], depth - 1, indent + 1)]
    return []


def first_records(obj) -> list[dict] | None:
    """The first list of objects in a nested JSON value, breadth first."""
    queue = [obj]
    while queue:
        x = queue.pop(0)
        if isinstance(x, list) and x and all(isinstance(i, dict) for i in x):
            return x
        queue += list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
    return None
