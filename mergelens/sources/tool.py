"""Calls of the hosting service's command-line tool, on the driver or in a task.

The tool is called without a shell; ``run`` can be replaced in tests and other deployments.
"""

from __future__ import annotations

import heapq
import io
import json
import subprocess
import time
from collections.abc import Callable, Iterator

Runner = Callable[[list[str]], subprocess.CompletedProcess]

# What marks an error as passing.
PASSING_ERRORS = ("502", "503", "504", "timeout", "rate limit")
# The fields that are asked for.
PR_FIELDS = (
    "number,author,title,createdAt,mergedAt,closedAt,state,additions,deletions,isDraft,labels,"
    "reviewDecision,reviews,reviewRequests,mergedBy,comments,changedFiles"
)
REPO_LIMIT, SEARCH_LIMIT, PR_LIMIT = 100, 1000, 20


def run_tool(args: list[str]) -> subprocess.CompletedProcess:
    return subprocess.run(args, capture_output=True, text=True, check=False)


def call(args: list[str], tries: int = 3, delay: float = 2.0, run: Runner = run_tool, sleep=time.sleep) -> list:
    """The tool's JSON output; an empty list on failure. Passing errors are tried again."""
    for attempt in range(tries):
        done = run(["gh", *args])
        if done.returncode == 0:
            try:
                return json.loads(done.stdout) if done.stdout.strip() else []
            except json.JSONDecodeError as e:
                print(f"Unreadable output: {e}")
                return []
        error = done.stderr.strip()
        if attempt + 1 == tries or not any(x in error for x in PASSING_ERRORS):
            print(f"Failed: {error}")
            return []
        sleep(delay * 2**attempt)
    return []


class LandedTool:
    """Answers as the tool does, from landed JSON lines in ``root/org=<org>/repo=<repo>/``.

    For collections that another job lands, and for tests: any file system that pyarrow opens, files
    plain or compressed as their names say.
    Names are those of the folders; the newest pull requests come first.
    """

    def __init__(self, root: str) -> None:
        self.root = root

    def _files(self, below: str):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        return system, system.get_file_info(fs.FileSelector(f"{path}/{below}", allow_not_found=True))

    def _prs(self, org: str, repo: str) -> Iterator[dict]:
        system, found = self._files(f"org={org}/repo={repo}")
        for f in found:
            if f.is_file and not f.base_name.startswith(("_", ".")):
                with system.open_input_stream(f.path) as stream, io.TextIOWrapper(stream, encoding="utf-8") as lines:
                    yield from (json.loads(line) for line in lines if line.strip())

    def __call__(self, args: list[str]) -> subprocess.CompletedProcess:
        if args[1:3] == ["repo", "list"]:
            _, found = self._files(f"org={args[3]}")
            out = [{"name": f.base_name.removeprefix("repo=")} for f in found if f.base_name.startswith("repo=")]
        elif args[1:3] == ["pr", "list"]:
            org, _, repo = args[args.index("--repo") + 1].partition("/")
            # no more is held than a line and the newest so far
            out = heapq.nlargest(int(args[args.index("--limit") + 1]), self._prs(org, repo), key=lambda p: (p.get("createdAt") or "", p.get("number") or 0))
        else:  # the search index holds nothing here
            out = []
        return subprocess.CompletedProcess(args, 0, json.dumps(out), "")
