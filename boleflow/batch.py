"""Runs over a folder of rasters: all of them as one job, or one by one with failures apart."""

from __future__ import annotations

import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

#: Exit codes: some input failed; a wrong call; the merge failed.
FAILED, MISUSE, MERGE_FAILED = 1, 2, 3


def process(paths: list[str], run: Callable[[str], None], jobs: int = 1) -> dict[str, str]:
    """run(path) for each path once, jobs at a time; what failed, with its message.

    Jobs share one session; with the FAIR scheduler they share its executors too.
    """

    def one(path: str) -> tuple[str, str | None]:
        try:
            run(path)
            return path, None
        except Exception as e:  # one raster's failure must not stop the others
            return path, f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(max(1, jobs)) as pool:
        return {p: why for p, why in pool.map(one, paths) if why is not None}


def exit_code(failed: dict[str, str], merged: bool = True) -> int:
    return FAILED if failed else 0 if merged else MERGE_FAILED


def default_output(folder: str) -> str:
    name = os.path.basename(os.path.normpath(folder))
    return os.path.join(folder, f"{name}_merged_data.gpkg")
