"""Command line: `run MODEL RASTER MASK PREFIX Stems|Trees|Nodes`, and `merge FOLDER`."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from . import batch, run
from .plans.execution import LADDER

USAGE = f"""usage: run MODEL RASTER MASK PREFIX {"|".join(LADDER)}
       merge FOLDER [--merge-output FILE] [--edge-buffer-m METRES]"""


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    """Exit code: 0, or one of batch's."""
    command, rest = (argv[0], argv[1:]) if argv else ("", [])
    if command == "run" and len(rest) == 5 and rest[4] in LADDER:
        spark = spark or SparkSession.builder.getOrCreate()
        failed = batch.process([rest[1]], lambda path: print(run.analyse_raster(spark, rest[0], path, *rest[2:])))
        for path, why in failed.items():
            print(f"{path}: {why}", file=sys.stderr)
        return batch.exit_code(failed)
    options = dict(zip(rest[1::2], rest[2::2], strict=False))
    try:
        edge = float(options.get("--edge-buffer-m", run.COMMAND_EDGE))
    except ValueError:
        edge = None
    if command == "merge" and len(rest) % 2 == 1 and edge is not None and not set(options) - {"--merge-output", "--edge-buffer-m"}:
        spark = spark or SparkSession.builder.getOrCreate()
        try:
            path, n = run.merge_folder(spark, rest[0], options.get("--merge-output"), edge)
        except Exception as e:  # told by the exit code
            print(f"merge: {type(e).__name__}: {e}", file=sys.stderr)
            return batch.MERGE_FAILED
        print(f"{n} stems: {path}" if n else "0 stems: no file")
        return 0
    print(USAGE, file=sys.stderr)
    return batch.MISUSE


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
