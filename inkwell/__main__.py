"""python -m inkwell FILE: the file as Markdown; --bench N times N conversions."""

from __future__ import annotations

import argparse
import statistics
import sys
import time

from .sources.convert import markdown
from .sources.model import ConvertError


def main() -> int:
    parser = argparse.ArgumentParser(prog="inkwell")
    parser.add_argument("file")
    parser.add_argument("--bench", type=int, default=0)
    given = parser.parse_args()
    try:
        with open(given.file, "rb") as f:
            data = f.read()
        if given.bench:
            took = []
            for _ in range(given.bench):
                began = time.perf_counter()
                markdown(data, given.file)
                took.append(1000 * (time.perf_counter() - began))
            took.sort()
            print(f"median {statistics.median(took):.3f} ms, p95 {took[int(0.95 * (len(took) - 1))]:.3f} ms, best {took[0]:.3f} ms")
        else:
            sys.stdout.write(markdown(data, given.file)[1])
    except (ConvertError, OSError) as e:
        print(f"{given.file}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
