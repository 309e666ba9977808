"""Command line: ``python -m lexforge.cli OPERATION key=value ...``; exit 0 with rows, 1 without, 2 on errors."""

from __future__ import annotations

import json
import sys

from lexforge.plans.render import preamble, rows
from lexforge.plans.session import OPERATIONS, Session


def main(arguments: list[str]) -> int:
    options = dict(a.split("=", 1) for a in arguments[1:] if "=" in a)
    if not arguments or arguments[0] not in OPERATIONS or len(options) != len(arguments) - 1:
        print(f"usage: OPERATION key=value ...; operations: {', '.join(OPERATIONS)}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lexforge").getOrCreate()
    try:
        session = Session(spark, options.pop("root", "."))
        typed = {k: json.loads(v) if v[:1] in "[{" or v.lstrip("-").isdigit() or v in ("true", "false") else v for k, v in options.items()}
        page = getattr(session, arguments[0])(**typed)
    except (ValueError, TypeError, OSError) as error:
        print(error, file=sys.stderr)
        return 2
    for line in preamble(page):
        print(line, file=sys.stderr)
    for line in rows(page):
        print(line)
    return 0 if page.results else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
