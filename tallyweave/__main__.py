"""python -m tallyweave INBOX OUT: one run over an inbox. Exit 0: done; 1: the run failed; 2: wrong call; 130: interrupted."""

from __future__ import annotations

import datetime
import json
import sys
import traceback


def main(args: list[str]) -> int:
    if len(args) != 2:
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from .plans import run

    now = datetime.datetime.now(datetime.UTC)
    try:
        spark = SparkSession.builder.appName("tallyweave").getOrCreate()
        result = run.process(spark, args[0], f"{args[1]}/staging", now.date().isoformat(), now.isoformat(timespec="seconds"))
        run.publish(result, args[1], now.strftime("%Y%m%d-%H%M%S"), now.isoformat(timespec="seconds"))
        print(json.dumps(run.totals(result), default=str))
    except KeyboardInterrupt:
        return 130
    except Exception:
        traceback.print_exc()
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
