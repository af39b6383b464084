"""python -m codeloom COMMAND DIRECTORY [ARGUMENT] [--limit N]: prints rows as JSON lines.

Commands: status, impact SYMBOL_KEY, search QUERY, verify, baseline, changes, orphans, communities, or the name of a query.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from codeloom.workspace import Workspace


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="codeloom", description=__doc__)
    p.add_argument("command")
    p.add_argument("directory")
    p.add_argument("argument", nargs="?")
    p.add_argument("--limit", type=int, default=100)
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    w = Workspace(spark, a.directory)
    if a.command in ("impact", "search"):
        if a.argument is None:
            p.error(f"{a.command} needs an argument")
        found = getattr(w, a.command)(a.argument)
    elif a.command in ("status", "verify", "baseline", "changes", "orphans", "communities"):
        found = getattr(w, a.command)()
    else:
        from codeloom.plans import general_queries, record_queries, workspace_queries

        known = general_queries.QUERIES | workspace_queries.QUERIES | record_queries.QUERIES
        if a.command not in known:
            p.error(f"no such command or query: {a.command}")
        found = known[a.command](spark, a.directory)
    for name, df in (found if isinstance(found, dict) else {a.command: found}).items():
        print(f"# {name}")
        for line in df.limit(a.limit).toJSON().collect():  # at most --limit lines
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
