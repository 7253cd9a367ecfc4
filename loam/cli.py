"""python -m loam.cli COMMAND FOLDER"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from loam.facade import Toolkit, Workspace

COMMANDS = {"health": "governance_health_check", "profile": None, "dedup": "governance_find_duplicates", "validate": "governance_validate", "freshness": "governance_check_freshness", "alerts": "governance_get_alerts", "profile-doc": "governance_profile_document"}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loam")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("folder")
    parser.add_argument("--path", help="the file for profile-doc")
    parser.add_argument("--remove", action="store_true", help="dedup: remove what is found")
    parser.add_argument("--semantic", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("loam").getOrCreate()
    workspace = Workspace(spark, args.folder)
    if args.command == "profile":
        workspace.profile_chunks().show(truncate=False)
        return 0
    kit, more = Toolkit(workspace), {}
    name = COMMANDS[args.command]
    if args.command == "dedup":
        name, more = ("governance_remove_duplicates" if args.remove else name), {"semantic": args.semantic}
    if args.command == "profile-doc":
        more = {"path": args.path}
    print(kit.call(name, **more))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
