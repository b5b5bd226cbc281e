"""python -m palimpsest: save, list, restore and delete snapshots of a folder, or serve tools."""

from __future__ import annotations

import argparse
import json
import os
import sys


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    p.add_argument("--store", help="folder of the stores (default: in the home folder)")
    p.add_argument("--root", default=".", help="the folder to record")
    p.add_argument("--progress", action="store_true", help="tells steps on the error output")
    sub = p.add_subparsers(dest="command", required=True)
    save = sub.add_parser("save")
    save.add_argument("-m", "--message")
    save.add_argument("--include-deps", action="store_true")
    save.add_argument("--pack-chunk-bytes", type=int)
    listed = sub.add_parser("list")
    listed.add_argument("-n", "--limit", type=int)
    listed.add_argument("--full", action="store_true")
    restore = sub.add_parser("restore")
    restore.add_argument("ref", nargs="?")
    restore.add_argument("--pick", type=int, help="the number of a snapshot in the list, from 1")
    restore.add_argument("--dry-run", action="store_true")
    delete = sub.add_parser("delete")
    delete.add_argument("id")
    sub.add_parser("serve", help="answers tool requests, JSON lines on the standard input")
    return p.parse_args(argv)


def chosen(spark, args, root: str) -> str:
    """The snapshot that is meant: by reference or number; on a terminal without either, by a choice from the list."""
    from . import api
    from .operators.catalog import display

    if args.ref or args.pick is None and not sys.stdin.isatty():
        return args.ref or "latest"
    if args.pick is None:
        for k, row in enumerate(display(api.store_of(spark, root, args.store).list()).toLocalIterator(), 1):
            print(f"{k:3} {row.short_id} {row.created} {row.message}", file=sys.stderr)
    answer = args.pick if args.pick is not None else input("number: ")
    return api.nth(spark, root, int(answer), home=args.store)


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    from pyspark.sql import SparkSession

    from . import api
    from .operators.catalog import display
    from .plans.errors import StoreError

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    root = os.path.abspath(args.root)
    progress = (lambda step, figures: print(json.dumps({"step": step, **figures}), file=sys.stderr)) if args.progress else None
    try:
        if args.command == "save":
            print(json.dumps(api.save(spark, root, message=args.message, include_deps=args.include_deps, pack_chunk_bytes=args.pack_chunk_bytes, home=args.store, progress=progress)))
        elif args.command == "list":
            found = api.store_of(spark, root, args.store).list(args.limit)
            for row in (found if args.full else display(found)).toLocalIterator():
                print(json.dumps(row.asDict(), default=str))
        elif args.command == "restore":
            print(json.dumps(api.restore(spark, root, chosen(spark, args, root), dry_run=args.dry_run, home=args.store, progress=progress)))
        elif args.command == "delete":
            print(json.dumps(api.delete(spark, root, args.id, home=args.store)))
        else:
            api.serve(spark, sys.stdin, sys.stdout, args.store)
    except StoreError as e:
        print(json.dumps({"error": f"{type(e).__name__}: {e}"}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
