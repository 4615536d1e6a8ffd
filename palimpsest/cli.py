"""Command line: ``python -m palimpsest.cli init|create|delete|list|rename|commit|checkout|diff|rollback|snapshots``."""

from __future__ import annotations

import argparse
import csv
import json
import sys

from pyspark.sql import SparkSession

from palimpsest.catalog import ArchiveManager, manager
from palimpsest.snapshots import SnapshotDescriptor, as_time
from palimpsest.sources.documents import delimiter_of, from_csv
from palimpsest.sources.sinks import write_csv


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="palimpsest", description="Version archives of tables.")
    top.add_argument("--basedir", help="folder of the catalog")
    top.add_argument("--database", help="SQLite file of the catalog")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *names: str) -> argparse.ArgumentParser:
        out = commands.add_parser(name, help=about)
        for n in names:
            out.add_argument(n)
        return out

    def csv_options(p):
        p.add_argument("--delimiter")
        p.add_argument("--quotechar", default='"')

    command("init", "make an empty catalog").add_argument("--replace", action="store_true")
    p = command("create", "make an archive", "name")
    p.add_argument("--pk", help="key columns, separated by commas")
    p.add_argument("--description")
    p.add_argument("--input", help="first snapshot, a CSV or TSV file")
    csv_options(p)
    command("delete", "delete an archive", "name")
    command("rename", "rename an archive", "name", "to")
    command("list", "list the archives").add_argument("--by", choices=["name", "created_at"], default="name")
    p = command("commit", "commit a CSV or TSV file", "name", "input")
    p.add_argument("--description")
    p.add_argument("--action", help="JSON object")
    p.add_argument("--valid-time")
    p.add_argument("--rename", action="append", default=[], metavar="OLD:NEW")
    csv_options(p)
    p = command("checkout", "write a version as CSV", "name", "output")
    p.add_argument("--version", type=int)
    p.add_argument("--single", action="store_true", help="one file, written by the driver row by row")
    p.add_argument("--gzip", action="store_true")
    csv_options(p)
    p = command("diff", "what changed between two versions", "name")
    p.add_argument("original", type=int)
    p.add_argument("new", type=int)
    command("rollback", "forget later versions", "name").add_argument("version", type=int)
    command("snapshots", "list the versions of an archive", "name")
    return top


def _find(catalog: ArchiveManager, name: str) -> str:
    entry = catalog.get_by_name(name)
    if entry is None:
        raise ValueError(f"unknown archive {name}")
    return entry.identifier


def _renames(given: list[str]) -> dict[str, str]:
    out = dict(x.split(":", 1) for x in given if ":" in x)
    if len(out) < len(given):
        raise ValueError("renames are given as OLD:NEW")
    return out


def _run(args, spark: SparkSession) -> None:
    catalog = manager(spark, args.basedir, args.database, args.command == "init" and args.replace)
    if args.command == "init":
        print(f"catalog at {catalog.basedir}")
    elif args.command == "create":
        key = [k.strip() for k in args.pk.split(",")] if args.pk else None
        doc = from_csv(spark, args.input, delim=args.delimiter, quotechar=args.quotechar, infer=True) if args.input else None
        print(f"created {args.name} as {catalog.create(args.name, args.description, key, doc).identifier}")
    elif args.command == "delete":
        catalog.delete(_find(catalog, args.name))
        print(f"deleted {args.name}")
    elif args.command == "rename":
        catalog.rename(_find(catalog, args.name), args.to)
        print(f"renamed {args.name} to {args.to}")
    elif args.command == "list":
        for d in catalog.list(args.by):
            print("\t".join([d.name, d.identifier, d.created_at, ",".join(d.primary_key or ()), d.description]))
    elif args.command == "commit":
        descriptor = SnapshotDescriptor(args.description, as_time(args.valid_time) if args.valid_time else None, json.loads(args.action) if args.action else None)
        how = {"delim": args.delimiter, "quotechar": args.quotechar, "infer": True}
        print(f"committed version {catalog.commit(_find(catalog, args.name), args.input, descriptor, renamed=_renames(args.rename), **how).version}")
    elif args.command == "checkout":
        doc = catalog.get(_find(catalog, args.name)).document(args.version)
        if args.single:
            with open(args.output, "w", newline="", encoding="utf-8") as f:
                out = csv.writer(f, delimiter=delimiter_of(args.output, args.delimiter), quotechar=args.quotechar)
                out.writerow(doc.columns)
                for row in doc.df.orderBy("__pos").toLocalIterator():
                    out.writerow(["" if row[f"v_{i}"] is None else row[f"v_{i}"] for i in range(len(doc.columns))])
        else:
            write_csv(doc, args.output, args.delimiter, quotechar=args.quotechar, gzip=args.gzip)
        print(f"wrote {args.output}")
    elif args.command == "diff":
        for part, counts in catalog.get(_find(catalog, args.name)).diff(args.original, args.new).describe().items():
            for what, n in counts.items():
                print(f"{part}\t{what}\t{n}")
    elif args.command == "rollback":
        catalog.get(_find(catalog, args.name)).rollback(args.version)
        print(f"rolled back to version {args.version}")
    elif args.command == "snapshots":
        for s in catalog.get(_find(catalog, args.name)).snapshots():
            print("\t".join([str(s.version), s.valid_time.isoformat(), s.transaction_time.isoformat(), s.description]))


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("palimpsest").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        _run(args, spark)
    except (ValueError, OSError, RuntimeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
