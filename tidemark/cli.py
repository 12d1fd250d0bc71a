"""Operator commands over a unit store: ls, show, dirty, invalidate, evict, purge, stats."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import provenance as O
from .operators.stats import store_stats
from .sources.store import UnitStore


def _index(store: UnitStore):
    return O.artifact_index(store.all().select("id", "provenance.*"))


def ls(store: UnitStore, args: argparse.Namespace) -> int:
    ids = T.artifact_ids(F.col("provenance.source_spans"), F.col("provenance.observed_edges"))
    rows = store.all().orderBy(F.desc("last_access")).select(
        "status", "hits", T.age(F.lit(time.time()) - F.col("freshness_epoch")).alias("age"), F.size(ids).alias("sources"), "id", T.preview(F.col("query")).alias("q")
    )
    empty = True
    for r in rows.toLocalIterator():
        if empty:
            print(f"{'STATUS':7} {'HITS':>4} {'AGE':>4} {'SRC':>3}  {'ID':20}  QUERY")
        empty = False
        print(f"{r['status']:7} {r['hits']:>4} {r['age']:>4} {r['sources']:>3}  {r['id']:20}  {r['q']}")
    if empty:
        print("(the store is empty)")
    return 0


def show(store: UnitStore, args: argparse.Namespace) -> int:
    found = store.get(args.id).drop("place").collect()
    if not found:
        print(f"no unit {args.id}", file=sys.stderr)
        return 1
    unit = found[0].asDict(recursive=True)
    if args.json:
        print(json.dumps(unit))
        return 0
    print(f"{unit['id']}  {unit['status']}  {unit['query']}\n{json.dumps(json.loads(unit['understanding']), indent=2)}")
    for c in unit["evidence"] or []:
        print(f"  {c['artifact_id']}: {c['text'] if args.full else c['text'][:200]}")
    return 0


def _mark(store: UnitStore, ids) -> int:
    units = store.all().join(ids, "id").withColumn("seq", F.col("place.first_seq")).drop("place").withColumn("status", F.lit("dirty"))
    n = units.count()
    if n:
        store.put(units)
    return n


def dirty(store: UnitStore, args: argparse.Namespace) -> int:
    n = _mark(store, store.get(args.id).select("id"))
    print(f"{n} unit(s) dirty")
    return 0 if n else 1


def invalidate(store: UnitStore, args: argparse.Namespace) -> int:
    """Every unit that holds the artifact, whatever its content."""
    n = _mark(store, _index(store).where(F.col("artifact_id") == args.artifact).select(F.col("unit").alias("id")))
    print(f"{n} unit(s) dirty")
    return 0


def evict(store: UnitStore, args: argparse.Namespace) -> int:
    if not store.get(args.id).count():
        print(f"no unit {args.id}", file=sys.stderr)
        return 1
    store.delete([args.id])
    print("1 unit removed")
    return 0


def purge(store: UnitStore, args: argparse.Namespace) -> int:
    if not args.yes:
        print("this removes all units: say --yes", file=sys.stderr)
        return 1
    n = len(store)
    if n:
        store.delete(store.all().select("id"))
    print(f"{n} unit(s) removed")
    return 0


def stats(store: UnitStore, args: argparse.Namespace) -> int:
    r = store_stats(store.all(), _index(store)).first()
    print("\n".join(f"{k}: {r[k]}" for k in ("units", "fresh", "dirty", "artifacts")))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--db", default=os.environ.get("TIDEMARK_DB", "tidemark-units"), help="folder of the unit store")
    sub = p.add_subparsers(dest="command", required=True)
    for f, names in ((ls, ()), (show, ("id",)), (dirty, ("id",)), (invalidate, ("artifact",)), (evict, ("id",)), (purge, ()), (stats, ())):
        c = sub.add_parser(f.__name__)
        c.set_defaults(run=f)
        for n in names:
            c.add_argument(n)
        if f is show:
            c.add_argument("--full", action="store_true")
            c.add_argument("--json", action="store_true")
        if f is purge:
            c.add_argument("--yes", action="store_true")
    args = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    return args.run(UnitStore(spark, args.db), args)


if __name__ == "__main__":
    sys.exit(main())
