"""python -m terrafold.cli expand|extract|update|query|catch-up ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from terrafold.dataset import SEQNUM, TIMESTAMP, Busy, OsmDataset, writer_lock
from terrafold.progress import Progress, timed
from terrafold.region import Region, RegionError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terrafold")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("expand", help="build a dataset from an element file")
    x.add_argument("osm_file")
    x.add_argument("dataset")
    x = sub.add_parser("extract", help="write the elements of a region")
    x.add_argument("dataset")
    x.add_argument("output", help="a file; binary if it ends with .pbf, else XML")
    for o in ("bbox", "disc", "geojson", "poly", "region"):
        x.add_argument(f"--{o}")
    x.add_argument("--expand", type=int)
    x.add_argument("--noUserData", action="store_true")
    x.add_argument("--jsonOutput", action="store_true")
    x = sub.add_parser("update", help="apply a change file")
    x.add_argument("dataset")
    x.add_argument("osc_file")
    x.add_argument("seqnum")
    x.add_argument("timestamp")
    x.add_argument("--commit", action="store_true")
    x = sub.add_parser("query", help="look up an element, metadata or table sizes")
    x.add_argument("dataset")
    x.add_argument("what", nargs="?", choices=("node", "way", "relation", "timestamp", "seqnum"))
    x.add_argument("id", nargs="?", type=int)
    x = sub.add_parser("catch-up", help="apply a replication feed up to now")
    x.add_argument("dataset")
    x.add_argument("feed")
    x.add_argument("checkpoint")
    x = sub.add_parser("augdiff", help="write the augmented diff of a change file")
    x.add_argument("dataset")
    x.add_argument("osc_file")
    x.add_argument("output")
    return p


def joined(argv: list[str]) -> list[str]:
    """``--bbox -1,2,3,4`` as ``--bbox=-1,2,3,4``, since a value may begin with a minus sign."""
    out: list[str] = []
    for x in argv:
        if out and out[-1] in ("--bbox", "--disc"):
            out[-1] += f"={x}"
        else:
            out.append(x)
    return out


def tag_lines(tags) -> str:
    return "\n".join(f"{t['k']}={t['v']}" for t in tags or ())


def query(spark: SparkSession, a: argparse.Namespace) -> str:
    db = OsmDataset.open(spark, a.dataset)
    if a.what is None:
        sizes = [f"{r['table_name']}: {r['n']}" for r in db.stats().collect()]
        return "\n".join([*sizes, f"Timestamp: {db.get_metadata(TIMESTAMP)}", f"Sequence #: {db.get_metadata(SEQNUM)}"])
    if a.what in ("timestamp", "seqnum"):
        return db.get_metadata(TIMESTAMP if a.what == "timestamp" else SEQNUM)
    if a.id is None:
        raise SystemExit(f"query {a.what} needs an id")
    at = F.col("id") == a.id
    if a.what == "node":
        r = db.locations.where(at).join(db.nodes, "id", "left").first()
        if r is None:
            return "not found"
        placed = r["lat_i"] is not None and r["lon_i"] is not None
        at = f"{r['lat_i'] / 1e7:.7f} {r['lon_i'] / 1e7:.7f}" if placed else "undefined"
        return f"{at}\n{tag_lines(r['tags'])}".rstrip()
    r = (db.ways if a.what == "way" else db.relations).where(at).first()
    if r is None:
        return "not found"
    body = " ".join(map(str, r["nodes"] or ())) if a.what == "way" else "\n".join(f"{m['type']} {m['ref']} {m['role']}" for m in r["members"] or ())
    return f"{body}\n{tag_lines(r['tags'])}".rstrip()


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    from terrafold import coverer
    from terrafold.operators import extract as ex
    from terrafold.sources import pbfsink, xmlsink

    region = Region.from_options(a.bbox, a.disc, a.geojson, a.poly, a.region)
    db, progress = OsmDataset.open(spark, a.dataset), Progress(a.jsonOutput)
    cells = len(coverer.covering(region, a.expand))
    progress.start("Cells", cells)
    e = ex.extract(db, region, grow=a.expand, watch=lambda: progress.watch(spark, "Cells"))
    n = {r["set_name"]: r["n"] for r in e.counts().collect()}
    progress.start("Nodes", n["n"])
    progress.start("Elems", n["w"] + n["r"])
    keep = not a.noUserData
    sink = pbfsink if a.output.endswith(".pbf") else xmlsink
    with progress.watch(spark, "Nodes", "Elems"):
        sink.write(xmlsink.objects_of(e.nodes(keep), e.ways(keep), e.relations(keep)), a.output, ex.header(db, region))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(joined(sys.argv[1:] if argv is None else argv))
    spark = spark or SparkSession.builder.appName("terrafold").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    from terrafold.sources import xmlfiles

    try:
        with timed(a.command):
            if a.command == "expand":
                with writer_lock(a.dataset, spark):
                    xmlfiles.expand(spark, a.osm_file, a.dataset)
            elif a.command == "extract":
                extract(spark, a)
            elif a.command == "update":
                from terrafold.operators.update import apply_file

                xmlfiles.register(spark)
                changes = spark.read.format("changes_xml").option("seq", a.seqnum).load(a.osc_file)
                with writer_lock(a.dataset, spark):
                    apply_file(OsmDataset.open(spark, a.dataset), changes, a.dataset, a.seqnum, a.timestamp, a.commit)
            elif a.command == "query":
                print(query(spark, a))
            elif a.command == "catch-up":
                from terrafold.streaming.catchup import catch_up

                catch_up(spark, a.feed, a.dataset, a.checkpoint).awaitTermination()
            else:
                from terrafold.sources import augdiffxml

                xmlfiles.register(spark)
                changes = spark.read.format("changes_xml").load(a.osc_file)
                augdiffxml.write(OsmDataset.open(spark, a.dataset), changes, a.output)
    except (RegionError, Busy) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
