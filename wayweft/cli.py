"""Command line: python -m wayweft.cli cross-check --project Town --epsg 32610 --city streets.geojson --osm town.osm"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

from pyspark.sql import SparkSession

from wayweft.plans.job import ConflationJob, berkeley_network, rlis_network
from wayweft.sources import fetch, tables
from wayweft.sources.srs import SRS

STYLES = {"berkeley": berkeley_network, "rlis": rlis_network}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wayweft", description="Conflation of street networks on Spark")
    p.add_argument("task", choices=("cross-check", "osm-vs-base"), help="city against OSM, or OSM against its state before the fixes")
    p.add_argument("--project", required=True)
    p.add_argument("--epsg", type=int, help="reference system of the city data")
    p.add_argument("--proj4", help="the same as proj4 text")
    p.add_argument("--srs-url", help="the same as the address of a reference site")
    p.add_argument("--units", choices=("meters", "feet"))
    p.add_argument("--bbox", nargs=4, type=float, metavar=("XMIN", "YMIN", "XMAX", "YMAX"))
    p.add_argument("--style", choices=sorted(STYLES), default="berkeley", help="how the city names its streets")
    p.add_argument("--city", help="centerlines as .geojson or .shp")
    p.add_argument("--city-zip", help="archive that holds them")
    p.add_argument("--city-url", help="where it can be downloaded")
    p.add_argument("--osm", help="OSM data as .osm, .json or .pbf")
    p.add_argument("--osm-url", help="address of an Overpass server")
    p.add_argument("--base", help="OSM data before the fixes")
    p.add_argument("--base-url", help="where it can be downloaded")
    p.add_argument("--out", help="folder of the results")
    p.add_argument("--no-export", action="store_true", help="no GeoJSON of the networks")
    return p


def job_of(spark: SparkSession, args: argparse.Namespace, settings: dict) -> ConflationJob:
    """The job of an invocation; settings files say where results go and which database gets them too."""
    store = None
    for kind, flag in (("postgresql", "postgis"), ("sqlite", "spatialite")):
        if settings.get(f"{flag}_enabled"):
            given = {k: settings[f"{flag}_{n}"] for k, n in (("host", "host"), ("port", "port"), ("user", "user"), ("password", "password")) if settings.get(f"{flag}_{n}") is not None}
            store = tables.connect(spark, kind, database=settings.get(f"{flag}_dbname") or args.project, **given)
            break
    reference = SRS(url=args.srs_url, auth_name="EPSG" if args.epsg else None, auth_srid=args.epsg, units=args.units) if args.epsg or args.srs_url else None
    shape = (args.city or "").endswith(".shp")
    return ConflationJob(
        spark, args.project, reference=reference, proj4text=args.proj4, units=args.units, bbox=tuple(args.bbox) if args.bbox else None, out_dir=args.out or settings.get("out_dir") or f"data/{args.project}",
        store=store, export=not args.no_export, city_url=args.city_url, city_zip=args.city_zip, city_shp=args.city if shape else None, city_geojson=None if shape else args.city,
        centerline_to_network=STYLES[args.style], osm_url=args.osm_url, osm_file=args.osm, base_url=args.base_url, base_file=args.base,
    )


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a task and prints how many rows its report has."""
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    job = job_of(spark or SparkSession.builder.appName("wayweft").getOrCreate(), args, fetch.read_settings())
    n = job.names_cross_check() if args.task == "cross-check" else job.names_osm_vs_base()
    print(f"{n} rows in {job.out_dir}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
