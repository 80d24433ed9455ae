"""Command line: build a store, make a bundle, check it, look things up."""

from __future__ import annotations

import argparse
import sys

from .plans.build import build, build_bundle, build_sections, tokenize, verify_sections
from .plans.gazetteer import Gazetteer
from .session import session
from .sources.bundle import SECTIONS, composition, faults, read_section
from .sources.store import vacuum


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="atlasframe")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("build", help="dumps to a Parquet store")
    p.add_argument("country")
    p.add_argument("geoname")
    p.add_argument("admin1")
    p.add_argument("store")
    p.add_argument("--vocab-size", type=int, default=1000)
    p.add_argument("--keep-cities-without-region", action="store_true")
    p.add_argument("--overwrite", action="store_true", help="replace a store that is there; else it asks, or fails where nobody can answer")
    p = commands.add_parser("tokenize", help="a store's tables with names as tokens, to Parquet")
    p.add_argument("store")
    p.add_argument("output")
    p.add_argument("--keep-original", action="store_true", help="keep the names beside their tokens")
    p.add_argument("--token-format", choices=("blob", "csv"), default="blob")
    p = commands.add_parser("bundle", help="a store to a single file")
    p.add_argument("store")
    p.add_argument("output")
    p = commands.add_parser("columns", help="a store to six column files")
    p.add_argument("store")
    p.add_argument("folder")
    p.add_argument("--verify", action="store_true", help="decode the files again and compare")
    p = commands.add_parser("decode", help="read column files alone: how many values each holds")
    p.add_argument("folder")
    p = commands.add_parser("sizes", help="what a bundle's bytes hold")
    p.add_argument("bundle")
    p = commands.add_parser("verify", help="check a bundle's structure")
    p.add_argument("bundle")
    p = commands.add_parser("lookup", help="a city by its key, or cities by a prefix")
    p.add_argument("store")
    p.add_argument("key")
    p.add_argument("--prefix", action="store_true")
    p.add_argument("--limit", type=int, default=50)
    p.add_argument("--bundle", action="store_true", help="STORE is a bundle; only the blocks that can hold the key are read")
    p.add_argument("--by", choices=("country_id", "region_id", "city_name"), help="the key is one of this column")
    p = commands.add_parser("search", help="places by words, phrases, prefixes, NEAR, NOT and OR")
    p.add_argument("store")
    p.add_argument("query")
    p.add_argument("--limit", type=int, default=50)
    p = commands.add_parser("vacuum", help="delete all but the last versions of a store")
    p.add_argument("store")
    p.add_argument("--keep", type=int, default=2)
    p = commands.add_parser("stats")
    p.add_argument("store")
    a = parser.parse_args(args)
    if a.command == "sizes":
        with open(a.bundle, "rb") as f:
            for part, n in composition(f.read()).items():
                print(f"{part}: {n:,}")
        return 0
    if a.command == "verify":
        found = [r["fault"] for r in faults(session(), a.bundle).limit(20).collect()]
        print("\n".join(found) or "ok")
        return int(bool(found))
    spark = session()
    if a.command == "build":
        source = {"country": a.country, "geoname": a.geoname, "admin1": a.admin1}
        make = lambda mode: print(build(spark, source, a.store, a.vocab_size, not a.keep_cities_without_region, mode))
        try:
            make("overwrite" if a.overwrite else "error")
        except FileExistsError as there:
            if not sys.stdin.isatty() or input(f"{there}. Overwrite? (y/N): ").lower() not in ("y", "yes"):
                print(f"{there}; nothing is changed")
                return 1
            make("overwrite")
    elif a.command == "tokenize":
        print(tokenize(spark, a.store, a.output, a.keep_original, a.token_format))
    elif a.command == "decode":
        for name in SECTIONS:
            print(f"{name}: {read_section(spark, a.folder, name).count():,}")
    elif a.command == "columns":
        print(build_sections(spark, a.store, a.folder))
        if a.verify:
            found = verify_sections(spark, a.store, a.folder)
            print(found)
            return int(any(found.values()))
    elif a.command == "bundle":
        print(build_bundle(spark, a.store, a.output), "bytes")
    elif a.command == "stats":
        print(Gazetteer.load(spark, a.store).stats())
    elif a.command == "vacuum":
        print(len(vacuum(spark, a.store, a.keep)), "versions deleted")
    elif a.command == "search":
        for r in Gazetteer.load(spark, a.store).search_text(a.query).orderBy("longname").limit(a.limit).toLocalIterator():
            print(r["geonameid"], r["longname"])
    else:
        g = Gazetteer.load_bundle(spark, a.store) if a.bundle else Gazetteer.load(spark, a.store)
        if a.prefix or a.by:
            found = g.find_by_prefix(a.key, a.limit) if a.prefix else g.cities_with(a.by, a.key if a.by == "city_name" else int(a.key)).orderBy("geohash").limit(a.limit)
            for r in found.toLocalIterator():
                print(r["geohash"], r["city_name"])
        else:
            print(g.city_label(a.key))
    return 0


if __name__ == "__main__":
    sys.exit(main())
