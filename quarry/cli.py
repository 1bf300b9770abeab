"""Archives from the command line: ``python -m quarry.cli encode FOLDER ARCHIVES`` and ``decode ARCHIVES FOLDER``, run by spark-submit or alone."""

from __future__ import annotations

import argparse
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from .functions import strings as S
from .functions.codecs import ALIASES, CODES
from .session import session
from .sources import archive, files


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__)
    names = sorted({"auto", *CODES, *ALIASES})
    commands = parser.add_subparsers(dest="command", required=True)
    encode = commands.add_parser("encode", help="write the files of a folder into archives")
    encode.add_argument("--codec", default="auto", choices=names)
    encode.add_argument("--secondary", default="none", choices=["auto", "none", "rle", "lz77", "lz78"])
    encode.add_argument("--raw", action="store_true", help="store files as they are")
    encode.add_argument("--archives", type=int, default=1, help="how many archives the files are dealt over")
    for command in (encode, commands.add_parser("decode", help="write the files of archives into a folder"), commands.add_parser("report", help="write a table of sizes by bit depth as CSV")):
        command.add_argument("source")
        command.add_argument("target")
    return parser.parse_args(argv)


def unpack(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["filename"], batch["content"], strict=True):
                path = os.path.normpath(os.path.join(folder, name))
                if not path.startswith(os.path.normpath(folder) + os.sep):
                    raise ValueError(f"the file {name!r} would leave the folder")
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(content)
            yield batch[["filename"]]

    return run


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    spark = session(app="quarry")
    archive.register(spark)
    if args.command == "decode":
        return 0 * spark.read.format("quarry_archive").load(args.source).mapInPandas(unpack(args.target), "filename string").count()
    found = files.whole_files(spark, args.source)
    root = found.select("path").limit(1).selectExpr("regexp_extract(path, '^([a-z]+:/*)', 1) AS scheme").first()
    base = f"{root.scheme.rstrip('/')}{os.path.abspath(args.source)}" if root else args.source
    named = found.select(S.relative(F.regexp_replace("path", "^([a-z]+:)/*", "$1/"), F.lit(base)).alias("filename"), "content")
    if args.command == "report":
        from .functions.bytes import bit_depth_report

        bit_depth_report(named, "filename", "content").coalesce(1).write.mode("overwrite").option("header", True).csv(args.target)
        return 0
    named.repartition(args.archives).write.format("quarry_archive").options(codec=args.codec, secondary=args.secondary, raw=str(args.raw).lower()).mode("append").save(args.target)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
