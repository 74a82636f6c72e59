"""Command line: ``python -m gridmend.cli detect|schema|audit PATH``. Exit codes: 0 clean, 1 high confidence, 2 lower, 3 error."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridmend.operators.corrections import capped_report, json_report
from gridmend.operators.schema import fields, table_schemas
from gridmend.plans.detect import audit_summary, detect, exit_code, too_large
from gridmend.sources.readers import MAX_BYTES, read_files


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gridmend")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("detect", "schema", "audit"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--json", action="store_true")
        s.add_argument("--recursive", action="store_true")
        s.add_argument("--max-per-band", type=int, default=20)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("gridmend").getOrCreate()
    try:
        got = read_files(spark, args.path, recursive=args.recursive)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        print(f"no such file or folder: {args.path}", file=sys.stderr)
        return 3
    # the parsed cells feed several aggregations; parsing is the dear part
    cells = got["cells"].persist()
    found = detect(cells, columns=got["columns"], row_context_boost=args.command != "schema")
    large = too_large(got["too_large"], MAX_BYTES)
    found.suspicions = found.suspicions.unionByName(large)
    errors = [r.asDict() for r in got["errors"].toLocalIterator()]
    if args.command == "schema":
        for r in table_schemas(fields(found.enriched, found.profile)).toLocalIterator():
            print(r.schema)
        return 3 if errors else 0
    if args.command == "audit":
        files = got["files"].select("file_id").unionByName(large.select("file_id"))
        rows = [r.asDict() for r in audit_summary(found.suspicions, files).orderBy("file_id").toLocalIterator()]
        print(json.dumps({"files": rows, "errors": errors}, indent=2))
        # a file that can't be read is reported, but must not hide what was found in the others
        return 1 if any(r["high"] for r in rows) else 2 if any(r["medium"] for r in rows) else 0
    else:
        lines = json_report(found.suspicions) if args.json else capped_report(found.suspicions, args.max_per_band).select(
            F.concat_ws("  ", "band", "sheet", "col", "row_id", "value_repr", "kind", "suggestion", "confidence").alias("json"))
        if not args.json:
            print("band  sheet  column  row  value  kind  suggestion  confidence")
        for r in lines.toLocalIterator():
            print(r.json)
        worst = [r.code for r in exit_code(found.suspicions).toLocalIterator()]
    return 3 if errors else 1 if 1 in worst else 2 if 2 in worst else 0


if __name__ == "__main__":
    sys.exit(main())
