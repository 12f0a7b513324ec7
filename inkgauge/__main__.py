"""python -m inkgauge FOLDER [-m fast|thorough] [--preset P] [-j]: exit 0 when all images pass."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.engine import QualityEngine
from .sources.files import read_images


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="inkgauge", description="Judge the quality of document images.")
    p.add_argument("path")
    p.add_argument("-m", "--mode", default="fast", choices=["fast", "thorough"])
    p.add_argument("-p", "--pages", default="1")
    p.add_argument("--preset", default="auto", choices=["auto", "document", "receipt", "card"])
    p.add_argument("-j", "--json", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("inkgauge").getOrCreate()
    results = QualityEngine(mode=a.mode, preset=a.preset, pages=a.pages).check(read_images(spark, a.path)).select("path", "pass", "score", "confidence", "preset", "issues", "metadata", "status")
    good = True
    for r in results.withColumn("json", F.to_json(F.struct("*"))).toLocalIterator():
        good &= r["pass"] and r["status"] == "ok"
        print(r["json"] if a.json else f"{'PASS' if r['pass'] else 'FAIL'} {r['score']:.2f} {r['path']}" + "".join(f"\n  {i['code']}: {i['guidance']}" for i in r["issues"]))
    return 0 if good else 1


if __name__ == "__main__":
    sys.exit(main())
