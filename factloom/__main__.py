"""Command line: ``python -m factloom check ROOT``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="factloom", description="Analyse a source tree.")
    commands = parser.add_subparsers(dest="command", required=True)
    check = commands.add_parser("check")
    check.add_argument("root")
    check.add_argument("--format", choices=("text", "json"), default="text")
    check.add_argument("--color", choices=("auto", "always", "never"), default="auto")
    check.add_argument("--progress", choices=("auto", "always", "never"), default="auto")
    check.add_argument("--settings")
    check.add_argument("--profile")
    check.add_argument("--tables", help="write every relation as JSON lines below this folder, by the executors")
    check.add_argument("--report", help="write a compact Markdown report here")
    check.add_argument("--full-report", help="write a Markdown report with all inventories here")
    try:
        options = parser.parse_args(arguments)
    except SystemExit as e:
        return int(e.code or 0) and 2
    from factloom.config.settings import SettingsError, load
    from factloom.plans.analysis import check as run
    from factloom.report import render

    try:
        settings = load(options.settings, options.profile)
    except (SettingsError, OSError, ValueError) as e:
        print(f"settings: {e}", file=sys.stderr)
        return 2
    say = render.progress(options.progress)
    spark = SparkSession.builder.appName("factloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    say("analysing")
    report = run(spark, options.root, settings)
    say("reporting")
    if options.format == "json":
        render.write_json(report, sys.stdout)
    else:
        render.write_text(report, sys.stdout, settings, options.color)
    if options.tables:
        render.write_json_tables(report, options.tables)
    for path, full in ((options.report, False), (options.full_report, True)):
        if path:
            with open(path, "w", encoding="utf-8") as out:
                render.write_markdown(report, out, settings, full)
    return report.exit_code


if __name__ == "__main__":
    sys.exit(main())
