"""The library's commands: `python -m loomtrace <command>`. Each is a row of a Spark job, printed as JSON.

A command that fails prints one line, `error: ...`, on standard error and ends with code 2; others end with 0.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomtrace.operators import json_schema
from loomtrace.operators.replay import decode, replay
from loomtrace.sources import bundles, scenario

PLACES = ("segment_no", "segment", "line_no", "position")


def check_contracts(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The schema documents of a folder, each of which must be one that can be compiled."""
    names = json_schema.load(spark, args.schemas).check()
    return {"valid": True, "schema_count": len(names), "schemas": names}


def simulate(spark: SparkSession, args: argparse.Namespace) -> dict:
    manifest = bundles.write_bundle(scenario.cold_start(spark), args.output, replace=args.replace)
    return {"bundle": args.output, "capture_id": manifest["capture_id"], "records": manifest["statistics"]["received_records"], "semantic_digest": manifest["semantic_digest"]}


def validate_bundle(spark: SparkSession, args: argparse.Namespace) -> dict:
    return bundles.bundle_summary(spark, args.bundle).first().asDict()


def replay_bundle(spark: SparkSession, args: argparse.Namespace) -> dict:
    """What a valid bundle decodes to; with --output its samples are written too, as canonical JSON lines in a folder of text files."""
    _, rows = bundles.load_bundle(spark, args.bundle)
    rows = rows.drop(*PLACES)
    summary = replay(rows).select("capture_id", "observations", "signal_samples", "signal_ids", "semantic_digest").first()
    if summary is None:
        raise bundles.BundleError("decoder", "the bundle holds no observation that can be decoded")
    if args.output:
        bundles.write_replay(decode(rows), args.output)
    return summary.asDict()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomtrace", description="Telemetry evidence on Spark.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(parent, name, run, *arguments, **about):
        made = parent.add_parser(name, **about)
        for flags, options in arguments:
            made.add_argument(*flags, **options)
        made.set_defaults(run=run)

    contracts = commands.add_parser("contracts", help="schema documents").add_subparsers(dest="subcommand", required=True)
    command(contracts, "check", check_contracts, (["--schemas"], {"required": True, "help": "folder of schema documents"}), help="check every schema of a folder")
    command(commands, "simulate", simulate, (["--scenario"], {"required": True, "choices": ["cold-start-idle"]}), (["--output"], {"required": True}), (["--replace"], {"action": "store_true"}), help="write the simulated capture")
    command(commands, "validate-bundle", validate_bundle, (["bundle"], {}), help="check a bundle: manifest, hashes, lines, order")
    command(commands, "replay", replay_bundle, (["bundle"], {}), (["--output"], {}), help="decode a valid bundle")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("loomtrace").config(map={"spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}).getOrCreate()
    try:
        found = args.run(spark, args)
    except (ValueError, OSError, PySparkException) as e:
        print(f"error: {(str(e) or type(e).__name__).splitlines()[0]}", file=sys.stderr)
        return 2
    print(json.dumps(found, indent=2, sort_keys=True))
    return 0
