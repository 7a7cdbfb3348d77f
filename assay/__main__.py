"""Command line: python -m assay run|validate --config FILE --out FOLDER [--kb --queries --answers --llm-calls --live --batch-tokens N]. Exit code 0 is good, 1 names issues."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from assay.operators.providers import live_call
from assay.operators.validate import ERROR
from assay.plans.config import ConfigError, defaults, load_config
from assay.plans.pipeline import run_files
from assay.plans.stored import artifact_paths, stored_run_issues
from assay.sources.inputs import InputError, load_inputs


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    ask = argparse.ArgumentParser(prog="assay", description=__doc__)
    ask.add_argument("step", choices=("run", "validate"))
    ask.add_argument("--config", help="YAML file; the defaults without one")
    ask.add_argument("--out", default="out", help="folder of the artifacts")
    ask.add_argument("--live", action="store_true", help="ask the provider that the configuration names")
    ask.add_argument("--batch-tokens", type=int, help="reviews by prompts of so many tokens")
    for name in ("kb", "queries", "answers", "llm-calls"):
        ask.add_argument(f"--{name}")
    given = ask.parse_args(arguments)
    try:
        config = load_config(given.config) if given.config else defaults()
    except ConfigError as error:
        print(error, file=sys.stderr)
        return 1
    named = config["paths"]
    paths = {"kb": given.kb or named.get("kb", "kb.json"), "queries": given.queries or named.get("queries", "queries.json"), "answers": given.answers or named.get("candidate_answers", "candidate_answers.json"), "llm_calls": given.llm_calls or named.get("llm_calls", "llm_calls.jsonl")}
    spark = spark or SparkSession.builder.appName("assay").getOrCreate()
    try:
        if given.step == "run":
            run = run_files(spark, paths, given.out, config, live_call() if given.live else None, given.batch_tokens)
            print(f"selected variant: {run.decision.first().selected_variant or 'none'}; artifacts in {given.out}")
            return 0
        inputs = load_inputs(spark, paths["kb"], paths["queries"], paths["answers"])
    except InputError as error:
        print(f"the inputs can't be used:\n{error}", file=sys.stderr)
        return 1
    errors = stored_run_issues(spark, inputs, artifact_paths(given.out, paths["llm_calls"]), config).where(f"severity = '{ERROR}'").orderBy("code", "location").collect()
    for n, r in enumerate(errors, 1):
        print(f"{n}. {r.code} {r.location}: {r.message}", file=sys.stderr)
    print("the stored run holds" if not errors else f"{len(errors)} issues", file=sys.stderr if errors else sys.stdout)
    return int(bool(errors))


if __name__ == "__main__":
    raise SystemExit(main())
