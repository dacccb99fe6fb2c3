"""Commands: extract, curate, render, info, doctor."""

from __future__ import annotations

import argparse
import json
import shutil
import subprocess
import sys
from importlib.util import find_spec
from pathlib import Path

from termloom import config as settings
from termloom import logs


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("termloom").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def external_model(command: list[str], schema: str):
    """A model behind a command: it gets JSON with system, user and schema on standard input and gives JSON."""

    def ask(system: str, user: str) -> str:
        done = subprocess.run(command, input=json.dumps({"system": system, "user": user, "schema": json.loads(schema)}), capture_output=True, text=True)
        if done.returncode and not done.stdout.strip():
            raise SystemExit(f"the model's command failed: {done.stderr.strip()}")
        return done.stdout

    return ask


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="termloom", description=__doc__)
    top.add_argument("--config")
    top.add_argument("-C", "--chdir")
    top.add_argument("-q", "--quiet", action="store_true")
    top.add_argument("-v", "--verbose", action="count", default=0)
    top.add_argument("--color", choices=["auto", "always", "never"], default="auto")
    top.add_argument("--json", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract")
    e.add_argument("dir", nargs="?")
    e.add_argument("-o", "--output", default="candidates.yaml")
    c = sub.add_parser("curate")
    c.add_argument("candidates", nargs="?", default="candidates.yaml")
    c.add_argument("-o", "--output", default="terms.yaml")
    c.add_argument("--model-command", nargs="+", help="what to run for the model")
    c.add_argument("--full-rebuild", action="store_true")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--max-budget", type=float)
    r = sub.add_parser("render")
    r.add_argument("terms", nargs="?", default="terms.yaml")
    r.add_argument("--dir")
    r.add_argument("-o", "--output", default="rendered")
    r.add_argument("--main-only", action="store_true")
    r.add_argument("--no-glossary", action="store_true")
    r.add_argument("--spacing")
    sub.add_parser("info")
    sub.add_parser("doctor")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.chdir:
        import os

        os.chdir(args.chdir)
    conf = settings.load(".", args.config)
    logs.start(conf.log_level, args.quiet, args.verbose, conf.log_dir).info("command %s", args.command)
    result = globals()[f"do_{args.command}"](args, conf)
    if args.json:
        print(json.dumps(result))
    elif not args.quiet:
        print("\n".join(summary(result)), file=sys.stderr)
    return 0


def summary(result: dict, indent: str = "") -> list[str]:
    """A table of a command's result, names in one column, lists and nested results below their names."""
    width = max(map(len, result), default=0)
    lines = []
    for key, value in result.items():
        if isinstance(value, dict):
            lines += [f"{indent}{key}", *summary(value, indent + "  ")]
        elif isinstance(value, list):
            lines += [f"{indent}{key:<{width}}  {len(value)}", *(f"{indent}  {x}" for x in value)]
        elif value is not None:
            lines.append(f"{indent}{key:<{width}}  {value:.4g}" if isinstance(value, float) else f"{indent}{key:<{width}}  {value}")
    return lines


def do_extract(args, conf) -> dict:
    from termloom.plans import pipeline
    from termloom.scratch import materialise
    from termloom.sources import files

    spark, base = session(), args.dir or conf.source.dir
    found, number = pipeline.extract(spark, conf, base)
    found = materialise(found, "candidates")
    files.write_table(found, args.output, "candidates", version=pipeline.VERSION, generated=pipeline.now(), source_dir=str(base), document_count=number)
    return {"documents": number, "candidates": found.count(), "output": args.output}


def do_curate(args, conf) -> dict:
    from termloom.operators import validate
    from termloom.plans import pipeline
    from termloom.scratch import materialise
    from termloom.sources import files

    spark = session()
    if args.max_budget is not None:
        conf.curate.max_budget_usd = args.max_budget
    found = files.read_candidates(spark, args.candidates)
    prior = Path(args.output)
    incremental = prior.exists() and not args.full_rebuild
    mode = "incremental" if incremental else "full"
    if args.dry_run or not args.model_command:
        if not incremental:
            return {"mode": mode, **pipeline.gate(conf, pipeline.system_prompt(conf), pipeline.user_prompt(conf, pipeline.payload(found, conf)))}
        said = pipeline.difference(files.read_terms(spark, prior), found, conf)
        told = {"mode": mode, **{k: said[k] for k in ("new", "total", "ratio", "warning")}, "stale": len(said["stale"])}
        return told | (pipeline.gate(conf, said["prompt"], said["text"], delta=True) if said["new"] else {"input_tokens": 0, "first": 0.0, "cached": 0.0})
    model, notes = external_model(args.model_command, pipeline.output_schema(incremental)), {}
    terms = pipeline.curate_incremental(spark, files.read_terms(spark, prior), found, conf, model, notes) if incremental else pipeline.curate_full(spark, found, conf, model, notes)
    head = files._read(args.candidates)
    base, made = head.get("source_dir", "."), pipeline.now()
    terms = materialise(terms, "terms")
    number = terms.count()
    files.write_table(terms, prior, "terms", version=pipeline.VERSION, generated=made, source_dir=base, document_count=head.get("document_count", 0))
    logs.write_reasoning(prior.with_name(f"{prior.stem}-thinking.md"), notes.get("thinking", ""), made, incremental)
    suggested = [r.term for r in validate.without_places(terms).select("term").orderBy("term").collect()]
    result = {"mode": mode, "terms": number, "output": str(prior), "suggested": suggested}
    result |= {k: notes[k] for k in ("new", "total", "warning") if notes.get(k) is not None}
    if Path(base).is_dir() and files.list_files(base, conf.source.extensions, skip_errors=True):
        docs = files.with_prose(files.read_documents(spark, base, conf.source.extensions, skip_errors=True))
        report, names = pipeline.check(terms, docs, conf.source.extensions)
        result |= {"validation": report, "suggested_aliases": {f"{r.term} -> {r.alias}": r.file for r in names}}
    return result


def do_render(args, conf) -> dict:
    from termloom.plans import pipeline
    from termloom.sources import files

    spark = session()
    base = args.dir or files._read(args.terms).get("source_dir") or conf.source.dir
    terms = files.read_terms(spark, args.terms)
    return pipeline.render(spark, terms, base, args.output, conf.source.extensions, args.main_only, not args.no_glossary, args.spacing)


def do_info(args, conf) -> dict:
    return {"name": "termloom", "python": sys.version.split()[0], "source_dir": conf.source.dir}


def do_doctor(args, conf) -> dict:
    return {"java": shutil.which("java") or "missing", **{m: bool(find_spec(m)) for m in ("pyspark", "pyarrow", "pandas", "ahocorasick", "yaml")}}


if __name__ == "__main__":
    sys.exit(main())
