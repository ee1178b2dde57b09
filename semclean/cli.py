"""Command line: run a payload, scrub, clean or extract files, look after models, or a small shell."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import dataclass
from typing import Any, TextIO

from pydantic import BaseModel

from .config import load_config
from .operators.extract import extract_one
from .operators.scrub import scrub
from .plans.schema import model_from_fields
from .providers import OllamaProvider, create_provider

MODES = ("clean", "extract", "scrub")
HELP = "/mode clean|extract|scrub   /schema name:type ...   /instruction TEXT   /model NAME   /help   /quit"


@dataclass
class State:
    mode: str = "clean"
    schema: type[BaseModel] | None = None
    instruction: str | None = None
    model: str | None = None
    host: str | None = None


def command(line: str, state: State, out: TextIO) -> bool:
    """Carry out a line that begins with a slash; True to leave."""
    name, _, arg = line.strip().partition(" ")
    arg = arg.strip()
    match name.lower():
        case "/quit" | "/exit" | "/q":
            return True
        case "/help":
            print(HELP, file=out)
        case "/mode" if arg.lower() in MODES:
            state.mode = arg.lower()
            print(f"mode: {state.mode}", file=out)
        case "/mode":
            print(f"Unknown mode '{arg}'. Choose from: {', '.join(MODES)}", file=out)
        case "/schema":
            try:
                state.schema = model_from_fields(arg.split())
                print(f"schema: {', '.join(state.schema.model_fields)}", file=out)
            except ValueError as why:
                print(why, file=out)
        case "/instruction":
            state.instruction = arg or None
            print("instruction set" if arg else "instruction cleared", file=out)
        case "/model" if arg:
            state.model = arg
            print(f"model: {arg}", file=out)
        case "/model":
            print("Usage: /model NAME", file=out)
        case _:
            print(f"Unknown command '{name}'. Type /help.", file=out)
    return False


def execute(text: str, state: State) -> Any:
    """A line of text through the operator of the mode."""
    config = load_config(model=state.model, host=state.host)
    provider = create_provider(**config.model_dump())
    if state.mode == "scrub":
        return scrub(text, provider=provider)
    if state.mode == "extract":
        if state.schema is None:
            return "Set a schema first: /schema name:type ..."
        return extract_one(text, state.schema, state.instruction or "Extract the fields.", provider).model_dump_json()
    return json.dumps(provider.clean_batch([text], state.instruction or "")[text])


def shell(state: State, source: TextIO, out: TextIO) -> None:
    for line in source:
        if not line.strip():
            continue
        if line.startswith("/"):
            if command(line, state, out):
                return
            continue
        try:
            print(execute(line.rstrip("\n"), state), file=out)
        except Exception as why:
            print(f"Error: {why}", file=out)


def _files(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from .operators.clean import clean
    from .operators.extract import extract_compiled

    spark = SparkSession.builder.getOrCreate()
    df = spark.read.format(args.format).options(header=True, inferSchema=True).load(args.input) if args.format == "csv" else spark.read.format(args.format).load(args.input)
    if args.command == "scrub":
        out = scrub(df, args.strategies, args.mode, target_col=args.column)
    elif args.command == "clean":
        out = clean(df, args.column)
    else:
        out = extract_compiled(df, args.column, model_from_fields(args.schema))
    out.write.mode("overwrite").parquet(args.output)
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="semclean")
    subs = top.add_subparsers(dest="command", required=True)
    subs.add_parser("run", help="a JSON payload from standard input")
    for name in ("scrub", "clean", "extract"):
        sub = subs.add_parser(name)
        sub.add_argument("input")
        sub.add_argument("output")
        sub.add_argument("--column", required=True)
        sub.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
        if name == "scrub":
            sub.add_argument("--strategies", nargs="+", default=["phone", "email"])
            sub.add_argument("--mode", default="mask", choices=["mask", "fake"])
        if name == "extract":
            sub.add_argument("--schema", nargs="+", required=True, metavar="NAME:TYPE")
    sub = subs.add_parser("shell")
    sub.add_argument("--mode", default="clean", choices=MODES)
    sub.add_argument("--model")
    sub.add_argument("--host")
    sub = subs.add_parser("model")
    sub.add_argument("action", choices=["status", "pull"])
    sub.add_argument("name", nargs="?")
    sub.add_argument("--host", default="http://localhost:11434")
    args = top.parse_args(argv)
    if args.command == "run":
        from .sources.runner import main as run

        return run()
    if args.command == "shell":
        shell(State(mode=args.mode, model=args.model, host=args.host), sys.stdin, sys.stdout)
        return 0
    if args.command == "model":
        server = OllamaProvider(model=args.name or "phi3", host=args.host)
        if not server.alive():
            print(f"No model server at {args.host}")
            return 1
        if args.action == "status":
            print("\n".join(server.models()))
        else:
            for report in server.pull():
                print(report.get("status", ""))
        return 0
    return _files(args)


if __name__ == "__main__":
    sys.exit(main())
