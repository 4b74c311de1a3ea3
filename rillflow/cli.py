"""Command line: ``python -m rillflow.cli [--root DIR] [--table NAME=PATH] [--mode csv] [QUERY]``; without a query, a prompt."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .engine import Engine
from .lang.lexer import QueryError
from .output import lines


class Shell:
    def __init__(self, engine: Engine, mode: str = "table", out=sys.stdout):
        self.engine, self.mode, self.out, self.timer = engine, mode, out, False

    def show(self, text: str) -> None:
        began = time.time()
        for line in lines(self.engine.frame(text), self.mode):
            print(line, file=self.out)
        if self.timer:
            print(f"{time.time() - began:.3f} s", file=self.out)

    def command(self, text: str) -> bool:
        """A line of the prompt; False ends it."""
        word, _, rest = text.strip().partition(" ")
        rest = rest.strip().strip("\"'")
        if word in (".quit", ".exit"):
            return False
        if word == ".mode":
            self.mode = rest
        elif word == ".timer":
            self.timer = rest != "off"
        elif word == ".output":
            self.out = sys.stdout if rest in ("", "stdout") else open(rest, "w", encoding="utf-8")
        elif word == ".open":
            self.engine = Engine(self.engine.spark, rest)
        elif word == ".read":
            with open(rest, encoding="utf-8") as f:
                self.show(f.read())
        elif word == ".schema":
            self.show(f"{rest} | getschema" if rest else ".show tables")
        elif text.strip():
            self.show(text)
        return True


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="rillflow")
    p.add_argument("query", nargs="?")
    p.add_argument("--root")
    p.add_argument("--table", action="append", default=[], metavar="NAME=PATH")
    p.add_argument("--mode", default="table", choices=("table", "csv", "tsv", "json", "jsonl"))
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("rillflow").getOrCreate()
    engine = Engine(spark, a.root)
    for x in a.table:
        name, _, path = x.partition("=")
        engine.register_parquet(name, path)
    shell = Shell(engine, a.mode)
    texts = [a.query] if a.query else [sys.stdin.read()] if not sys.stdin.isatty() else iter(lambda: input("> "), None)
    for text in texts:
        try:
            if not shell.command(text):
                break
        except (QueryError, ValueError) as e:
            print(f"error: {e}", file=sys.stderr)
            if a.query:
                return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
