"""Command line of the pipelines: python -m plenumspark COMMAND SOURCE TARGET [options]."""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Mapping

from pyspark.sql import SparkSession

from plenumspark import workflows

COMMANDS = {
    "text": workflows.extract_text, "tagged": workflows.extract_tagged, "speech-index": workflows.extract_speech_index, "terms": workflows.term_frequencies,
    "vrt": workflows.export_vrt, "index": workflows.build_corpus_index, "metadata": workflows.build_metadata_files,
}


def read_options(path: str, environment: Mapping[str, str] | None = None, prefix: str = "PLENUM_") -> dict:
    """The options of a JSON or, with PyYAML at hand, YAML file. Dotted names are nested ones; an environment variable PREFIX_A__B overrides a.b, its value read as JSON if it is."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yml", ".yaml")):
            try:
                import yaml
            except ModuleNotFoundError:
                raise ValueError("YAML options need PyYAML; use JSON") from None
            found = yaml.safe_load(f) or {}
        else:
            found = json.load(f)
    options: dict = {}
    for name, value in found.items():
        _put(options, name.split("."), value)
    for name, value in sorted((environment if environment is not None else os.environ).items()):
        if name.startswith(prefix):
            _put(options, name[len(prefix) :].lower().split("__"), _value(value))
    return options


def _put(options: dict, path: list[str], value) -> None:
    for part in path[:-1]:
        options = options.setdefault(part, {})
    options[path[-1]] = value


def _value(text: str):
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return text


def main(args: list[str] | None = None) -> None:
    """Options come from a JSON or YAML file (--options) and are overridden by --set name=value (JSON values)."""
    parser = argparse.ArgumentParser(prog="plenumspark", description=__doc__)
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--options", help="a JSON file of options")
    parser.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    a = parser.parse_args(args)
    options = {}
    if a.options:
        options = read_options(a.options)
    for x in a.set:
        name, _, value = x.partition("=")
        _put(options, name.split("."), _value(value))
    spark = SparkSession.builder.appName("plenumspark").getOrCreate()
    COMMANDS[a.command](spark, a.source, a.target, **options)


if __name__ == "__main__":
    main()
