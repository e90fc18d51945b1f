"""Run parameters: datasets' presets, a small reader of parameter files, and the command line."""

from __future__ import annotations

import argparse
import re
import shutil

from geoloom.operators.mixture import PRESETS

#: What a run of each dataset uses.
DATASETS = {
    "toy": {"dim": 10, "epochs": 1, "negative": 1, "queries": 2, "reference": 4, "bins": 6, "sampler": PRESETS["toy"]},
    "la": {"dim": 100, "epochs": 50, "negative": 1, "queries": 200, "reference": 14, "bins": 6, "sampler": PRESETS["la"]},
    "ny": {"dim": 100, "epochs": 50, "negative": 1, "queries": 200, "reference": 14, "bins": 6, "sampler": PRESETS["ny"]},
}


def parse(text: str) -> dict:
    """'name: value' lines; '!join [a, b]' makes one string of its items; a value may name an earlier one as *name."""
    out: dict = {}

    def value(raw: str):
        raw = raw.strip()
        if joined := re.fullmatch(r"!join\s*\[(.*)\]", raw):
            return "".join(str(value(x)) for x in joined[1].split(","))
        if raw.startswith("*"):
            return out[raw[1:]]
        if re.fullmatch(r"[-+]?\d+", raw):
            return int(raw)
        if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?", raw):
            return float(raw)
        if raw.lower() in ("true", "false"):
            return raw.lower() == "true"
        return None if raw in ("", "null", "~") else raw.strip("'\"")

    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*", "", line)
        if m := re.match(r"\s*([\w-]+)\s*:\s*(?:&[\w-]+\s+)?(.*)", line):
            out[m[1]] = value(m[2])
    return out


def settings(dataset: str = "toy", text: str | None = None, **changes) -> dict:
    """The preset of a dataset, overridden by a parameter file's text, then by keywords."""
    if dataset not in DATASETS:
        raise ValueError(f"unknown dataset {dataset}")
    return {**DATASETS[dataset], **(parse(text) if text else {}), **changes}


def command_line(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="geoloom", description="Run one query over a folder of tables and save its rows.")
    p.add_argument("query")
    p.add_argument("tables")
    p.add_argument("out")
    p.add_argument("--format", default="parquet", choices=["parquet", "json", "csv", "text"])
    return p.parse_args(args)


def tool_present(command: str) -> bool:
    """Whether an external tool (a tagger) can be started."""
    return shutil.which(command) is not None
