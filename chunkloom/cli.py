"""Command line: python -m chunkloom.cli --input DIR --output DIR ..."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from .config import COMPATS, FORMATS, Settings, merged, parse_toml
from .model import DocError
from .operators.chunking import STRATEGIES

OK, PARTIAL, FAILED, BAD_CONFIG = range(4)


def expand(args: list[str]) -> list[str]:
    """Arguments with each @file replaced by its lines; empty ones and comments are passed over."""
    out = []
    for a in args:
        if a.startswith("@") and len(a) > 1:
            with open(a[1:], encoding="utf-8") as f:
                out += [x for x in map(str.strip, f) if x and not x.startswith("#")]
        else:
            out.append(a)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chunkloom", description="Documents to chunks on Spark", argument_default=argparse.SUPPRESS)
    p.add_argument("-i", "--input")
    p.add_argument("-o", "--output")
    p.add_argument("-c", "--config")
    p.add_argument("-f", "--format", choices=FORMATS)
    p.add_argument("--output-compat", choices=COMPATS, help="JSON as a flat list of typed elements, whatever --format says")
    p.add_argument("--chunk-strategy", choices=STRATEGIES)
    p.add_argument("--max-tokens", type=int)
    p.add_argument("--overlap", type=int)
    p.add_argument("--tokenizer")
    p.add_argument("--models", help="folder with OCR models")
    p.add_argument("--mode", choices=("fast", "accurate"))
    p.add_argument("--workers", type=int)
    p.add_argument("--gpu", action="store_true")
    p.add_argument("--strict", action="store_true", help="any failed document is a failure")
    p.add_argument("--debug", action="store_true")
    p.add_argument("--debug-output")
    p.add_argument("--log-level", choices=tuple(LEVELS))
    p.add_argument("--completions", choices=tuple(SHELLS), help="print a completion script and end")
    return p


def completions(shell: str) -> str:
    """A script that completes the options, and the choices of those that have some."""
    options = [a for a in parser()._actions if a.option_strings]
    words = " ".join(sorted(o for a in options for o in a.option_strings))
    chosen = [(" ".join(a.option_strings), " ".join(a.choices)) for a in options if a.choices]
    return SHELLS[shell](words, chosen)


def _bash(words: str, chosen: list[tuple[str, str]]) -> str:
    cases = "\n".join(f"    {o.replace(' ', '|')}) COMPREPLY=($(compgen -W '{c}' -- \"$cur\")); return;;" for o, c in chosen)
    return f"""_chunkloom() {{
  local cur="${{COMP_WORDS[COMP_CWORD]}}"
  case "${{COMP_WORDS[COMP_CWORD-1]}}" in
{cases}
    -i|--input|-o|--output|-c|--config|--debug-output) COMPREPLY=($(compgen -f -- "$cur")); return;;
  esac
  COMPREPLY=($(compgen -W '{words}' -- "$cur"))
}}
complete -F _chunkloom chunkloom
"""


def _zsh(words: str, chosen: list[tuple[str, str]]) -> str:
    return "autoload -U +X bashcompinit && bashcompinit\n" + _bash(words, chosen)


def _fish(words: str, chosen: list[tuple[str, str]]) -> str:
    own = {o: c for names, c in chosen for o in names.split()}
    one = lambda o: f"complete -c chunkloom {'-l' if o.startswith('--') else '-s'} {o.lstrip('-')}" + (f" -x -a '{own[o]}'" if o in own else "")
    return "\n".join(map(one, words.split())) + "\n"


SHELLS = {"bash": _bash, "zsh": _zsh, "fish": _fish}
LEVELS = {"error": logging.ERROR, "warn": logging.WARNING, "info": logging.INFO, "debug": logging.DEBUG, "trace": 5}


def start_logging(s: Settings) -> None:
    """Messages on standard error from the level on; all of them in a file too if there is a folder for debug output."""
    log = logging.getLogger("chunkloom")
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    out = logging.StreamHandler(sys.stderr)
    out.setLevel(LEVELS[s.log_level])
    handlers: list[logging.Handler] = [out]
    folder = (s.debug_output or "").removeprefix("file://")
    if folder and "://" not in folder:
        os.makedirs(folder, exist_ok=True)
        handlers.append(logging.FileHandler(os.path.join(folder, "chunkloom.log"), encoding="utf-8"))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)
    log.setLevel(LEVELS["debug"] if len(handlers) > 1 else LEVELS[s.log_level])
    log.propagate = False


def settings(argv: list[str]) -> Settings:
    given = vars(parser().parse_args(expand(argv)))
    given.pop("completions", None)
    file = {}
    if path := given.pop("config", None):
        if not os.path.isfile(path):
            raise DocError("E5001", f"no configuration file {path}")
        with open(path, encoding="utf-8") as f:
            file = parse_toml(f.read())
    return merged(Settings(), file, given)


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    try:
        s = settings(argv)
        if shell := getattr(parser().parse_args(expand(argv)), "completions", None):
            print(completions(shell), end="")
            return OK
    except (DocError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return BAD_CONFIG
    if problems := s.problems():
        print("\n".join(f"error: {x}" for x in problems), file=sys.stderr)
        return BAD_CONFIG
    if not os.path.exists(s.input.removeprefix("file://")) and "://" not in s.input:
        print(f"error: E2001 no such input {s.input}", file=sys.stderr)
        return FAILED
    start_logging(s)
    from pyspark.sql import SparkSession

    from .plans import pipeline

    spark = SparkSession.getActiveSession()
    if spark is None:  # on a cluster spark-submit names the master
        builder = SparkSession.builder.appName("chunkloom").config("spark.ui.enabled", "false")
        spark = (builder if os.environ.get("SPARK_SUBMIT_OPTS") or os.environ.get("MASTER") else builder.master(f"local[{s.workers or '*'}]")).getOrCreate()
    got = pipeline.run(spark, s)
    print(f"{got['succeeded']} of {got['total_files']} documents, {got['total_chunks']} chunks, {got['elapsed_secs']:.2f} s, {got['files_per_sec']:.0f} files/s", file=sys.stderr)
    for path, code, message in got["errors"]:
        print(f"{code} {path}: {message}", file=sys.stderr)
    if not got["failed"]:
        return OK if got["total_files"] else FAILED
    return FAILED if s.strict or not got["succeeded"] else PARTIAL


if __name__ == "__main__":
    sys.exit(main())
