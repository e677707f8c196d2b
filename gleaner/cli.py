"""Command line: python -m gleaner.cli PATH... Exit code 0 with hits, 1 without, 2 on error (section 2.10)."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import results
from .operators.export import export_text, pieces
from .plans import presets
from .plans.options import SCHEMES, FileSelection, Job, OptionError, Options
from .sources.files import scan_paths
from .sources.store import Store


def _number(text: str) -> int:
    value = int(text, 16 if text.lower().startswith("0x") else 10)
    if not 0 <= value < 1 << 63:
        raise argparse.ArgumentTypeError(f"out of range: {text}")
    return value


def _list(text: str) -> list[str]:
    items = [x.strip() for x in text.split(",")]
    if not all(items):
        raise argparse.ArgumentTypeError("an empty item in a list")
    return items


def _schemes(text: str) -> list[str]:
    items = [x.lower() for x in _list(text)]
    if unknown := [x for x in items if x not in SCHEMES]:
        raise argparse.ArgumentTypeError(f"unknown scheme: {unknown[0]}")
    return items


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleaner", allow_abbrev=False)
    p.add_argument("inputs", nargs="*")
    p.add_argument("--file", "--folder", dest="more", action="append", default=[])
    which = p.add_mutually_exclusive_group()
    which.add_argument("--regex")
    which.add_argument("--preset", type=_list)
    p.add_argument("--scheme", type=_schemes, default=[])
    p.add_argument("--icase", action="store_true")
    p.add_argument("--no-crap", dest="keep_noise", action="store_true")
    for d in ("ascii", "utf16", "base64", "hex", "escaped"):
        p.add_argument(f"--no-{d}", action="store_true")
    p.add_argument("--ignore", action="append", default=[])
    p.add_argument("--out")
    p.add_argument("--format", choices=("txt", "csv", "json", "table", "sqlite"), default="txt")
    p.add_argument("--include", default="*")
    p.add_argument("--exclude", default="")
    for n in ("min-size", "max-size", "modified-after", "modified-before", "range-start", "range-end"):
        p.add_argument(f"--{n}", type=_number, default=0)
    p.add_argument("--db", default="gleaner-store")
    for n in ("save-session", "save-job", "run-job", "favorite", "presets-file"):
        p.add_argument(f"--{n}")
    p.add_argument("--open-session", type=_number)
    p.add_argument("--compare-sessions", type=_number, nargs=2)
    for n in ("list-jobs", "favorites", "list-user-presets"):
        p.add_argument(f"--{n}", action="store_true")
    p.add_argument("--user-preset", action="append", default=[])
    return p


def options_of(a: argparse.Namespace) -> Options:
    """The scan of the flags; user presets come first, explicit flags override them."""
    base = Options()
    if a.user_preset:
        known = {p.name: p for p in presets.load(a.presets_file or "user-presets.ini")}
        if missing := [n for n in a.user_preset if n not in known]:
            raise OptionError(f"unknown user preset: {missing[0]}")
        base = presets.profile([known[n] for n in a.user_preset])
    if a.regex:
        base = replace(base, mode="regex", custom=a.regex, custom_label="Custom", presets=(), extra=())
    if a.preset:
        base = replace(base, mode="regex", presets=tuple(a.preset), custom="", extra=())
    off = {d: False for d in ("ascii", "utf16", "base64", "hex", "escaped") if getattr(a, f"no_{d}")}
    out = replace(base, schemes=tuple(a.scheme), ignore_case=a.icase or base.ignore_case, drop_noise=not a.keep_noise, **off)
    if out.mode == "regex":
        from .functions.patterns import matchers

        matchers(out)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        if a.list_user_presets:
            out.write("".join(f"{p.name}\n" for p in presets.load(a.presets_file or "user-presets.ini")))
            return 0
        options = options_of(a)
        selection = FileSelection(a.include, a.exclude, a.min_size, a.max_size, a.modified_after, a.modified_before, a.range_start, a.range_end)
        inputs = a.inputs + a.more
        spark = spark or SparkSession.builder.appName("gleaner").getOrCreate()
        store = Store(spark, a.db)
        if a.list_jobs or a.favorites:
            rows = store.jobs() if a.list_jobs else store.favorites("source")
            out.write("".join(f"{r[0]}\n" for r in rows.collect()))
            return 0
        if a.favorite:
            store.set_favorite("source", a.favorite)
            return 0
        if a.open_session:
            out.write(export_text(store.load_session(a.open_session), "txt" if a.format in ("table", "sqlite") else a.format))
            return 0
        if a.compare_sessions:
            delta = store.compare_sessions(*a.compare_sessions)
            for title in ("Added", "Removed"):
                out.write(f"{title}:\n" + export_text(delta.filter(F.col("status") == title.lower()).drop("status"), "txt") + "\n")
            return 0
        if a.run_job:
            job = store.load_job(a.run_job)
            options, selection, inputs = job.options, job.selection, list(job.sources)
        if not inputs:
            raise OptionError("no input")
        if missing := [p for p in inputs if "://" not in p and not os.path.exists(p)]:
            raise OptionError(f"input does not exist: {missing[0]}")
        if a.save_job:
            store.save_job(Job(a.save_job, tuple(inputs), options, selection))
        found = results.resolve_download_hosts(scan_paths(spark, inputs, options, selection))
        if a.ignore:
            found = results.ignore(found, results.IgnoreRules.parse("\n".join(a.ignore)))
        found = found.persist()
        count = found.count()
        if a.save_session or a.format in ("table", "sqlite"):
            number = store.save_session(found, a.save_session or "Scan", "; ".join(inputs))
            out.write(f"saved {count} findings as session {number}\n")
            if a.format in ("table", "sqlite"):  # a session in the store's tables
                return 0
        if a.out:
            with open(a.out, "w", encoding="utf-8", newline="") as f:
                f.writelines(pieces(found, a.format))
            out.write(f"wrote {count} results to {a.out}\n")
        else:
            out.writelines(pieces(found, a.format))
        return 0 if count else 1
    except (OptionError, ValueError, OSError) as e:
        sys.stderr.write(f"error: {e}\n")
        return 2


if __name__ == "__main__":
    sys.exit(main())
