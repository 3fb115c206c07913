"""Command lines.

python -m tidelog.cli [--path FOLDER]                      a shell over a store
python -m tidelog.cli generate --puts N ... --out FOLDER   a workload as text, with --external-puts also its put files
python -m tidelog.cli evaluate --workload FOLDER           its counters and the seconds taken
"""

from __future__ import annotations

import argparse
import re
import sys
import time
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from tidelog import workload
from tidelog.operators.replay import expand_loads, workload_stats
from tidelog.plans.manifest import Folder
from tidelog.plans.store import Store
from tidelog.sources.binary import pairs_of
from tidelog.sources.commands import HELP, VERBS, parse, read_lines
from tidelog.workload import Workload, describe

PROMPT = "(tidelog) "
HISTORY = ".cmd_history"
NUMBER = re.compile(r"[+-]?[0-9]+")


def parse_line(line: str) -> tuple[str, list] | str | None:
    """(verb, arguments), an error text, or None for a blank line."""
    t = line.split()
    if not t:
        return None
    verb = next((s for s, (long, n) in VERBS.items() if t[0] in (s, long) and len(t) == n), None)
    if verb is None:
        return "Unrecognized command"
    if verb == "l":
        return verb, [re.sub(r'^"(.*)"$', r"\1", t[1])]
    if not all(NUMBER.fullmatch(x) and -(1 << 31) <= int(x) < 1 << 31 for x in t[1:]):
        return "Not a 32-bit integer"
    args = [int(x) for x in t[1:]]
    return "Range ends before it begins" if verb == "r" and args[0] > args[1] else (verb, args)


def run(store: Store, lines: Iterable[str]) -> Iterator[str]:
    """Output lines. Writes are gathered until something is read."""
    held: list[tuple] = []

    def settle() -> None:
        if held:
            store.apply(store.spark.createDataFrame([(k, *w) for k, w in enumerate(held)], "pos bigint, op string, a int, b int"))
            held.clear()

    for line in lines:
        got = parse_line(line)
        if got is None:
            continue
        if isinstance(got, str):
            yield got
            continue
        verb, args = got
        if verb in "pd":
            held.append((verb, args[0], args[1] if verb == "p" else None))
            if len(held) >= 10_000:
                settle()
            continue
        if verb == "h":
            yield HELP
            continue
        settle()
        if verb == "q":
            return
        if verb == "g":
            yield from (str(r["val"]) for r in store.get(args[0]).collect())
        elif verb == "r":
            rows = [f"{r['key']}:{r['val']}" for r in store.range(*args).collect()]
            yield from rows or [""]
        elif verb == "l":
            store.load(args[0])
        elif verb == "s":
            yield from stats_lines(store)
    settle()


def stats_lines(store: Store) -> Iterator[str]:
    """Each level with its runs and their files; NaN where a level is empty."""
    ends = lambda r: f"Min = [{r['min_key']} | {r['min_seq']}]    Max = [{r['max_key']} | {r['max_seq']}]"
    rows = store.stats().collect()  # one row for each file, run and level
    for level in range(store.config.max_levels):
        own = sorted((r for r in rows if r["level"] == level), key=lambda r: tuple((r[c] is not None, r[c] or 0) for c in ("run", "file_num")))
        if not own:
            yield f"level {level}: NaN"
        for r in own:
            if r["run"] is None:
                yield f"level {level}: {ends(r)}    {r['bytes']} bytes"
            else:
                yield f"{'    ' if r['file_num'] is not None else '  '}{'run' if r['file_num'] is None else 'file'} {r['run'] if r['file_num'] is None else r['file_num']}: {ends(r)}"


def generate(spark: SparkSession, args: argparse.Namespace) -> None:
    """Writes args.out/commands (text, in order), and with external puts args.out/files (Parquet: file, content)."""
    w = Workload(args.puts, args.gets, args.ranges, args.deletes, args.gets_misses_ratio, args.gets_skewness, args.seed, args.gaussian_ranges, args.external_puts)
    print(describe(w), file=sys.stderr)
    d = workload.generate(spark, w)
    if w.external_puts:
        d, files = workload.externalize(d)
        files.write.parquet(f"{args.out}/files")
    workload.lines(d).repartitionByRange("pos").sortWithinPartitions("pos").select("line").write.text(f"{args.out}/commands")


def evaluate(spark: SparkSession, path: str) -> Iterator[str]:
    """Counters of a workload folder, its loads replaced by the pairs of their files, and the seconds taken."""
    start = time.time()
    d = parse(read_lines(spark, f"{path}/commands"))
    if (bad := d.where("error is not null").orderBy("pos").first()) is not None:
        raise ValueError(f"line {bad['pos']}: {bad['error']}")
    d = d.select("pos", "op", "a", "b", "file")
    if Folder(spark, path).names("files"):
        d = expand_loads(d, pairs_of(spark.read.parquet(f"{path}/files")))
    for name, value in workload_stats(d).first().asDict().items():
        yield f"{name.upper()}: {value}"
    yield f"TIME_ELAPSED: {time.time() - start:.3f}"


def keep_history() -> None:
    """Line editing, with the commands of earlier sessions in this folder; only where a terminal is attached."""
    import atexit
    import contextlib
    import readline

    with contextlib.suppress(OSError):
        readline.read_history_file(HISTORY)
    atexit.register(readline.write_history_file, HISTORY)


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--path", help="folder of a durable store; without it the store is gone at the end")
    tools = p.add_subparsers(dest="tool")
    g = tools.add_parser("generate")
    for name in ("puts", "gets", "ranges", "deletes"):
        g.add_argument(f"--{name}", type=int, default=0, required=name == "puts")
    g.add_argument("--gets-misses-ratio", type=float, default=0.5)
    g.add_argument("--gets-skewness", type=float, default=0.0)
    g.add_argument("--seed", type=int, default=13141)
    g.add_argument("--gaussian-ranges", action="store_true")
    g.add_argument("--external-puts", action="store_true")
    g.add_argument("--out", required=True)
    tools.add_parser("evaluate").add_argument("--workload", required=True)
    return p


def main() -> None:
    args = arguments().parse_args()
    spark = SparkSession.builder.appName("tidelog").getOrCreate()
    if args.tool == "generate":
        return generate(spark, args)
    if args.tool == "evaluate":
        return print(*evaluate(spark, args.workload), sep="\n")
    store = Store.open(spark, args.path)
    if sys.stdin.isatty():
        keep_history()

    def ask() -> Iterator[str]:
        while True:
            try:
                yield input(PROMPT if sys.stdin.isatty() else "")
            except KeyboardInterrupt:
                print("q or Ctrl-D to leave")
            except EOFError:
                return

    try:
        for out in run(store, ask()):
            print(out)
    finally:
        store.close()


if __name__ == "__main__":
    main()
