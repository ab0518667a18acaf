"""Command line: discover, verify, detect, diff, rex, gentest, csvw, version."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys

from . import __version__


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("veriplumb").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("veriplumb")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("discover", aliases=["disco"], help="constraints that a table satisfies")
    d.add_argument("input")
    d.add_argument("constraints", nargs="?", default="-")
    d.add_argument("-r", "--rex", action="store_true", help="infer regular expressions")
    d.add_argument("-R", "--norex", action="store_true", help="infer none")
    for name in ("verify", "detect"):
        v = sub.add_parser(name)
        v.add_argument("input")
        v.add_argument("constraints", nargs="?")
        if name == "detect":
            v.add_argument("output", nargs="?")
            v.add_argument("--write-all", action="store_true")
            v.add_argument("--per-constraint", action="store_true", default=True)
            v.add_argument("--no-per-constraint", dest="per_constraint", action="store_false")
            v.add_argument("--output-fields", nargs="*", default=[])
            v.add_argument("--no-output-fields", action="store_true")
            v.add_argument("--interleave", action="store_true")
            v.add_argument("--index", action="store_true")
            v.add_argument("--int", action="store_true", dest="ints")
            v.add_argument("--key", nargs="*")
        v.add_argument("-a", "--all", action="store_true", help="report all fields")
        v.add_argument("-f", "--fields", action="store_true", help="report fields with failures")
        v.add_argument("-t", "--type-checking", "--type_checking", choices=["strict", "sloppy"], default="sloppy")
        v.add_argument("--epsilon", "-epsilon", type=float, default=0.0)
        v.add_argument("-7", "--ascii", action="store_true")
    c = sub.add_parser("diff", help="differences of two tables")
    c.add_argument("actual")
    c.add_argument("expected")
    c.add_argument("--key", nargs="*")
    c.add_argument("--precision", type=int, default=6)
    for v in {id(v): v for k, v in sub.choices.items() if k in ("discover", "verify", "detect", "diff")}.values():
        v.add_argument("--conn", help="file of database options, for an input dbtype:table")
        for name in ("db", "host", "port", "user", "password"):
            v.add_argument(f"--{name}")
    r = sub.add_parser("rex", help="regular expressions for the lines of a file")
    r.add_argument("input", nargs="?", default="-")
    r.add_argument("output", nargs="?", default="-")
    r.add_argument("-H", "--header", action="store_true")
    r.add_argument("-q", "--quote", action="store_true")
    r.add_argument("-g", "--group", action="store_true", help="capture groups")
    r.add_argument("-u", "--underscore", action="store_true")
    r.add_argument("-d", "--dot", action="store_true")
    r.add_argument("-m", "--minus", action="store_true")
    r.add_argument("-vlf", "--variable", action="store_true")
    r.add_argument("--dialect", default="portable", choices=["portable", "grep", "perl", "posix", "java"])
    g = sub.add_parser("gentest", help="a test of a command")
    g.add_argument("shell_command")
    g.add_argument("script")
    g.add_argument("--iterations", type=int, default=2)
    w = sub.add_parser("csvw", help="what a metadata file says")
    w.add_argument("metadata")
    w.add_argument("--report", action="store_true", help="columns, errors and warnings")
    sub.add_parser("version")
    return p


def extensions() -> list:
    """Modules named in VERIPLUMB_EXTENSIONS, by colons.

    Each may have ``applicable(argv)`` and ``run(argv)``, which take over a whole command, and ``frame(spark, path)``, which
    returns a DataFrame for inputs that it knows and None for others: discovery, verification and detection then work on it.
    """
    return [importlib.import_module(m) for m in os.environ.get("VERIPLUMB_EXTENSIONS", "").split(":") if m]


def source_frame(spark, a, path: str):
    """The table that an argument names: by the first extension that knows it, else as ``load`` reads it."""
    for e in extensions():
        frame = getattr(e, "frame", None)
        if frame is not None and (df := frame(spark, path)) is not None:
            return df
    from .sources.readers import load

    given = {k: getattr(a, k, None) for k in ("conn", "db", "host", "port", "user", "password")}
    return load(spark, path, **{k: v for k, v in given.items() if v is not None})


def constraint_path(said: str | None, source: str) -> str:
    return said or os.path.splitext(source)[0] + ".constraints"


def rex_lines(lines: list[str], header=False, quote=False, **options) -> list[str]:
    from .operators.rexinfer import extract

    found = extract(lines[1:] if header else lines, **options)
    return [json.dumps(r, ensure_ascii=False) for r in found] if quote else found


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    for e in extensions():
        if hasattr(e, "applicable") and e.applicable(argv):
            return e.run(argv) or 0
    a = parser().parse_args(argv)
    if a.command == "version":
        print(__version__)
        return 0
    if a.command == "gentest":
        from .gentest import generate

        print(generate(a.shell_command, a.script, iterations=a.iterations))
        return 0
    if a.command == "csvw":
        from .sources.csvw import load_metadata

        md = load_metadata(a.metadata)
        print(md.report() if a.report else md.to_json(), end="")
        return 0
    if a.command == "rex":
        if a.input == "-":
            text = sys.stdin.read()
        else:
            with open(a.input, encoding="utf-8") as f:
                text = f.read()
        extra = "".join(c for c, on in (("_", a.underscore), (".", a.dot), ("-", a.minus)) if on)
        found = "\n".join(rex_lines(text.splitlines(), a.header, a.quote, tag=a.group, extra_letters=extra, variable=a.variable, dialect=a.dialect)) + "\n"
        if a.output == "-":
            print(found, end="")
        else:
            with open(a.output, "w", encoding="utf-8") as f:
                f.write(found)
        return 0
    spark = session()
    if a.command in ("discover", "disco"):
        from .operators.discover import discover_df

        found = discover_df(source_frame(spark, a, a.input), inc_rex=a.rex and not a.norex, dataset=os.path.basename(a.input), source=os.path.abspath(a.input))
        if found is None:
            print("no constraints found", file=sys.stderr)
            return 1
        if a.constraints == "-":
            print(found.to_json(), end="")
        else:
            found.save(a.constraints)
        return 0
    if a.command == "diff":
        from .operators.compare import compare

        d = compare(source_frame(spark, a, a.actual), source_frame(spark, a, a.expected), key=a.key, type_matching="medium", precision=a.precision)
        print(d if d else "the tables are the same")
        return int(bool(d))
    path = constraint_path(a.constraints, a.input)
    report = "fields" if a.fields else "all" if a.all or a.command == "verify" else "records"
    df = source_frame(spark, a, a.input)
    if a.command == "verify":
        from .operators.verify import verify_df

        print(verify_df(df, path, a.epsilon, a.type_checking, repair=not a.input.endswith(".parquet"), report=report, ascii=a.ascii))
        return 0
    from .operators.detect import detect_df

    found = detect_df(df, path, a.epsilon, a.type_checking, outpath=a.output, write_all=a.write_all, per_constraint=a.per_constraint, output_fields=None if a.no_output_fields else a.output_fields, index=a.index, boolean_ints=a.ints, repair=not a.input.endswith(".parquet"), report=report, interleave=a.interleave, key=a.key)
    found.ascii = a.ascii
    print(found)
    return 0


if __name__ == "__main__":
    sys.exit(main())
