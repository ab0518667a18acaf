"""Generation of tests from commands: run it several times, see what varies, and write a test that allows for that."""

from __future__ import annotations

import datetime
import difflib
import getpass
import logging
import os
import re
import shutil
import socket
import subprocess
import sys
import tempfile
import time
from dataclasses import dataclass, field

from .operators.rexinfer import extract

#: Files of a folder that are looked at, at most, unless told otherwise (fixed value); beyond it, a warning is given.
MOST_FILES = 10_000
log = logging.getLogger("veriplumb")


@dataclass
class Run:
    stdout: str
    stderr: str
    status: int
    seconds: float
    files: dict[str, bytes] = field(default_factory=dict)


def changed_files(folder: str, since: float, most: int | None = MOST_FILES) -> dict[str, bytes]:
    out: dict[str, bytes] = {}
    seen = 0
    for d, _, names in os.walk(folder):
        for n in sorted(names):
            seen += 1
            if most is not None and seen > most:
                log.warning("%s holds more than %d files; those after are not looked at", folder, most)
                return out
            p = os.path.join(d, n)
            if os.path.isfile(p) and os.stat(p).st_mtime >= since:
                with open(p, "rb") as f:
                    out[os.path.relpath(p, folder)] = f.read()
    return out


def run(command: str, folder: str, most: int | None = MOST_FILES) -> Run:
    began = time.time()
    p = subprocess.run(command, shell=True, cwd=folder, capture_output=True, text=True, errors="replace")
    return Run(p.stdout, p.stderr, p.returncode, time.time() - began, changed_files(folder, began - 0.01, most))


def is_text(data: bytes) -> bool:
    try:
        return "\0" not in data.decode()
    except UnicodeDecodeError:
        return False


def paired(a: list[str], b: list[str]) -> list[tuple[str | None, str | None]]:
    """Lines that differ, in pairs; a line of one side alone has None for the other."""
    out: list[tuple[str | None, str | None]] = []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind != "equal":
            x, y = a[i:j], b[k:m]
            out += [(x[n] if n < len(x) else None, y[n] if n < len(y) else None) for n in range(max(len(x), len(y)))]
    return out


_ISO = re.compile(r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?")
_EURO = re.compile(r"\b(\d{1,2})[-/](\d{1,2})[-/](\d{4})\b")
_TIMED = re.compile(r"\b\d{1,2}:\d{2}:\d{2}\b")


def near_now(line: str, began: datetime.datetime, ended: datetime.datetime) -> list[str]:
    """Dates in a line that lie within a day of the runs, as patterns of their form."""
    out = []
    low, high = began.date() - datetime.timedelta(days=1), ended.date() + datetime.timedelta(days=1)
    for m in _ISO.finditer(line):
        y, mo, d = (int(x) for x in re.split(r"[-/T ]", m[0])[:3])
        if 1 <= mo <= 12 and 1 <= d <= 31 and low <= datetime.date(y, mo, min(d, 28)) + datetime.timedelta(days=max(0, d - 28)) <= high:
            out.append(re.sub(r"\d+", lambda k: r"\d{%d}" % len(k[0]), re.escape(m[0]).replace(r"\-", "-")))
    for m in _EURO.finditer(line):
        for d, mo in ((m[1], m[2]), (m[2], m[1])):
            if 1 <= int(mo) <= 12 and 1 <= int(d) <= 28 and low <= datetime.date(int(m[3]), int(mo), int(d)) <= high:
                out.append(r"\d{1,2}[-/]\d{1,2}[-/]\d{4}")
                break
    if out and _TIMED.search(line):
        out.append(r"\d{1,2}:\d{2}:\d{2}")
    return list(dict.fromkeys(out))


@dataclass
class Allowance:
    patterns: list[str] = field(default_factory=list)
    substrings: list[str] = field(default_factory=list)
    removals: list[str] = field(default_factory=list)

    def options(self) -> str:
        said = {"ignore_patterns": self.patterns, "ignore_substrings": self.substrings, "remove_lines": self.removals}
        return "".join(f", {k}={v!r}" for k, v in said.items() if v)


def allowance(texts: list[str], folder: str, began: datetime.datetime, ended: datetime.datetime) -> Allowance:
    """What a comparison must allow for: lines that vary between runs, and names of this machine, user, folder and day."""
    out = Allowance()
    lines = [t.splitlines() for t in texts]
    groups: dict[str, list[str]] = {}
    for other in lines[1:]:
        for a, b in paired(lines[0], other):
            if a is None or b is None:
                out.removals.append((a or b or "").strip())
            else:
                groups.setdefault(re.sub(r"\d+", "0", a), []).extend([a, b])
    for g in groups.values():
        out.patterns += extract(list(dict.fromkeys(g)))
    for name in (socket.gethostname(), getpass.getuser(), os.path.abspath(folder), tempfile.gettempdir()):
        if len(name) > 2 and any(name in t for t in texts):
            out.substrings.append(name)
    for x in lines[0]:
        out.patterns += near_now(x, began, ended)
    out.patterns = list(dict.fromkeys(out.patterns))
    out.removals = [x for x in dict.fromkeys(out.removals) if x]
    return out


def generate(command: str, script: str, folder: str = ".", iterations: int = 2, check_stdout: bool = True, check_stderr: bool = True, max_files: int | None = None, most_files: int | None = MOST_FILES) -> str:
    """Writes ``script``, a ``unittest`` of ``command``, and its reference results beside it; returns the script's path."""
    began = datetime.datetime.now()
    runs = [run(command, folder, most_files) for _ in range(max(1, iterations))]
    ended = datetime.datetime.now()
    stem = os.path.splitext(os.path.basename(script))[0]
    ref = os.path.join(os.path.dirname(os.path.abspath(script)), "ref", stem)
    shutil.rmtree(ref, ignore_errors=True)
    os.makedirs(ref)
    body = []
    first = runs[0]

    def store(name: str, data: bytes) -> str:
        path = os.path.join(ref, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
        return path

    for kind, wanted in (("stdout", check_stdout), ("stderr", check_stderr)):
        if wanted:
            store(kind.upper(), getattr(first, kind).encode())
            extra = allowance([getattr(r, kind) for r in runs], folder, began, ended).options()
            body.append(f"    def test_{kind}(self):\n        self.assertStringCorrect(self.done.{kind}, os.path.join(REF, {kind.upper()!r}){extra})\n")
    body.append(f"    def test_status(self):\n        self.assertEqual(self.done.returncode, {first.status})\n")
    made = [n for n in sorted(first.files) if all(n in r.files for r in runs) and not os.path.abspath(os.path.join(folder, n)).startswith(ref)]
    for i, n in enumerate(made[:max_files]):
        store(n, first.files[n])
        target = f"os.path.join(FOLDER, {n!r}), os.path.join(REF, {n!r})"
        if all(is_text(r.files[n]) for r in runs):
            extra = allowance([r.files[n].decode() for r in runs], folder, began, ended).options()
            body.append(f"    def test_file_{i}(self):\n        self.assertTextFileCorrect({target}{extra})\n")
        elif all(r.files[n] == first.files[n] for r in runs):
            body.append(f"    def test_file_{i}(self):\n        self.assertBinaryFileCorrect({target})\n")
    head = f'''"""Test of a command, as it ran on {began:%Y-%m-%d}."""

import os
import subprocess

from veriplumb.reftest import ReferenceTestCase

COMMAND = {command!r}
FOLDER = {os.path.abspath(folder)!r}
REF = {ref!r}


class TestCommand(ReferenceTestCase):
    @classmethod
    def setUpClass(cls):
        cls.done = subprocess.run(COMMAND, shell=True, cwd=FOLDER, capture_output=True, text=True, errors="replace")

'''
    with open(script, "w", encoding="utf-8") as f:
        f.write(head + "\n".join(body) + '\n\nif __name__ == "__main__":\n    ReferenceTestCase.main()\n')
    return script


def main(args: list[str]) -> int:
    if len(args) < 2:
        print("gentest COMMAND SCRIPT [ITERATIONS]", file=sys.stderr)
        return 1
    print(generate(args[0], args[1], iterations=int(args[2]) if len(args) > 2 else 2))
    return 0
