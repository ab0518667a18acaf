"""Reference tests: assertions that tables, texts and files are as they were, with regeneration on request."""

from __future__ import annotations

import contextlib
import filecmp
import io
import os
import shutil
import sys
import tempfile
import unittest
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .operators import compare as cmp
from .operators import textdiff
from .sources.readers import load
from .sources.writers import save


def tag(test):
    """Marks a test method or class, to be run alone with ``--tagged``."""
    test._tagged = True
    return test


class Captured(io.StringIO):
    """Text that was printed; ``str`` gives it."""

    def __str__(self) -> str:
        return self.getvalue()


@contextlib.contextmanager
def captured(stream: str = "stdout", echo: bool = False):
    """What is printed to ``stdout`` or ``stderr`` inside the block, so that it can be compared; ``echo`` prints it too."""
    if stream not in ("stdout", "stderr"):
        raise ValueError(f"can't capture {stream}")
    out = Captured()
    redirect = contextlib.redirect_stdout if stream == "stdout" else contextlib.redirect_stderr
    try:
        with redirect(out):
            yield out
    finally:
        if echo:
            getattr(sys, stream).write(str(out))


class ReferenceTest:
    """Assertions against stored results.

    ``kind`` groups reference data: each kind has a folder, and can be regenerated (written anew) on its own; None stands
    for all. A failing assertion keeps the actual result in a temporary folder and names a command to see the difference.
    """

    regenerate: dict[str | None, bool] = {}
    locations: dict[str | None, str] = {}
    verbose = True

    def __init__(self, fail=None, spark: SparkSession | None = None):
        self._fail, self._spark = fail, spark

    @classmethod
    def set_regeneration(cls, kind: str | None = None, regenerate: bool = True) -> None:
        cls.regenerate = {**cls.regenerate, kind: regenerate}

    @classmethod
    def set_default_data_location(cls, location: str, kind: str | None = None) -> None:
        cls.locations = {**cls.locations, kind: location}

    def set_data_location(self, location: str, kind: str | None = None) -> None:
        self.locations = {**self.locations, kind: location}

    def should_regenerate(self, kind: str | None = None) -> bool:
        return self.regenerate.get(kind, self.regenerate.get(None, False))

    def resolve(self, path: str, kind: str | None = None) -> str:
        place = self.locations.get(kind, self.locations.get(None))
        return path if os.path.isabs(path) or place is None else os.path.join(place, path)

    @property
    def spark(self) -> SparkSession:
        return self._spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()

    def fail_with(self, messages: Sequence[str]) -> None:
        text = "\n".join(messages)
        if self._fail:
            self._fail(text)
        raise AssertionError(text)

    def _wrote(self, path: str) -> None:
        if self.verbose:
            print(f"wrote {path}", file=sys.stderr)

    # tables

    def assertDataFramesEqual(self, df: DataFrame, ref_df: DataFrame, **options) -> None:
        if d := cmp.compare(df, ref_df, **options):
            self.fail_with(d.messages)

    def assertDataFrameCorrect(self, df: DataFrame, ref_path: str, kind: str | None = "parquet", actual_path: str | None = None, **options) -> None:
        """``df`` against a stored table."""
        path = self.resolve(ref_path, kind)
        if self.should_regenerate(kind):
            save(df, path)
            self._wrote(path)
            return
        options.setdefault("type_matching", "medium" if not path.endswith(".parquet") else "strict")
        if d := cmp.compare(df, load(self.spark, path), **options):
            actual = actual_path or os.path.join(tempfile.mkdtemp(prefix="actual-"), os.path.basename(path))
            if not actual_path:
                save(df, actual)
            self.fail_with([*d.messages, f"Compare with: veriplumb diff {actual} {path}"])

    def assertOnDiskDataFrameCorrect(self, actual_path: str, ref_path: str, kind: str | None = "parquet", **options) -> None:
        path = self.resolve(ref_path, kind)
        if self.should_regenerate(kind):
            self._copy(actual_path, path)
            return
        self.assertDataFrameCorrect(load(self.spark, actual_path), ref_path, kind, actual_path, **options)

    def assertOnDiskDataFramesCorrect(self, actual_paths: Sequence[str], ref_paths: Sequence[str], kind: str | None = "parquet", **options) -> None:
        self._each(self.assertOnDiskDataFrameCorrect, actual_paths, ref_paths, kind, options)

    def assertCSVFileCorrect(self, actual_path: str, ref_csv: str, kind: str | None = "csv", **options) -> None:
        self.assertOnDiskDataFrameCorrect(actual_path, ref_csv, kind, **options)

    def assertCSVFilesCorrect(self, actual_paths: Sequence[str], ref_csvs: Sequence[str], kind: str | None = "csv", **options) -> None:
        self._each(self.assertCSVFileCorrect, actual_paths, ref_csvs, kind, options)

    # texts and files

    def assertStringCorrect(self, string: str, ref_path: str, kind: str | None = None, encoding: str = "utf-8", **options) -> None:
        path = self.resolve(ref_path, kind)
        if self.should_regenerate(kind):
            with open(path, "w", encoding=encoding) as f:
                f.write(string)
            self._wrote(path)
            return
        with open(path, encoding=encoding) as f:
            d = textdiff.compare_texts(string, f.read(), **options)
        if d:
            actual = os.path.join(tempfile.mkdtemp(prefix="actual-"), os.path.basename(path))
            with open(actual, "w", encoding=encoding) as f:
                f.write(string)
            self.fail_with([*d.messages, *d.reconstruction()[:20], f"Compare with: diff {actual} {path}"])

    def assertTextFileCorrect(self, actual_path: str, ref_path: str, kind: str | None = None, encoding: str | None = None, **options) -> None:
        path = self.resolve(ref_path, kind)
        if self.should_regenerate(kind):
            self._copy(actual_path, path)
        elif d := textdiff.compare_files(actual_path, path, encoding, **options):
            self.fail_with([*d.messages, *d.reconstruction()[:20], f"Compare with: diff {actual_path} {path}"])

    def assertTextFilesCorrect(self, actual_paths: Sequence[str], ref_paths: Sequence[str], kind: str | None = None, **options) -> None:
        self._each(self.assertTextFileCorrect, actual_paths, ref_paths, kind, options)

    def assertBinaryFileCorrect(self, actual_path: str, ref_path: str, kind: str | None = None) -> None:
        path = self.resolve(ref_path, kind)
        if self.should_regenerate(kind):
            self._copy(actual_path, path)
        elif not filecmp.cmp(actual_path, path, shallow=False):
            self.fail_with([*textdiff.compare_binary(actual_path, path).messages, f"Compare with: cmp {actual_path} {path}"])

    def _copy(self, source: str, target: str) -> None:
        if os.path.isdir(source):
            shutil.rmtree(target, ignore_errors=True)
            shutil.copytree(source, target)
        else:
            shutil.copyfile(source, target)
        self._wrote(target)

    def _each(self, check, actual_paths, ref_paths, kind, options) -> None:
        if len(actual_paths) != len(ref_paths):
            self.fail_with([f"{len(actual_paths)} files, expected {len(ref_paths)}"])
        messages = []
        for a, r in zip(actual_paths, ref_paths, strict=True):
            try:
                check(a, r, kind=kind, **options)
            except AssertionError as e:
                messages.append(f"{a}: {e}")
        if messages:
            self.fail_with(messages)


class ReferenceTestCase(unittest.TestCase, ReferenceTest):
    """``unittest`` flavour; ``main()`` takes the flags -W (write all), -w kind..., -1 (tagged only), -0 (list tagged)."""

    def __init__(self, *args, **kwargs):
        unittest.TestCase.__init__(self, *args, **kwargs)
        self._spark, self._fail = None, None

    @staticmethod
    def main(argv: list[str] | None = None, **options):
        left = apply_flags(list(sys.argv if argv is None else argv))
        loader = TaggedLoader(left.pop("list"), left.pop("tagged"))
        return unittest.main(argv=left["argv"], testLoader=loader, **options)


def apply_flags(argv: list[str]) -> dict:
    """Applies the flags that concern reference tests, and returns the other arguments."""
    out, rest, i = {"tagged": False, "list": False}, [], 0
    while i < len(argv):
        a = argv[i]
        if a in ("--write-all", "-W"):
            ReferenceTest.set_regeneration()
        elif a in ("--write", "-w"):
            while i + 1 < len(argv) and not argv[i + 1].startswith("-"):
                i += 1
                for kind in argv[i].split(","):
                    ReferenceTest.set_regeneration(kind)
        elif a == "--wquiet":
            ReferenceTest.verbose = False
        elif a in ("--tagged", "-1"):
            out["tagged"] = True
        elif a in ("--istagged", "-0"):
            out["list"] = True
        else:
            rest.append(a)
        i += 1
    return out | {"argv": rest}


class TaggedLoader(unittest.TestLoader):
    """Loads all tests, or the tagged ones alone; can name the classes that have some instead."""

    def __init__(self, list_only: bool = False, tagged: bool = False):
        super().__init__()
        self.list_only, self.tagged = list_only, tagged

    def getTestCaseNames(self, case):
        names = super().getTestCaseNames(case)
        if not self.tagged and not self.list_only:
            return names
        marked = names if getattr(case, "_tagged", False) else [n for n in names if getattr(getattr(case, n), "_tagged", False)]
        if self.list_only:
            if marked:
                print(f"{case.__module__}.{case.__name__}")
            return []
        return marked
