"""pytest flavour of reference tests: a fixture ``ref`` and options. Enable with ``-p veriplumb.pytest_plugin``."""

from __future__ import annotations

import pytest

from .reftest import ReferenceTest


def pytest_addoption(parser):
    group = parser.getgroup("reference tests")
    group.addoption("--write-all", action="store_true", help="write all reference results anew")
    group.addoption("--write", nargs="+", default=[], metavar="KIND", help="write reference results of these kinds anew")
    group.addoption("--wquiet", action="store_true", help="say nothing when writing")
    group.addoption("--tagged", action="store_true", help="run tagged tests only")
    group.addoption("--istagged", action="store_true", help="name tagged tests, and run none")


def pytest_configure(config):
    if config.getoption("--write-all"):
        ReferenceTest.set_regeneration()
    for kind in config.getoption("--write"):
        ReferenceTest.set_regeneration(kind)
    if config.getoption("--wquiet"):
        ReferenceTest.verbose = False


def pytest_collection_modifyitems(config, items):
    if config.getoption("--tagged") or config.getoption("--istagged"):
        marked = [i for i in items if getattr(getattr(i, "function", None), "_tagged", False) or getattr(getattr(i, "cls", None), "_tagged", False)]
        if config.getoption("--istagged"):
            for i in marked:
                print(i.nodeid)
            marked = []
        items[:] = marked


@pytest.fixture
def ref():
    return ReferenceTest()
