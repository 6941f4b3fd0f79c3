"""Imports of a small package from its files, and resolution of random packages against walks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import parsing
from tessera.operators import imports as i

FILES = {
    "pkg/__init__.py": "from .utils import helper as h\nfrom . import deep\n",
    "pkg/utils.py": "from pkg.internal import helper\nfrom .deep.base import *\nimport os, numpy as np\n_hidden = 1\n",
    "pkg/internal.py": "__all__ = ['helper']\ndef helper(): pass\nclass Other: pass\n",
    "pkg/deep/base.py": "import importlib\nname = 'json'\ndef shown():\n    from ..internal import Other\n    importlib.import_module(name)\n    __import__('re')\n    importlib.import_module(name + 'x')\n_not = 2\nsize: int = 3\n",
    "pkg/ring.py": "from pkg.ring2 import x\n",
    "pkg/ring2.py": "from pkg.ring import x\n",
    "bad.py": "def (",
}


@pytest.fixture(scope="module")
def package(spark):
    files = spark.createDataFrame([*FILES.items(), ("none.py", None)], "path string, text string")
    named = lambda df: df.withColumn("module", i.module_of(F.col("path")))
    return named(parsing.symbols(files)), i.absolute(named(parsing.imports(files)))


def test_extraction(package):
    symbols, imports = package
    got = {(r.module, r.target, r.name, r.alias, r.kind) for r in imports.collect()}
    assert got == {
        ("pkg", "utils", "helper", "h", "relative"), ("pkg", "", "deep", None, "relative"), ("pkg.utils", "pkg.internal", "helper", None, "from"), ("pkg.utils", "pkg.deep.base", "*", None, "wildcard"),
        ("pkg.utils", "os", "os", None, "direct"), ("pkg.utils", "numpy", "numpy", "np", "aliased"), ("pkg.deep.base", "importlib", "importlib", None, "direct"), ("pkg.deep.base", "pkg.internal", "Other", None, "relative"),
        ("pkg.deep.base", "json", "json", None, "dynamic"), ("pkg.deep.base", "re", "re", None, "dynamic"), ("pkg.deep.base", "?", "?", None, "unknown"),
        ("pkg.ring", "pkg.ring2", "x", None, "from"), ("pkg.ring2", "pkg.ring", "x", None, "from"),
    }
    public = {(r.module, r.name): r.public for r in symbols.collect()}
    assert public == {("pkg.utils", "_hidden"): False, ("pkg.internal", "__all__"): False, ("pkg.internal", "helper"): True, ("pkg.internal", "Other"): False, ("pkg.deep.base", "name"): True, ("pkg.deep.base", "shown"): True, ("pkg.deep.base", "_not"): False, ("pkg.deep.base", "size"): True}


def test_chains_of_the_package(spark, package):
    got = {(r.module, r.name): (r.to_module, r.to_name, r.hops, r.state) for r in i.resolve_aliases(*package, longest=4).collect()}
    assert got["pkg.utils", "helper"] == ("pkg.internal", "helper", 1, "resolved") and got["pkg.utils", "shown"] == ("pkg.deep.base", "shown", 1, "resolved")
    assert got["pkg.ring", "x"] == got["pkg.ring2", "x"] == (None, None, None, "cycle") and got["pkg.utils", "os"] == ("os", "os", 1, "missing")


def random_package(seed):
    rng = random.Random(seed)
    modules = [f"p.m{k}" for k in range(30)]
    symbols = sorted({(rng.choice(modules), rng.choice("abcd"), rng.random() < 0.7) for _ in range(14)})
    symbols = list({(m, n): (m, n, pub) for m, n, pub in symbols}.values())
    imports, line = [], 0
    for m in modules:
        for _ in range(rng.randrange(4)):
            line += 1
            t = rng.choice(modules)
            kind = rng.random()
            imports.append((m, "p" if kind < 0.15 else t, t[2:] if kind < 0.15 else "*" if kind < 0.35 else rng.choice("abcd"), rng.choice([None, None, "a", "b"]), line))
    chain = [(f"c{k}", f"c{k + 1}", "z", None, 1) for k in range(21)]
    return [*symbols, ("c21", "z", True)], [(m, t, n, None if n == "*" else a, x) for m, t, n, a, x in imports] + chain


@pytest.mark.parametrize("seed", [1, 2])
def test_against_walks(spark, seed):
    symbols, imports = random_package(seed)
    s = spark.createDataFrame([*symbols, (None, "a", True)], "module string, name string, public boolean")
    m = spark.createDataFrame([*imports, imports[0], ("p.m0", None, "a", None, 0)], "module string, target string, name string, alias string, line int")
    defined, public = {(a, b) for a, b, _ in symbols}, {(a, b) for a, b, p in symbols if p}
    names = [(mod, n) for mod in sorted({x[0] for x in imports}) for n in ["a", "b", "c", "d", "m3", "z"]]

    def resolve(mod, name):
        if (mod, name) in defined:
            return mod, name, "local"
        own = sorted((x[4], x[1], x[2], x[3]) for x in imports if x[0] == mod)
        for _, t, n, alias in own:
            if n != "*" and (alias or n) == name:
                if (t, n) in defined:
                    return t, n, "import"
                if any(d[0] == f"{t}.{n}" for d in defined):
                    return f"{t}.{n}", None, "module"
        for _, t, n, _ in own:
            if n == "*" and (t, name) in defined:
                return t, name, "wildcard"
        return None, None, None

    got = {(r.module, r.name): (r.source_module, r.source_name, r.how) for r in i.resolve_symbols(spark.createDataFrame(names, "module string, name string"), s, m).collect()}
    assert got == {k: resolve(*k) for k in names}

    def onward(mod, name):
        if (mod, name) in defined:
            return None
        return next(((t, name if n == "*" else n) for _, t, n, alias in sorted((x[4], x[1], x[2], x[3]) for x in imports if x[0] == mod) if ((alias or n) == name if n != "*" else (t, name) in public)), None)

    want = {}
    for key in {(x[0], x[3] or x[2]) for x in imports if x[2] != "*"} | {(x[0], n) for x in imports if x[2] == "*" for t, n in public if t == x[1]}:
        seen, at = [key], onward(*key)
        if at is None:
            continue
        while at and at not in seen:
            seen.append(at)
            at = onward(*at)
        end, hops = seen[-1], len(seen) - 1
        want[key] = (None, None, None, "cycle") if at else (*end, hops, "missing" if end not in defined else "too_long" if hops > 4 else "resolved")
    got = {(r.module, r.name): (r.to_module, r.to_name, r.hops, r.state) for r in i.resolve_aliases(s, m, longest=4).collect()}
    assert got == want and {"resolved", "too_long", "missing"} <= {w[3] for w in want.values()}


def test_no_imports(spark):
    s = spark.createDataFrame([("a", "b", True)], "module string, name string, public boolean")
    m = spark.createDataFrame([], "module string, target string, name string, alias string, line int")
    assert i.resolve_aliases(s, m).count() == 0
    assert [tuple(r) for r in i.resolve_symbols(s.limit(1), s, m).collect()] == [("a", "b", "a", "b", "local")]
