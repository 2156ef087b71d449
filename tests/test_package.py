import ast
import pathlib

import __spark_entry__ as entry
from quillspark import queries

ROOT = pathlib.Path(queries.__file__).parent


def imported(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.ImportFrom) and node.module:
            yield from (f"{node.module}.{a.name}" for a in node.names)
        elif isinstance(node, ast.Import):
            yield from (a.name for a in node.names)


def test_nothing_else_imports_the_llm_subpackage():
    for path in ROOT.rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not [m for m in imported(path) if m.startswith("quillspark.llm")], path


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(queries.QUERIES) >= 40


def test_flagship_runs(spark):
    assert {r.runner_label for r in entry.entry(spark).collect()} == {"identity", "misread", "no_points", "upper"}
