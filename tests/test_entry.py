import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names_and_sql_agree():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) >= 70


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
def test_entry(spark):
    assert [r.tier for r in entry.entry(spark).collect()]


def test_nothing_else_imports_the_llm_subpackage():
    root = os.path.join(os.path.dirname(entry.__file__), "ctxloom")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                assert "ctxloom.llm" not in open(os.path.join(folder, name)).read()
