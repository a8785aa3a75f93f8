"""The base queries stay whatever is missing of the optional corpus packages."""

import os
import subprocess
import sys

import pytest

from tidewatt.catalog import ORACLE, QUERIES

CODE = """
import sys
sys.modules[{name!r}] = None
import __spark_entry__ as e
print(sorted(e.queries()), sorted(e.oracle_sql()), sep="\\n")
"""


@pytest.mark.parametrize("name", ["tidewatt.llm", "public_tokenizers", "xxhash", "tokenizers", "regex", "sentencepiece"])
def test_base_queries_without(name):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", CODE.format(name=name)], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    names, sql = (eval(line) for line in out.stdout.splitlines())
    assert set(QUERIES) <= set(names) and set(ORACLE) <= set(sql)
    if name == "tidewatt.llm":
        assert set(names) == set(QUERIES) and set(sql) == set(ORACLE)
