"""Rules that keep the corpus operators fit for a cluster."""

import pathlib
import re

import verdance
from verdance.llm import queries as llm

ROOT = pathlib.Path(verdance.__file__).parent


def test_nothing_else_imports_the_subpackage():
    for p in ROOT.rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"(from|import)\s+\S*\bllm\b", p.read_text()), p


def test_no_local_state_or_cross_joins():
    for p in (ROOT / "llm").glob("*.py"):
        text = p.read_text()
        for word in ("localCheckpoint", "crossJoin", "tempfile", ".rdd", ".sample("):
            assert word not in text, (p, word)


def test_ten_queries():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in llm.queries()) == list(range(1, 11))


def test_native_operators_stay_native(spark, sf_dir):
    for name in ("op6_sharding", "op8_secrets"):
        plan = llm.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name
