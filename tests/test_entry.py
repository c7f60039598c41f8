"""The entry points without the optional subpackage: what they register runs and agrees in names."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__
from sparksci.plans import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_imports_without_the_optional_subpackage(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("sparksci", "corpus_pipeline.py", ".git", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "sparksci").mkdir()
    for p in (ROOT / "sparksci").iterdir():
        if p.name != "llm":
            (tmp_path / "sparksci" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_entry_imports_without_a_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=ROOT, check=True)


def test_entry_goes_on_without_a_library_of_the_optional_subpackage():
    code = "import sys, warnings; sys.modules['ahocorasick'] = None; warnings.simplefilter('ignore'); import __spark_entry__ as e; q = e.queries(); assert 'describe' in q and not any(k.startswith('op1') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
