"""Every registered query against its SQL on the smallest tables; the package without its llm part."""

import math
import shutil
import subprocess
import sys

import duckdb
import pytest

from larder.plans import catalog
from tests.conftest import DATA, ROOT

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, int):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/sf0.001/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, tiny, name):
    df = catalog.QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.SQL:
        assert got
        return
    result = duck.execute(catalog.SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)


def test_everything_else_works_without_the_llm_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=lambda d, names: [n for n in names if n in ("llm", "corpus_pipeline.py", ".git", "__pycache__")])
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n[:2] == 'op' and n[2:3].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
