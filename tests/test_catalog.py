"""Every core query with SQL against DuckDB on the smallest tables; those without give rows of a stable schema."""

import glob
import math
import os

import duckdb
import pytest

from corpusmill.plans import catalog

Q, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def norm(df):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(one, r)) for r in df.astype(object).where(df.notna(), None).values.tolist())


def same(a, b):
    return [(x, y) for x, y in zip(a, b) if x != y]


@pytest.mark.parametrize("name", sorted(n for n in Q if n in SQL))
def test_matches_sql(spark, sf_dir, con, name):
    got, want = norm(Q[name](spark, sf_dir).toPandas()), norm(con.execute(SQL[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])

    def number(v):
        try:
            return float(v)
        except ValueError:
            return v

    for x, y in same(got[1], want[1]):
        for p, q in zip(x, y):
            a, b = number(p), number(q)
            assert a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-6 * max(1.0, abs(a))), (x, y)


def test_queries_without_sql():
    """Those that read markup by a tree, the layout, and packed values: each is tested on a fixture."""
    assert set(Q) - set(SQL) == {"ext_paragraphs", "ext_links", "ext_index", "ext_tables", "grf_layout", "p5_found", "p5_values"}


PAGE = '<h2>T</h2><p><a name="n1"></a>1 x <a href="a.htm#f">y</a><p>z<ul><li><a href="b.htm">B</a> <a href="1.htm">1</a> <a href="2.htm">2</a></ul><table><tr><td>a<td>b<tr><td>c</table>'
#: What each gives for pages 1 (PAGE), 2 (no markup) and 3 (null content).
WANT = {
    "ext_paragraphs": [(1, 0, "n1", "1 x y", 1, 1), (1, 1, None, "z", 0, 0)],
    "ext_links": [(1, k, f"https://h.example/d/{x}.htm") for k, x in enumerate("ab12")],
    "ext_index": [(1, 0, "B 1 2", "https://h.example/d/b.htm", 2)],
    "ext_tables": [(1, 0, "a", "b"), (1, 1, "c", "c")],
}


@pytest.mark.parametrize("name", sorted(WANT))
def test_markup_queries(spark, tmp_path, name):
    rows_ = [(1, PAGE, "https://h.example/d/p.htm"), (2, "plain words", None), (3, None, None)]
    spark.createDataFrame(rows_, "page_id long, content string, url string").write.parquet(f"{tmp_path}/source_pages.parquet")
    assert sorted(tuple(r) for r in Q[name](spark, str(tmp_path)).collect()) == WANT[name]


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(Q)
