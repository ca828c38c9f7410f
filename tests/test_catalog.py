"""Every registered query of the library against its DuckDB oracle, whatever the partitioning."""

import zlib

import duckdb
import pytest

from evidencelake.plans import catalog, documents, library, linking, manuscripts, records  # noqa: F401 (they register their queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(c, sql, columns):
    return sorted(map(repr, c.execute(f"select {', '.join(columns)} from ({sql})").fetchall()))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_oracle(spark, duck, name):
    """By one, three or seven partitions, as the name has it."""
    spark.conf.set("spark.sql.shuffle.partitions", ("1", "3", "7")[zlib.crc32(name.encode()) % 3])
    mine = catalog.QUERIES[name](spark, SF).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    columns = [f'"{c}"' for c in sorted(mine.columns)]
    if len(mine):
        duck.register("mine", mine)
        assert rows(duck, "select * from mine", columns) == rows(duck, catalog.ORACLES[name], columns)
    else:
        assert not duck.execute(catalog.ORACLES[name]).fetchall()
