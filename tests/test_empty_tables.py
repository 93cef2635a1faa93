"""Every query of the catalogue on empty tables and on tables whose columns are all null."""

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module", params=["empty", "nulls"])
def folder(request, tmp_path_factory):
    d = tmp_path_factory.mktemp(request.param)
    for p in glob.glob(f"{DATA}/*.parquet"):
        s = pq.read_schema(p)
        n = 0 if request.param == "empty" else 20
        pq.write_table(pa.table([pa.nulls(n, f.type) for f in s], schema=pa.schema([pa.field(f.name, f.type) for f in s])), d / os.path.basename(p))
    return str(d)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_runs(spark, folder, name):
    entry.queries()[name](spark, folder).collect()
