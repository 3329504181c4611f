import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from shapewright.plans.queries import QUERIES, SQL, TABLES
from shapewright.plans.scan import scan
from shapewright.sources.listing import expand
from tests.oracle import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_duckdb(spark, name):
    got, columns = spark_rows(QUERIES[name](spark, SF))
    want, names = duck_rows(connect(SF), SQL[name])
    assert columns == names
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 14
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


#: Queries that read the folder of tables as a fileset.
OVER_TABLES = [
    "accounting",
    "name_mode_diff",
    "parquet_schema_profile",
    "position_name_swap",
    "scan_verdicts",
    "structural_relation_pairs",
    "check_partition",
    "describe_diff",
    "position_mode_diff",
    "rename_evidence",
]


@pytest.fixture(scope="module")
def in_parts(tmp_path_factory):
    """The tables of sf0.001, each a folder: one of two parts with files that are no data, one a link; and their views."""
    top = tmp_path_factory.mktemp("parts")
    con = duckdb.connect()
    for t in TABLES:
        rows = pq.read_table(f"/root/testdata/sf0.001/{t}.parquet")
        at = top / "elsewhere" / t if t == "orders" else top / "sf" / f"{t}.parquet"
        at.mkdir(parents=True)
        cut = rows.num_rows // 2 if t == "documents" else rows.num_rows
        for i, part in enumerate((rows.slice(0, cut), rows.slice(cut))):
            if part.num_rows:
                pq.write_table(part, at / f"part-{i}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/part-*.parquet')")
    (top / "sf" / "orders.parquet").symlink_to(top / "elsewhere" / "orders")
    (top / "sf" / "documents.parquet" / "_SUCCESS").write_text("")
    (top / "sf" / "documents.parquet" / ".part-0.parquet.crc").write_text("x")
    return str(top / "sf"), con


@pytest.mark.parametrize("name", OVER_TABLES)
def test_tables_that_are_folders(spark, in_parts, name):
    sf, con = in_parts
    got, columns = spark_rows(QUERIES[name](spark, sf))
    want, names = duck_rows(con, SQL[name])
    assert columns == names
    assert got == want


def test_a_table_whose_parts_differ(spark, tmp_path):
    at = tmp_path / "t.parquet"
    at.mkdir()
    pq.write_table(pa.table({"a": [1, 2]}), at / "0.parquet")
    pq.write_table(pa.table({"a": [3]}), at / "1.parquet")
    row = scan(spark, f"{tmp_path}/*.parquet").verdicts.first()
    assert (row.path, row.bucket, row.raw_names, row.row_count_estimate, row.size_bytes) == (str(at), "profiled", ["a"], 3, sum(p.stat().st_size for p in at.iterdir()))
    assert scan(spark, f"{tmp_path}/**/*.parquet").verdicts.count() == scan(spark, str(tmp_path)).verdicts.count() == 2  # the parts themselves are meant
    pq.write_table(pa.table({"b": ["x"]}), at / "2.parquet")
    row = scan(spark, f"{tmp_path}/*.parquet").verdicts.first()
    assert row.bucket == "degraded" and row.error == "2.parquet has other columns than 0.parquet"


#: Queries over tables whose folder is given as Hadoop writes it, file:/x.
OVER_FILE_URI = [
    "parquet_schema_profile",
    "position_name_swap",
    "scan_verdicts",
    "structural_relation_pairs",
    "check_partition",
    "describe_diff",
    "position_mode_diff",
]


@pytest.mark.parametrize("name", OVER_FILE_URI)
def test_tables_by_a_path_with_a_scheme(spark, in_parts, name):
    sf, con = in_parts
    got, columns = spark_rows(QUERIES[name](spark, f"file:{sf}"))
    want, names = duck_rows(con, SQL[name])
    assert columns == names
    assert got == want


def test_paths_without_the_store(spark, tmp_path):
    pq.write_table(pa.table({"a": [1]}), tmp_path / "t.parquet")
    size = (tmp_path / "t.parquet").stat().st_size
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.spelled.link./in", f"file://{tmp_path}")
    conf.set("fs.defaultFS", "viewfs://spelled")
    try:
        for given in ("viewfs:/in/*.parquet", "viewfs:///in/*.parquet", "viewfs://spelled/in/*.parquet", "viewfs:///in//t.parquet", "viewfs:///in/"):
            assert expand(spark, given) == [("viewfs://spelled/in/t.parquet", size)]
        for given in (f"file:{tmp_path}/*.parquet", f"file://{tmp_path}/*.parquet", f"{tmp_path}/*.parquet"):
            assert expand(spark, given) == [(f"{tmp_path}/t.parquet", size)]
    finally:
        conf.unset("fs.defaultFS")
