"""Queries against their SQL on a stack whose last section is short and whose others have holes."""

import os

import duckdb
import pytest

from lamella.plans import catalogue, catalogue_files  # noqa: F401
from test_catalogue import same

NAMES = [
    "command_stack_to_images",
    "image_file_list",
    "image_file_pattern",
    "mrc_big_endian",
    "mrc_header_fields",
    "mrc_point",
    "mrc_roundtrip",
    "mrc_shape",
    "mrc_step",
    "mrc_volume",
    "remove_all",
    "chain_autocrop_flip",
    "chain_autocrop_pad",
    "chain_autocrop_sigma",
    "chain_demo",
    "command_images_to_stack",
    "image_tags",
    "pad_fixed",
]


@pytest.fixture(scope="module")
def tables(data, tmp_path_factory):
    """506 vectors without some inside sections, at the head of one and at the end of one."""
    folder = tmp_path_factory.mktemp("missing")
    for f in os.listdir(data):
        if f != "embeddings.parquet":
            os.symlink(f"{data}/{f}", folder / f)
    e = f"read_parquet('{data}/embeddings.parquet')"
    duckdb.sql(f"COPY (SELECT * FROM {e} WHERE vec_id NOT IN (57, 58, 150, 249, 310) UNION ALL SELECT vec_id + 500, embedding, label FROM {e} WHERE vec_id < 6) TO '{folder}/embeddings.parquet'")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in os.listdir(folder):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{t}')")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_missing_vectors(spark, tables, name):
    folder, con = tables
    got, want = catalogue.QUERIES[name](spark, folder).toPandas(), con.sql(catalogue.ORACLES[name]).df()
    same(got.convert_dtypes(), want.convert_dtypes())  # a null makes a column of integers one of floats


def test_long_numbers(spark, data, tmp_path):
    """Names of six digits are shown cut to five, but every file counts by its own number."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT p.* REPLACE (p_partkey + k * 99950 AS p_partkey) FROM read_parquet('{data}/part.parquet') p, range(2) t(k)) TO '{tmp_path}/part.parquet'")
    con.sql(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet')")
    same(catalogue.QUERIES["command_unlisted"](spark, str(tmp_path)).toPandas(), con.sql(catalogue.ORACLES["command_unlisted"]).df())
