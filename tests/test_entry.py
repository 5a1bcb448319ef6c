"""Every registered query against its SQL on the small tables, and the parts around them."""

import pytest
from conftest import got
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import compare, database
from tributary import schema
from tributary.sources import corpus
from tributary.stages import Stage, choose, run_stages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    result, *_ = compare(spark, con, name, SF)
    assert result.startswith(("ok", "rows")), result


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert not entry.entry(spark).isEmpty()


def test_schemas(spark):
    assert len(schema.schema_of("reports")) == 19
    assert {name for name in schema.SCHEMAS if schema.schema_of(name)} == set(schema.SCHEMAS)


def test_stages(table):
    def bad(tables):
        return tables, tables["blocks"].filter("func_id = 2").select("func_id", F.lit("broken").alias("reason"))

    known = {"a": Stage("a", bad), "b": Stage("b", lambda tables: (tables, None), ("a",))}
    with pytest.warns(UserWarning):
        assert [s.name for s in choose(["a", "x", "b"], known)] == ["a", "b"]
    with pytest.raises(ValueError):
        choose(["b"], known)
    blocks = table("func_id bigint, block string", [(1, "x"), (2, "y")])
    left, done = run_stages({"blocks": blocks}, blocks.select("func_id"), choose(["a", "b"], known))
    assert got(left["blocks"], "func_id") == {1}
    assert got(done, "func_id", "failure_origin") == {(1, None), (2, "a")}


def test_files(spark, table, tmp_path):
    (tmp_path / "one.bin").write_bytes(b"abc")
    samples = corpus.read_samples(spark, str(tmp_path))
    functions = samples.select("sample_id", F.lit("main").alias("name"), F.lit("FunctionSymbol").alias("symbol_type"))
    info = corpus.sample_info(samples, functions).first()
    assert (info.sample_name, info.total, info.analysable) == ("one.bin", 1, 1)
    assert info.sample_hash == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
