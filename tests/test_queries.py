"""Every query with SQL against DuckDB at sf0.001; the others must run."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera import queries as core

from .oracle import connection, same

SF = "/root/testdata/sf0.001"
MAY_BE_EMPTY = {"g10_retention_unprotected"}
CONVERSATIONS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    n = same(spark, SF, core.QUERIES[name], core.ORACLE_SQL[name], duck)
    assert n or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def many_pairs(spark, tmp_path_factory):
    """sf0.001 with embeddings of 1,476 pairs: 1,225 of one group of 50, then 250, then the best one."""
    folder = tmp_path_factory.mktemp("many")
    for table in Path(SF).iterdir():
        if table.name != "embeddings.parquet":
            (folder / table.name).symlink_to(table)

    def vector(**at):
        return [float(at.get(f"d{k}", 0)) for k in range(560)]

    rows = [(vector(d0=4, **{f"d{k}": 1}), 0) for k in range(1, 51)]
    for k in range(250):
        rows += [(vector(**{f"d{2 * k}": 1}), 5), (vector(**{f"d{2 * k}": 1, f"d{2 * k + 1}": 0.3}), 5)]
    rows += [(vector(d7=1), 9)] * 2
    names = [k for k in range(10 * len(rows)) if k % 10][: len(rows)]  # multiples of ten get a near copy in the view
    schema = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").schema
    spark.createDataFrame([(n, e, label) for n, (e, label) in zip(names, rows, strict=True)], schema).write.parquet(str(folder / "embeddings.parquet"))
    return str(folder), [f"n{k:08d}" for k in names]


def test_all_pairs_have_no_cap(spark, many_pairs):
    assert same(spark, many_pairs[0], core.QUERIES["d02_all_pairs"], core.ORACLE_SQL["d02_all_pairs"], connection(many_pairs[0])) == 1225 + 250 + 1


def test_greedy_merges_have_no_cap(spark, many_pairs):
    folder, names = many_pairs
    got = core.QUERIES["d05_greedy_merges"](spark, folder).collect()
    left = set(names) - {r["merge_id"] for r in got}
    assert len(got) == 49 + 250 + 1 and len(left) == len(names) - len(got)
    assert [len(left & set(part)) for part in (names[:50], names[50:-2], names[-2:])] == [1, 250, 1]


def test_report_finds_the_best_of_all_pairs(spark, many_pairs):
    folder, names = many_pairs
    best = core.QUERIES["z02_report"](spark, folder).filter("what = 'pair'").orderBy(F.desc("value")).first()
    assert (best["a"], best["b"], best["value"]) == (names[-2], names[-1], 1.0)


@pytest.fixture(scope="module")
def in_folders(spark, tmp_path_factory):
    """sf0.001 with conversations and events as folders of several files."""
    folder = tmp_path_factory.mktemp("folders")
    for table in Path(SF).iterdir():
        if table.stem in ("conversations", "events"):
            spark.read.parquet(str(table)).repartition(3).write.parquet(str(folder / table.name))
        else:
            (folder / table.name).symlink_to(table)
    return str(folder)


@pytest.mark.parametrize("name", ["e01_ingest", "e03_turn_counts", "e14_tumbling"])
def test_streams_read_tables_that_are_folders(spark, in_folders, name):
    assert same(spark, in_folders, core.QUERIES[name], core.ORACLE_SQL[name], connection(in_folders))


def with_conversations(folder, *parts):
    """folder gets the tables of sf0.001, but conversations of these rows, a file for each part."""
    for table in Path(SF).iterdir():
        if table.name != "conversations.parquet":
            (folder / table.name).symlink_to(table)
    (folder / "conversations.parquet").mkdir()
    for k, rows in enumerate(parts):
        table = pa.table(dict(zip(("conv_id", "turn", "role", "text"), zip(*rows, strict=True), strict=True)), CONVERSATIONS)
        pq.write_table(table, folder / "conversations.parquet" / f"part-{k}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["e01_ingest", "e03_turn_counts"])
def test_messages_with_nulls_and_other_spaces(spark, tmp_path, name):
    rows = [(1, None, "user", "last"), (1, 0, "user", "\u3000a\u00a0"), (1, 1, "user", " b\u2003"), (None, 1, "user", "d"), (None, 0, None, None), (2, 0, "user", "")]
    folder = with_conversations(tmp_path, rows[:3], rows[3:])
    assert same(spark, folder, core.QUERIES[name], core.ORACLE_SQL[name], connection(folder)) == (6 if name == "e01_ingest" else 3)


@pytest.mark.parametrize("name", ["e01_ingest", "e03_turn_counts"])
def test_streams_read_no_files_with_longer_names(spark, tmp_path, name):
    folder = with_conversations(tmp_path, [(1, 0, "user", "a")])
    (tmp_path / "conversations.parquet.old").symlink_to(f"{SF}/conversations.parquet")
    assert same(spark, folder, core.QUERIES[name], core.ORACLE_SQL[name], connection(folder)) == 1


def test_messages_of_one_turn_keep_the_table_s_order(spark, tmp_path):
    """The second file is the larger one, which Spark reads first."""
    rows = [(1, k // 500, "user", str(k)) for k in range(1000)]
    folder = with_conversations(tmp_path, rows[:100], rows[100:])
    got = core.QUERIES["e01_ingest"](spark, folder).collect()
    assert sorted((r["turn_index"], r["content"]) for r in got) == [(k, str(k)) for k in range(1000)]


def test_exploring_from_a_deprecated_node_doesn_t_show_it(spark, tmp_path):
    for table in Path(SF).iterdir():
        if table.name != "labels.parquet":
            (tmp_path / table.name).symlink_to(table)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = spark.createDataFrame([(10, 0, 0)], labels.schema)
    labels.filter("doc_id <> 10").unionByName(bad).write.parquet(str(tmp_path / "labels.parquet"))
    assert same(spark, str(tmp_path), core.QUERIES["r15_explore"], core.ORACLE_SQL["r15_explore"], connection(tmp_path))


def test_dedup_report_has_no_budgets(spark, tmp_path):
    """1,020 pairs of vectors with their near copies, which is more than a pass of the engine merges."""
    for table in Path(SF).iterdir():
        if table.name != "embeddings.parquet":
            (tmp_path / table.name).symlink_to(table)
    schema = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").schema
    rows = [(10 * k, [float(k // 10 == j) for j in range(102)], k % 10) for k in range(1020)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert same(spark, str(tmp_path), core.QUERIES["d06_dedup_report"], core.ORACLE_SQL["d06_dedup_report"], connection(tmp_path))
