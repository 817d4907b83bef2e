"""Queries with SQL give DuckDB's rows."""

from pathlib import Path

import duckdb
import pytest
from tests.test_queries import plain

from tessera.llm.registry import oracle_sql, queries

TURNS = "conv_id long, turn long, role string, text string"


def duck(folder):
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    got, want = queries()[name](spark, sf).toPandas(), duck(sf).execute(oracle_sql()[name]).df()
    assert sorted(got) == sorted(want) and len(got) > 0 and plain(got) == plain(want)


def test_odd_turns_equal_sql(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 1, None, "x\\y"), (1, 2, "assistant", None), (1, 2, "assistant", "<|im_end|> b</s> [INST]"), (1, 2, "assistant", "<|im_end|> b</s> [INST]"), (1, None, "system", "first"), (1, 3, "ro\nle", "end\n")]
    rows += [(None, 0, "assistant", "no number"), (None, None, None, None), (2, 0, "user", "z" * 100_000), (2, 1, "assistant", "😀" * 1000), (3, 0, "assistant", ""), (4, 5, "user", "only")]
    spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS + ", piece string, example int").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries()["op6_chat_format"](spark, str(tmp_path)).toPandas()
    assert plain(got) == plain(duck(tmp_path).execute(oracle_sql()["op6_chat_format"]).df()) and len(got) == 6
