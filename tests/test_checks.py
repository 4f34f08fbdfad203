"""A cross-section of the registered queries against DuckDB on the smallest tables."""

import os

import pytest

from checks.compare import check, connect

SF = "/root/testdata/sf0.001"
NAMES = [
    "flagship_source_report", "w01_gae", "w04_grpo_passk", "w13_tir_optimal_token_baseline", "c04_rollout_correction",
    "l06_loss_kl_cov", "e01_validation_metrics", "b16_sample_level_repeat", "p12_split_content_parts", "r19_box_match_eval",
    "k07_micro_batches", "q11_prefix_group_rows", "t06_interleave_cycle", "x02_bm25_topk", "z02_take_required",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not provided here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    from __spark_entry__ import oracle_sql, queries

    status, _, _, _, note = check(spark, duck, SF, name, queries()[name], oracle_sql()[name])
    assert status == "ok", note


def test_every_query_has_sql_and_entry_runs(spark):
    from __spark_entry__ import CORPUS_QUERIES, entry, oracle_sql, queries

    assert set(queries()) - set(CORPUS_QUERIES) == set(oracle_sql()) - set(CORPUS_QUERIES)
    assert entry(spark).count() > 0
