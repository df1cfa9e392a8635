"""The pipeline on awkward and empty tables, and the one query that SQL can express."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import cases  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from meshlight.session import written  # noqa: E402
from tools.check_oracles import compare, connect  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, empty, tmp_path):
    docs = written(cases.table(spark, empty), "cases")
    labels = spark.createDataFrame([(i, int(i == 18), int(i == 18)) for i in range(22)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
        assert docs.columns == columns
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    if empty:
        assert not pieces
        return
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are absent")
def test_url_filter_oracle(spark):
    outcome, rows = compare(spark, connect(SF_DIR), SF_DIR, "op9_url_filters")
    assert outcome == "match" and rows > 0


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names}
