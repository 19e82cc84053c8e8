"""Documents of a training set: written without a shuffle, compressed, read back whole."""

import gzip
import json
import random

import pytest

import __spark_entry__ as E
from pricelens import session
from pricelens.operators import training as TR
from pricelens.sources import json_arrays as J
from tests.conftest import SMALL
from tests.test_json_arrays import example

random.seed(31)


def examples(spark, n):
    return spark.range(n).selectExpr("concat('text ', id) AS text", "'q' AS query", "'s' AS source", "'' AS timestamp", "map('k', 'v') AS product_data")


def test_training_load_writes_compressed_documents(spark, tmp_path):
    n = E.queries()["training_load"](spark, SMALL).count()
    path = next(p for p in reversed(session._SCRATCH) if "/training-docs-" in p).removeprefix("file:")
    files = [p for p, size in J.files_of(path)]
    assert files and all(p.endswith(".gz") for p in files)
    docs = [json.loads(gzip.open(p).read()) for p in files]
    assert sum(d["metadata"]["total_examples"] for d in docs) == sum(len(d["training_data"]) for d in docs) == n > 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_a_large_task_writes_several_documents(spark, tmp_path, compression):
    data = examples(spark, 3_000).union(examples(spark, 20)).coalesce(1).union(examples(spark, 5))
    TR.write_training_documents(data, str(tmp_path / "x"), 20_000, compression)
    files = list((tmp_path / "x").glob("part-*"))
    texts = [gzip.open(p, "rt").read() if compression == "gzip" else p.read_text() for p in files]
    assert len({p.name[:10] for p in files}) <= 5 and 10 < len(files) < 25  # several files of a task
    assert max(map(len, texts)) < 25_000 and sum(len(json.loads(t)["training_data"]) for t in texts) == 3_025
    back = TR.read_training_set(spark, str(tmp_path / "x"), layout="document", range_bytes=6_000)
    assert sorted(r.text for r in back.collect()) == sorted(r.text for r in data.collect())


def test_no_examples_give_one_empty_document(spark, tmp_path):
    TR.write_training_documents(examples(spark, 9).where("text = 'none'"), str(tmp_path / "x"), compression="gzip")
    assert [json.loads(gzip.open(p).read()) for p in (tmp_path / "x").glob("part-*")] == [{"training_data": [], "metadata": {"total_examples": 0}}]
    assert TR.read_training_set(spark, str(tmp_path / "x"), layout="document").count() == 0


def test_shuffles_of_the_total_are_removed(spark):
    with session.shuffles_removed(spark):
        assert spark.conf.get(session._REMOVE_SHUFFLES) == "true"
    assert spark.conf.get(session._REMOVE_SHUFFLES, None) != "true"


def test_steps_of_a_compressed_file_give_the_same_objects(tmp_path, monkeypatch):
    rows = [example(i) for i in range(60)]
    for doc in (rows, {"metadata": {"sites": [{"name": "x"}], "note": "[{"}, "training_data": rows}, {"training_data": rows, "other": [{"a": 1}]}):
        text = json.dumps(doc, ensure_ascii=False).encode()
        path = tmp_path / "f.json.gz"
        path.write_bytes(gzip.compress(text[:700]) + gzip.compress(text[700:]))  # members one after another
        for step in (1 << 20, 997, 13, 3):
            monkeypatch.setattr(J, "STEP_BYTES", step)
            assert [json.loads(v) for v, in J._Objects([], "training_data").read(J.Range(str(path), 0, J._END))] == rows, step


def test_compressed_and_plain_files_of_a_folder(spark, tmp_path):
    rows = [example(i) for i in range(2_000)]
    (tmp_path / "a.json").write_text(json.dumps(rows), encoding="utf-8")
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(json.dumps({"training_data": rows}).encode()))
    want = sorted(json.dumps(r, sort_keys=True) for r in rows * 2)
    for step in (20_000, J.RANGE_BYTES):
        got = J.read_json_array(spark, str(tmp_path), range_bytes=step)
        assert (got.rdd.getNumPartitions() > 5) == (step == 20_000)
        assert sorted(json.dumps(json.loads(r.value), sort_keys=True) for r in got.collect()) == want
