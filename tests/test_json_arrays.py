"""Array files by byte ranges: the objects that a whole parse gives, wherever the ranges cut."""

import json
import random

import pytest

from pricelens.operators import training as TR
from pricelens.sources import json_arrays as J

random.seed(9)
TEXTS = ["plain", "", 'a "quoted" word', "back\\slash", "\\\\\\", '\\"', "{[}]", '"}],{"', "é🙂₵", "line\nbreak", '{"text": "inner"}', "\\" * 31, '"training_data": [{"x": 1}]']


def example(i):
    x = {"text": random.choice(TEXTS) + str(i), "query": random.choice(TEXTS)}
    if random.random() < 0.4:
        x["product_data"] = {random.choice(TEXTS): [random.choice(TEXTS), {"deep": [[{}]]}], "n": i / 7}
    return x


def objects(path, step):
    """Both passes without Spark, as the readers do them."""
    size = path.stat().st_size
    rows = [next(J._Scan([]).read(J.Range(str(path), s, min(s + step, size)))) for s in range(0, size, step)]
    out, inside, stack = [], False, []
    for (p, s, odd, a, b) in rows:
        out += [json.loads(v) for v, in J._Objects([], "training_data").read(J.Range(p, s, min(s + step, size), inside, list(stack)))]
        closed, left = json.loads(b if inside else a)
        stack = [*stack[:max(0, len(stack) - closed)], *map(tuple, left)]
        inside ^= odd
    return out


@pytest.mark.parametrize("indent, ascii_only", [(None, True), (None, False), (2, False)])
def test_every_cut_gives_the_same_objects(tmp_path, indent, ascii_only):
    rows = [example(i) for i in range(30)]
    docs = [rows, {"metadata": {"sites": [{"name": "x"}], "note": "[{"}, "training_data": rows}, {"training_data": rows, "other": [{"a": 1}], "training_datb": [{}]},
            [], {"training_data": []}, {"metadata": {}}, [1, "x", [{"no": "element"}], rows[0], None, rows[1]]]
    wants = [rows, rows, rows, [], [], [], rows[:2]]
    for doc, want in zip(docs, wants):
        path = tmp_path / "f.json"
        path.write_text(json.dumps(doc, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
        for step in (1 << 20, 997, 64, 7, 3) if len(want) < 10 or indent is None else (1 << 20, 211, 13):
            assert objects(path, step) == want, step
        if not want:
            assert objects(path, 1) == want


def test_ranges_become_tasks(spark, tmp_path):
    rows = [example(i) for i in range(5_000)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows if name == "a" else {"training_data": rows}, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "_ignored.json").write_text("[{}]")
    got = J.read_json_array(spark, str(tmp_path), range_bytes=20_000)
    assert got.rdd.getNumPartitions() > 20
    want = sorted(json.dumps(r, sort_keys=True) for r in rows * 2)
    assert sorted(json.dumps(json.loads(r.value), sort_keys=True) for r in got.collect()) == want
    whole = J.read_json_array(spark, str(tmp_path))
    assert sorted(json.dumps(json.loads(r.value), sort_keys=True) for r in whole.collect()) == want


def test_number_of_files_follows_bytes(spark, tmp_path):
    data = spark.range(3_000).selectExpr("concat('text ', id) AS text", "'q' AS query", "'s' AS source", "'' AS timestamp", "map('k', 'v') AS product_data")
    TR.write_training_documents(data, str(tmp_path / "one"))
    TR.write_training_documents(data, str(tmp_path / "many"), file_bytes=50_000)
    parts = {n: [json.loads(p.read_text()) for p in (tmp_path / n).glob("part-*")] for n in ("one", "many")}
    assert len(parts["one"]) == 1 and 3 < len(parts["many"]) < 12
    assert all(len(d["training_data"]) == d["metadata"]["total_examples"] for d in parts["many"])
    for n in parts:
        back = TR.read_training_set(spark, str(tmp_path / n), layout="document", range_bytes=10_000)
        assert sorted(r.text for r in back.collect()) == sorted(f"text {i}" for i in range(3_000))
    TR.write_training_documents(data.limit(0), str(tmp_path / "none"))
    assert TR.read_training_set(spark, str(tmp_path / "none"), layout="document").count() == 0


def test_primary_or_fallback(spark, tmp_path):
    (tmp_path / "main.json").write_text(json.dumps([{"text": "m", "query": "q"}]))
    (tmp_path / "other.json").write_text(json.dumps({"training_data": [{"text": "o", "query": "q"}]}))
    main, other = str(tmp_path / "main.json"), str(tmp_path / "other.json")
    read = lambda *a: [r.text for r in TR.read_training_set(spark, a[0], layout="document", fallback=a[1]).collect()]
    assert read(main, other) == ["m"] and read(str(tmp_path / "none.json"), other) == ["o"]
    with pytest.raises(FileNotFoundError):
        read(str(tmp_path / "none.json"), str(tmp_path / "nor.json"))
