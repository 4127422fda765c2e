import json

import pytest

from peergauge.sources.page_fields import field_drift, read_unknown_fields


def _page(folder, name, *sources, **more):
    hits = {"hits": {"hits": [{"_source": s} for s in sources]}, **more}
    (folder / name).write_text(json.dumps(hits, indent=1))


@pytest.fixture
def landed(tmp_path):
    _page(tmp_path, "page_2.json", {"complaint_id": "1", "zip_code": "00501"}, {"complaint_id": "2"})
    _page(tmp_path, "page_9.json")
    _page(
        tmp_path,
        "page_10.json",
        {"complaint_id": 3, "zip_code": 501, "team": {"name": "é"}, "odd name.x": [1, None]},
        {"complaint_id": None, "zip_code": None, "team": False, "score": 1.5},
    )
    return str(tmp_path)


def test_unknown_fields_are_kept(spark, landed):
    rows = read_unknown_fields(spark, landed).orderBy("_page", "_position").collect()
    found = [(r.complaint_id, r.unknown and json.loads(r.unknown.toJson())) for r in rows]
    assert found == [
        ("1", None),
        ("2", None),
        ("3", {"team": {"name": "é"}, "odd name.x": [1, None]}),
        (None, {"team": False, "score": 1.5}),
    ]


def test_drift_tells_added_and_retyped_fields(spark, landed):
    got = {(r.field, r.kind): tuple(r)[2:] for r in field_drift(spark, landed).collect()}
    two, ten = (f"page_{n:020}.json" for n in (2, 10))
    assert got == {
        ("complaint_id", "text"): (True, 2, two, two),
        ("complaint_id", "number"): (True, 1, ten, ten),
        ("complaint_id", "null"): (True, 1, ten, ten),
        ("zip_code", "text"): (True, 1, two, two),
        ("zip_code", "number"): (True, 1, ten, ten),
        ("zip_code", "null"): (True, 1, ten, ten),
        ("team", "object"): (False, 1, ten, ten),
        ("team", "truth"): (False, 1, ten, ten),
        ("odd name.x", "list"): (False, 1, ten, ten),
        ("score", "number"): (False, 1, ten, ten),
    }


@pytest.mark.parametrize("broken", ['{"hits": {"hits": [{', '{"error": "too many"}'])
def test_unsound_pages_fail(spark, tmp_path, broken):
    (tmp_path / "page_1.json").write_text(broken)
    with pytest.raises(Exception, match="(?i)malformed|reports an error"):
        field_drift(spark, str(tmp_path)).collect()


def test_no_hits_give_no_rows(spark, tmp_path):
    _page(tmp_path, "page_1.json")
    assert field_drift(spark, str(tmp_path)).count() == 0
    assert read_unknown_fields(spark, str(tmp_path)).count() == 0
