"""The jobs from end to end on small files."""

import json

from threadlens.__main__ import main


def test_titles(spark, tmp_path, capsys):
    said = ["Solo Leveling is peak", "it's called Solo Leveling", {"id": "x", "author": "me", "text": "what is the name of this?", "likes": 2}, "movie name: Quiet Harbour Lights"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "v1.json").write_text(json.dumps(said))
    assert main(["titles", str(tmp_path / "in"), "--json", "--out", str(tmp_path / "out")], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["comments_read"] == 4 and got["asked_by"] == 1
    assert [(t["canonical"], t["commenters"]) for t in got["titles"]] == [("Solo Leveling", 2)]
    assert {d["title"] for d in got["discovered"]} == {"Solo Leveling", "Quiet Harbour Lights"}
    assert got["answers"][0]["title"] == "Solo Leveling" and got["answers"][0]["video_id"] == "v1"
    assert {r.title for r in spark.read.json(str(tmp_path / "out" / "answers")).collect()} >= {"Solo Leveling"}
    assert spark.read.json(str(tmp_path / "out" / "demand")).first().asked == 1


def test_report(spark, tmp_path, capsys):
    answer = {"title": "Quiet Harbour Lights", "conf": "high", "sources": ["comments:3"], "commenters": 3, "likes": 4, "alternates": []}
    sweep = [{"vid": f"v{i}", "query": "movie recap", "title": "t", "asked": 1, "views": 10, "n_comments": 5, "langs": {"es": 3}, "answers": [answer]} for i in range(3)]
    (tmp_path / "sweep.json").write_text(json.dumps(sweep))
    assert main(["report", str(tmp_path / "sweep.json"), "--out", str(tmp_path / "out")], spark) == 0
    shown = capsys.readouterr().out
    assert "Quiet Harbour Lights" in shown and "1 unconfirmed, 0 rejected" in shown
    row = spark.read.json(str(tmp_path / "out" / "titles")).first()
    assert (row.title, row.videos, row.commenters) == ("Quiet Harbour Lights", 3, 9)
    assert "Quiet Harbour Lights" in "".join(r.value for r in spark.read.text(str(tmp_path / "out" / "page")).collect())
