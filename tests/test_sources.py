"""File readers on small generated trees."""

import json

import pytest
from pyspark.sql import functions as F

from trackloom.sources import readers


def test_mot_tree(spark, tmp_path):
    for seq in ("train/A", "test/B"):
        folder = tmp_path / seq / "gt"
        folder.mkdir(parents=True)
        (folder / "gt.txt").write_text("# comment\n1,7,10,20,4,6,1,1,0.5\n2,7,11,21,4,6,0,1,0.5\n3,7,12,22,4,6,1,2,0.5\n")
        (folder.parent / "seqinfo.ini").write_text("[Sequence]\nname=cam\nimDir=img1\nimExt=.png\nframeRate=25\n")
    rows = readers.read_mot_tree(spark, str(tmp_path), split="train").collect()
    assert [(r["sequence"], r["track_id"], r["frame_id"], r["x"], r["fps"], r["file"]) for r in rows] == [
        ("A", "7", 1, 10.0, 25.0, "A/img1/000001.png")
    ]
    everything = readers.read_mot_tree(spark, str(tmp_path), keep_categories=None, include_ignored=True)
    assert everything.count() == 6
    named = readers.read_mot_tree(spark, str(tmp_path), name_source="relative").select("sequence").distinct()
    assert sorted(r[0] for r in named.collect()) == ["test/B", "train/A"]
    (tmp_path / "train/A/gt/gt.txt").write_text("1,7,10\n")
    with pytest.raises(Exception, match="seven columns"):
        readers.read_mot_tree(spark, str(tmp_path), split="train").collect()


def test_annotations(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "video_id": 5, "frame_id": 3, "file_name": "v/01/x.jpg"}, {"id": 2, "video_id": 9, "frame_id": 4, "file_name": "w\\00/y.jpg"}],
        "videos": [{"id": 5, "name": "v/00", "fps": 10.0}],
        "categories": [{"id": 1, "name": "boat"}],
        "annotations": [
            {"id": 1, "image_id": 1, "track_id": 8, "bbox": [1, 2, 3, 4], "category_id": 1},
            {"id": 2, "image_id": 1, "track_id": 8, "bbox": [5, 6, 7, 8], "category_id": 1},
            {"id": 3, "image_id": 2, "track_id": 9, "bbox": [1, 1, 1, 1], "category_id": 2},
            {"id": 4, "image_id": 2, "track_id": 9, "bbox": [1, 1, 1, 1], "category_id": 2, "ignore": 1},
            {"id": 5, "image_id": 77, "track_id": 9, "bbox": [1, 1, 1, 1], "category_id": 2},
        ],
    }
    path = tmp_path / "rgb.json"
    path.write_text(json.dumps(doc))
    got = readers.read_annotations(spark, str(path), "rgb").orderBy("track_id").collect()
    assert [(r["sequence"], r["track_id"], r["frame_id"], r["x"], r["category_name"]) for r in got] == [
        ("v", "8", 3, 5.0, "boat"),
        ("w", "9", 4, 1.0, "2"),
    ]


def test_pose_log_pairs_and_places(spark, tmp_path):
    log = tmp_path / "est.log"
    log.write_text("0 1 2\n1 0 0 0.5\n0 1 0 0\n0 0 1 0\n0 0 0 1\n\n1 2 2\n0 -1 0 0\n1 0 0 0\n0 0 1 9\n0 0 0 1\n")
    rows = readers.read_pose_log(spark, str(log)).orderBy("i").collect()
    assert [(r["i"], r["j"], r["pose"][3], r["pose"][11]) for r in rows] == [(0, 1, 0.5, 0.0), (1, 2, 0.0, 9.0)]
    summary = tmp_path / "s.json"
    summary.write_text(json.dumps({"pair_results": [{"method": "icp", "batch_idx": 0, "success": True, "skipped": False}]}))
    assert readers.read_pair_results(spark, str(summary)).first()["method"] == "icp"
    (tmp_path / "@10.5@20.25@x.jpg").write_bytes(b"x")
    place = readers.read_image_places(spark, str(tmp_path)).first()
    assert (place["x"], place["y"]) == (10.5, 20.25)


def test_external_scores(spark, tmp_path):
    path = tmp_path / "out.csv"
    path.write_text("trajectory_id,final_score\n0,0.5\n1,0.25\n")
    side = spark.createDataFrame([(0, "a"), (1, "b")], "trajectory_id int, sample_id string")
    got = readers.read_external_scores(spark, str(path), "tool", side).orderBy("sample_id").collect()
    assert [(r["sample_id"], r["score"]) for r in got] == [("a", 0.5), ("b", 0.25)]
    with pytest.raises(Exception, match="no sidecar row"):
        readers.read_external_scores(spark, str(path), "tool", side.where(F.col("sample_id") == "a")).collect()
    path.write_text("id,score,anomaly_score\n0,1,2\n")
    with pytest.raises(ValueError, match="exactly one score"):
        readers.read_external_scores(spark, str(path), "tool")


def test_point_lists(spark):
    df = spark.createDataFrame([("[[1,2,3],[1,2],[4,5,6,7]]",)], "v string")
    assert [tuple(p) for p in df.select(readers.coerce_points(F.col("v"))).first()[0]] == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
