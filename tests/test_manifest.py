"""Key fallbacks of annotation records, each with its literal outcome."""

import json
import uuid

import pytest

from trackloom.session import shared_dir
from trackloom.sources import manifest


@pytest.fixture
def records(spark):
    def build(rows):
        path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
        spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string").write.text(path)
        return manifest.read_records(spark, path)

    return build


def test_every_fallback(records):
    images = [
        {"id": 1, "file_name": "a/00/0007.png", "video_id": 9},
        {"id": 2, "file_name": "deep/b/01/12.jpg"},
        {"id": 3, "file_name": "c/x/y/5.jpg", "frame": None},
        {"id": 4, "file_name": "lone.jpg", "frame_index": "3", "seq": "\\d\\00"},
        {"id": 5, "file_name": "only_name.jpg"},
        {"id": 6, "file_name": "e/00/8.jpg", "frame_id": "no number", "frame": 4},
    ]
    videos = [{"id": 9, "name": "", "video_name": "/v/01/"}]
    annotations = [
        {"id": 10, "image_id": 1, "track_id": "", "object_id": 5, "bbox": [0, 0, 2, 4]},
        {"id": 11, "image_id": 2, "bbox": [1, 1, 1]},
        {"id": 12, "image_id": 3, "track_id": 1, "frame": 77, "bbox": ["1", "2", "x", "4"]},
        {"id": 13, "image_id": 4, "instance_id": "i", "bbox": [1, 2, 4, 6]},
        {"id": 14, "image_id": 5, "track_id": 1},
        {"id": 15, "image_id": 5, "track_id": 1, "video": "named", "frame_number": 2},
        {"id": 16, "image_id": 404, "track_id": 1, "sequence": "none", "file_name": "k/9.jpg"},
        {"id": 17, "image_id": 6, "target_id": "t", "bbox": [0, 0, 1, 1]},
        {"id": 18, "image_id": 1, "track_id": "5", "bbox": [9, 9, 9, 9]},
        {"image_id": 1, "track_id": "z"},
        {"image_id": 1},
    ]
    got = {(r.sequence, r.track_id, r.frame_id): (r.cx, r.cy) for r in manifest.annotation_records(records([*annotations, "[1, 2]", "not json", ""]), records(images), records(videos)).collect()}
    assert got == {
        ("v", "5", 7): (1.0, 2.0),  # the earlier of ids 10 and 18
        ("b", "11", 12): (None, None),
        ("c", "1", 5): (None, None),
        ("d", "i", 3): (3.0, 5.0),
        ("named", "1", 2): (None, None),
        ("none", "1", 9): (None, None),
        ("e", "t", 4): (0.5, 0.5),
        ("v", "z", 7): (None, None),
    }


def test_union_and_pairs(spark, records):
    image = [{"id": 1, "file_name": "s/00/1.jpg"}]
    one = manifest.annotation_records(records([{"id": 1, "image_id": 1, "track_id": "a"}, {"id": 2, "image_id": 1, "track_id": "b"}]), records(image), records([]))
    two = manifest.annotation_records(records([{"id": 1, "image_id": 1, "track_id": "b"}, {"id": 2, "image_id": 1, "track_id": "c"}]), records(image), records([]))
    union = manifest.manifest(one, two)
    assert {(r.track_id, r.has_rgb, r.has_thermal) for r in union.collect()} == {("a", True, False), ("b", True, True), ("c", False, True)}
    assert [r.track_id for r in manifest.manifest(one, two, paired=True).collect()] == ["b"]
    row = manifest.manifest_summary(union).first()
    assert (row.num_observation_keys, row.num_paired_annotations, row.rgb_annotation_coverage) == (3, 1, pytest.approx(2 / 3))
