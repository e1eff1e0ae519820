"""Layer folders with whole and broken files, and edits of their features."""

import json
import struct

from pyspark.sql import functions as F

from skyledger.functions import payload
from skyledger.operators import patches
from skyledger.sources import images, layer_store

POINT = {"type": "Point", "coordinates": [1, 2]}
RING = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}


def test_layer_summaries(spark, tmp_path):
    root = tmp_path / "spatial_results"

    def put(name, doc):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(doc if isinstance(doc, str) else json.dumps(doc))

    put("fine.json", {"layer_name": "Trees", "display_preference": {"type": "point", "color": "#0f0", "icon": " pin ", "fields": [{"custom": False}]}, "updated_at": "t1", "spatial_results": [{"geometry": POINT, "properties": {"image_url": " a.png "}, "edited_fields": ["n"]}, {"geometry": POINT}]})
    put("none.json", {"layer_name": "Empty", "display_preference": {"type": "polygon", "color": "#00f", "fields": [{"custom": True}]}, "spatial_results": []})
    put("over.json", {"layer_name": "Photo", "display_preference": {"type": "image_overlay", "image_url": "x.png"}, "spatial_results": [{"geometry": POINT}]})
    put("broken.json", "{not json")
    put("half.json", {"layer_name": "Half", "display_preference": {"type": "point"}, "spatial_results": [{"geometry": {"type": "Cube"}}]})
    put("nameless.json", {"display_preference": {"type": "point"}, "spatial_results": []})
    put("bad id.json", {"layer_name": "x"})
    put(".hidden.json", "{")
    put("zero.json", "")
    put("deco/layer.json", {"layer_name": "Mixed layer", "display_preference": {"type": "line", "color": "#f00"}})
    put("deco/features/b.json", {"result": {"geometry": RING}})
    put("deco/features/a.json", {"result": {"geometry": POINT, "image_url": "first.png"}})
    put("deco/features/c.json", "broken")
    put("deco.json", {"layer_name": "Hidden by the folder", "display_preference": {"type": "point"}, "spatial_results": []})
    put("lost/features/a.json", {"result": {"geometry": POINT}})
    put("torn/layer.json", "[]")
    got = {r["id"]: r for r in layer_store.summaries(layer_store.documents(spark, str(root))).collect()}
    assert set(got) == {"fine", "none", "over", "broken", "half", "nameless", "zero", "deco", "lost", "torn"}
    pick = lambda k, *cols: tuple(got[k][c] for c in cols)
    assert pick("fine", "layer_name", "feature_count", "geom_type", "display_color", "icon", "thumbnail_url", "format_type", "is_corrupted", "updated_at", "has_manual_edits", "concurrency_token") == ("Trees", 2, "Point", "#0f0", " pin ", "a.png", "flat", False, "t1", True, "t1")
    assert pick("none", "feature_count", "geom_type", "has_manual_edits", "icon", "updated_at") == (0, "Polygon", True, None, None)
    assert got["none"]["concurrency_token"].startswith(f"{(root / 'none.json').stat().st_size}_")
    assert pick("over", "geom_type", "display_color", "thumbnail_url", "has_manual_edits") == ("Overlay", "#3498DB", "x.png", False)
    assert pick("deco", "layer_name", "feature_count", "geom_type", "thumbnail_url", "format_type", "is_corrupted") == ("Mixed layer", 2, "Mixed", "first.png", "decomposed", False)
    for k, said in {"broken": "Metadata rusak", "half": "Metadata rusak", "nameless": "Metadata rusak", "zero": "Metadata rusak", "torn": "Metadata rusak", "lost": "layer.json hilang"}.items():
        assert pick(k, "layer_name", "feature_count", "geom_type", "display_color", "is_corrupted", "concurrency_token", "has_manual_edits") == (f"{k} ({said})", 0, "Unknown", "#E74C3C", True, "0_0", False)


def test_patches_hold_whole_or_not_at_all(spark):
    v = lambda c: F.try_parse_json(c)
    layers = spark.createDataFrame([("a", "A", "#111111", "", "t0", "t0"), ("b", "B", "#111111", "", "t0", "t0")], "layer_id string, layer_name string, color string, icon string, updated_at string, token string")
    asked = spark.createDataFrame([("a", 1, "t0", "New", None, " pin "), ("a", 2, None, "Later", None, None), ("b", 3, "t0", "Bad edit", None, None), ("c", 4, None, "x", None, None)], "layer_id string, seq long, expected string, layer_name string, color string, icon string")
    features = spark.createDataFrame([("a", 0, None, None, False), ("a", 0, "n", "1", False), ("a", 0, "mine", '"x"', True), ("b", 0, None, None, False), ("b", 0, "n", "1", False)], "layer_id string, feature int, key string, raw string, edited boolean").select("layer_id", "feature", "key", v("raw").alias("value"), "edited")
    edits = spark.createDataFrame([("a", 1, 0, 0, "n", "2", None, False, False), ("a", 1, 1, 0, "n", "3", None, False, False), ("a", 1, 2, 0, "mine", "null", None, True, True), ("a", 1, 3, 0, "added", '"t"', "text", True, False), ("b", 3, 0, 0, "n", '"text"', None, False, False)], "layer_id string, seq long, place int, feature int, key string, raw string, field_kind string, custom boolean, remove boolean").withColumn("value", v("raw")).drop("raw")
    judged = patches.judged_edits(features, edits)
    status = patches.judged(layers, asked, judged)
    assert {r["seq"]: r["status"] for r in status.collect()} == {1: "applied", 2: "conflict", 3: "invalid", 4: "unknown"}
    assert sorted(tuple(r) for r in patches.merged(layers, asked, status, F.lit("t9")).collect()) == [("a", "New", "#111111", "pin", "t9", "t9"), ("b", "B", "#111111", "", "t0", "t0")]
    after = patches.merged_features(features, judged, status).filter("key is not null").select("layer_id", "key", F.to_json("value").alias("v"), "edited")
    assert sorted(tuple(r) for r in after.collect()) == [("a", "added", '"t"', True), ("a", "n", "3", True), ("b", "n", "1", False)]
    rules = {("n", "reserved"): "source", ("n", "no_feature"): None}
    odd = spark.createDataFrame([("a", 1, 0, 0, "source", '"x"', None, True, False), ("a", 1, 0, 7, "n", "1", None, True, False), ("a", 1, 0, 0, "n", "null", None, False, True), ("a", 1, 0, 0, "fresh", "1", "shape", False, False)], edits.drop("value").withColumn("raw", F.lit("")).select("layer_id", "seq", "place", "feature", "key", "raw", "field_kind", "custom", "remove").schema).withColumn("value", v("raw")).drop("raw")
    assert sorted(r["problem"] for r in patches.judged_edits(features, odd).collect()) == ["no_feature", "not_custom", "reserved", "unknown_kind"] and rules


def test_paths_stay_inside(spark):
    rows = [("/out", "a/b", "/out/a/b"), ("/out/", "./a//b", "/out/a/b"), ("/out", "../x", None), ("/out", "a/../../out2/x", None), ("/out", "/out/x", "/out/x"), ("/out", "/outer/x", None), ("/out", "", None), ("/out", ".", None), ("/a/../out", "x/../y", "/out/y")]
    df = spark.createDataFrame(rows, "folder string, path string, want string")
    assert df.filter(~payload.inside(F.col("folder"), F.col("path")).eqNullSafe(F.col("want"))).count() == 0


def raw_file(directories, blobs):
    """Little-endian: blobs first, then directories; values are numbers, ("blob", k) for a place, ("dirs", [k]) for places of directories."""
    at, places = 8, []
    for b in blobs:
        places.append(at)
        at += len(b)
    starts = []
    for tags, _ in directories:
        starts.append(at)
        at += 2 + 12 * len(tags) + 4
    out = b"II*\0" + struct.pack("<I", starts[0]) + b"".join(blobs)
    for tags, after in directories:
        out += struct.pack("<H", len(tags))
        for tag, value in sorted(tags.items()):
            out += struct.pack("<HHII", tag, 4, 1, places[value[1]] if isinstance(value, tuple) and value[0] == "blob" else starts[value[1]] if isinstance(value, tuple) else value)
        out += struct.pack("<I", starts[after] if after else 0)
    return out


def test_previews_of_raw_files(spark, tmp_path):
    small, middle, large, fake = b"\xff\xd8small", b"\xff\xd8middle one", b"\xff\xd8the largest of all", b"no picture at all, though long enough"
    both = [({50981: ("blob", 0), 50982: len(small), 330: ("dirs", 2)}, 1), ({513: ("blob", 1), 514: len(middle)}, None), ({513: ("blob", 2), 514: len(large)}, None)]
    files = {"three": raw_file(both, [small, middle, large]), "fake": raw_file([({513: ("blob", 0), 514: len(fake)}, None)], [fake]), "beyond": raw_file([({513: 8, 514: 10**6}, None)], [small]), "junk": b"junk", "empty": b""}
    for name, data in files.items():
        (tmp_path / f"{name}.dng").write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1][:-4]: (r["preview"] and bytes(r["preview"]), r["problem"]) for r in images.previews(images.files(spark, str(tmp_path))).collect()}
    assert got["three"] == (large, None) and got["fake"] == got["beyond"] == (None, "no_preview") and got["junk"] == (None, "not_raw") and got.get("empty", (None, "not_raw")) == (None, "not_raw")
    assert images.preview(raw_file(both[:2] + [({513: ("blob", 1), 514: len(middle)}, None)], [small, middle, large])) == middle
    assert {r["problem"] for r in images.previews(images.files(spark, str(tmp_path)), 50).filter("path like '%three%'").collect()} == {"too_large"}
