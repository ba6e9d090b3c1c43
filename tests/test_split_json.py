import json
import random

import pyarrow as pa
import pytest

from lithogrid.plans.workspace import Workspace
from lithogrid.sources import geojson, osm, split_json


def odd_feature(rng, n):
    text = rng.choice(['plain', 'qu"ote', 'brace } { ] [', 'back\\slash', 'end\\', '\\"}', 'é', '},{', '":[', ''])
    return {"type": "Feature", **({"id": n} if n % 3 else {}), "properties": {"kind": text, text: [n, {"deep": ["}", {}]}]},
            "geometry": rng.choice([None, {"type": "Point", "coordinates": [n, 1.5]}])}


def documents():
    rng = random.Random(5)
    features = [odd_feature(rng, n) for n in range(60)]
    whole = {"type": "FeatureCollection", "features": features}
    yield "plain", json.dumps(whole)
    yield "around", json.dumps({"bbox": [1, [2, {"features": [3]}]], "crs": {"features": [{"a": 1}]}, "n}ame": "}{\\\"", **whole, "tail": [{"x": 1}, 2]})
    yield "indented", json.dumps(whole, indent=2, ensure_ascii=False) + "\n"
    yield "last counts", json.dumps(whole)[:-1] + ', "features": ' + json.dumps(features[:7]) + "}"
    yield "last is null", json.dumps(whole)[:-1] + ', "features": null}'
    yield "empty", '{"features": [ ]}'
    yield "none", '{"other": [{"features": [1, 2]}]}'
    yield "scalars", '{"features": [1, "}", [2, 3], null, {"a": "]"}], "remark": "a } b"}'


def pieces_of(text, size, member="features", also=("remark",)):
    """The members that blocks of about ``size`` bytes find, put together as the tables do it."""
    cut = text.encode().split(b"}")
    if cut[-1] == b"":
        cut.pop()
    blocks, held = [], []
    for fragment in cut:
        held.append(fragment)
        if sum(map(len, held)) >= size:
            blocks.append(held)
            held = []
    blocks += [held] if held else []
    in_string, depth, found, parts, sections = False, 0, {}, [], []
    carry, now = 0, None
    for number, fragments in enumerate(blocks):
        data = b"".join(f + b"}" for f in fragments)
        walk = split_json._Walk(("f", number), member, also, in_string, depth)
        for at in range(0, len(fragments), 3):  # chunks smaller than blocks
            walk.take(b"".join(f + b"}" for f in fragments[at:at + 3]))
        rows = walk.finish()
        batch = pa.RecordBatch.from_pylist([{"value": f, "file": "f", "name": "f", "block": number} for f in fragments])
        _, _, _, quotes, outside, inside = next(split_json._summaries(iter([batch])))[0:1].to_pylist()[0].values()
        depth += inside if in_string else outside
        in_string = (quotes + in_string) % 2 == 1
        assert (walk.in_string, walk.depth) == (in_string, depth) and data
        for _, block, kind, section, n, piece, body in rows:
            if kind == "state":
                sections += [(block, s) for s in range(1, section + 1)]
                if piece == "section":
                    now, carry = (block, section), n
                elif piece == "none":
                    now, carry = None, 0
                else:
                    carry += n
                continue
            if piece in ("whole", "head"):
                where = now if kind is None else (block, section)
                parts.append([kind, where, carry + n if kind is None else n, b""])
            parts[-1][3] += body
    for kind, where, n, body in parts:
        if where is not None and (kind is None or kind == member) and sections and where == sections[-1]:
            found[n] = json.loads(body)
    return [found[n] for n in sorted(found)], sorted(found) == list(range(len(found)))


@pytest.mark.parametrize("name,text", list(documents()))
def test_blocks_of_any_size_find_the_members(name, text):
    want = json.loads(text).get("features") or []
    for size in [1, 2, 3, 5, 8, 13, 30, 100, 333, 1000, 10 ** 6]:
        found, gapless = pieces_of(text, size)
        assert found == want and gapless, size


def test_a_document_cut_at_every_offset():
    """A block border after every brace, and chunk borders within: all states that a block can start in."""
    text = json.dumps({"a": 'x"}\\', "features": [{"b\\\"}": "{[,"}, {"c": ["}", {"d": "\\\\"}]}], "e": {"f": "}"}})
    for lead in range(40):
        found, _ = pieces_of(" " * lead + text, 7)
        assert found == json.loads(text)["features"]


@pytest.fixture
def small_splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "2048")
    spark.conf.set(names[1], "1")
    yield
    for n, b in zip(names, before):
        spark.conf.set(n, b)


def test_large_collections_equal_collections(spark, tmp_path, small_splits):
    rng = random.Random(6)
    for area in ("one", "two b", "three.x"):
        features = [odd_feature(rng, n) for n in range(rng.randint(100, 200))]
        (tmp_path / f"{area}.json").write_text(json.dumps({"x": {"y": "}"}, "features": features, "z": [{}]}))
    (tmp_path / "none.json").write_text('{"features": []}')
    path = f"{tmp_path}/*.json"
    columns = ["area_id", "pos", "id", "has_id", "to_json(properties) AS properties", "to_json(geometry) AS geometry"]
    want = sorted(map(tuple, geojson.read_collections(spark, path).selectExpr(*columns).collect()), key=repr)
    lines = spark.read.option("lineSep", "}").text(path)
    assert lines.rdd.getNumPartitions() >= 8
    got = geojson.read_large_collections(spark, path)
    assert got.columns == geojson.read_collections(spark, path).columns
    assert sorted(map(tuple, got.selectExpr(*columns).collect()), key=repr) == want


def test_large_extracts_equal_extracts(spark, tmp_path, small_splits):
    def element(n):
        return {"type": "way", "id": n, "tags": {"building": "ye}s\\", "n": str(n)} if n % 4 else None,
                "geometry": [{"lon": n, "lat": k} for k in range(n % 5)]}

    documents = {"a": {"version": 0.6, "elements": [element(n) for n in range(150)], "remark": 'timed "out" } early'},
                 "b": {"elements": [element(n) for n in range(90)]}, "c": {"remark": "", "elements": []}, "d": {"remark": 7}}
    for area, document in documents.items():
        (tmp_path / f"{area}.json").write_text(json.dumps(document))
    path = f"{tmp_path}/*.json"
    whole = osm.read_extracts(spark, path)
    remarks, elements = osm.read_large_extracts(spark, path)
    assert elements.columns == osm.elements_of(whole).columns

    def rows(frame):
        return sorted((repr(r.asDict(True)) for r in frame.collect()))

    assert rows(elements) == rows(osm.elements_of(whole))
    assert rows(remarks.filter("remark IS NOT NULL")) == rows(whole.filter("remark IS NOT NULL").select("area_id", "remark"))
    assert rows(osm.incomplete_extracts(remarks)) == rows(osm.incomplete_extracts(whole))


@pytest.mark.parametrize("text", ['{"features": [{"a": 1}', '{"features": [{"a": "}', '{"features": [{}]}}}'])
def test_documents_that_do_not_end_are_an_error(spark, tmp_path, text):
    (tmp_path / "cut.json").write_text(text)
    with pytest.raises(Exception, match="Not a whole JSON document"):
        split_json.read_array(spark, f"{tmp_path}/cut.json", "features", Workspace(spark).save)[0].collect()
