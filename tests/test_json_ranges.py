"""Records of JSON values cut anywhere, against a plain reader."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cardloom.sources import catalog, json_ranges

ODD = ['plain', 'a}b', '{"id": "x"}', '"', '\\', '\\"}', ']', '[{', '},{', 'é ', 'tab\t', "", '"cards":[{', "\\\\"]


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")

    def set_(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield set_
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
        spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)


def card(r, k):
    return {"id": f"c{k}", "hash": r.choice(ODD), "name": r.choice(ODD) + str(k), "set": r.choice(ODD), "number": str(k), "more": {"x": [{"y": 1}, r.choice(ODD)]}}


def written(path, value, r):
    text = json.dumps(value, ensure_ascii=r.random() < 0.5, indent=r.choice([None, None, 1]), separators=r.choice([(",", ":"), (", ", ": ")]))
    path.write_text(text + r.choice(["", "\n"]))


@pytest.mark.parametrize("size", [40, 173, 900, 1 << 20])
def test_hash_catalog_cut_anywhere(spark, tmp_path, small_ranges, size):
    r = random.Random(size)
    want = []
    for k in range(3):
        cards = [card(r, 100 * k + j) for j in range(40)]
        head = {"generated": "x}", "meta": {"cards": [{"id": "no"}], "b": {"id": "no"}}, "old": [{"id": "no", "name": "no"}] * 3}
        tail = {"count": 3, "later": [{"id": "no"}, {"cards": [{"id": "no"}]}]}
        written(tmp_path / f"{k}.json", {**head, "cards": cards, **tail}, r)
        want += [(c["id"], c["hash"], c["name"], c["set"], c["number"]) for c in cards]
    small_ranges(size)
    assert sorted(tuple(x) for x in catalog.read_hash_db(spark, f"{tmp_path}/*.json").collect()) == sorted(want)


@pytest.mark.parametrize("size", [30, 400, 1 << 20])
def test_lists_of_cards(spark, tmp_path, small_ranges, size):
    r = random.Random(size)
    cards = [{"id": f"s-{k}", "localId": str(k), "name": r.choice(ODD), "image": None, "set": {"id": "s", "name": r.choice(ODD)}} for k in range(60)]
    written(tmp_path / "a.json", cards[:50], r)
    written(tmp_path / "b.json", [], r)
    written(tmp_path / "c.json", cards[50:], r)
    small_ranges(size)
    got = catalog.read_catalog(spark, f"{tmp_path}/*.json").collect()
    assert sorted(map(str, (tuple(x) for x in got))) == sorted(str((c["id"], c["localId"], c["name"], None, "s", c["set"]["name"])) for c in cards)


@pytest.mark.parametrize("size", [50, 700, 1 << 20])
def test_embeddings_and_the_last_chunk(spark, tmp_path, small_ranges, size):
    r = random.Random(size)
    want = {}
    for chunk in (2, 0, 1):
        own = {f"c{r.randrange(60)}{r.choice(['', ']', '\"', '}'])}": [round(r.random(), 3) for _ in range(8)] for _ in range(30)}
        whole = {"version": "1", "embeddings": own, "chunkIndex": chunk, "totalChunks": 3} if chunk else {"chunkIndex": 0, "note": [1, [2]], "embeddings": own}
        written(tmp_path / f"f{chunk}.json", whole, r)
        for k, v in own.items():
            if k not in want or want[k][0] < chunk:
                want[k] = (chunk, v)
    small_ranges(size)
    got = {x.card_id: [round(v, 3) for v in x.embedding] for x in catalog.read_embeddings(spark, f"{tmp_path}/*.json").collect()}
    assert got == {k: v for k, (_, v) in want.items()}


def test_ranges_share_the_work_and_headers_come_whole(spark, tmp_path, small_ranges):
    cards = [{"id": f"c{k}", "name": "n" * 50} for k in range(3000)]
    (tmp_path / "a.json").write_text(json.dumps({"version": "v}", "cards": cards, "count": 3000}))
    small_ranges(8192)
    pieces = json_ranges._pieces(spark, f"{tmp_path}/a.json", "}")
    assert pieces.rdd.getNumPartitions() > 20 and json_ranges.range_starts(pieces).where("depth > 0").count() > 20
    records, headers = json_ranges.read_records(spark, f"{tmp_path}/a.json", field="cards")
    assert records.count() == 3000
    assert headers.select(F.from_json("header", "version string, count int, cards array<string>").alias("h")).select("h.*").collect() == [("v}", 3000, [])]


def test_a_broken_value_ends_with_its_last_record(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"cards":[{"id":"a"},{"id":"b"},{"id":"c')
    assert sorted(x.id for x in catalog.read_hash_db(spark, f"{tmp_path}/a.json").collect()) == ["a", "b"]
