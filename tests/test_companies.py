"""Merging companies in order, against a scalar fold; and records of maps."""

import random
import re

import pytest
from pyspark.sql import functions as F

from talus.operators import companies as C
from talus.operators import discovery as D

SHAPE = "ord long, company_name string, website string, latitude double, longitude double, source array<string>, tags map<string,string>"


def fold(rows):
    out, by = [], {}
    for r in sorted(rows):
        ord_, name, site, lat, lon, source, _ = r
        keys = []
        if site:
            keys.append(re.sub(r"^https?://(www\.)?", "", site.lower()).rstrip("/"))
        if lat and lon:
            keys.append((name.strip().lower(), round(lat, 4), round(lon, 4)))
        met = next((by[k] for k in keys if k in by), None)
        if met:
            met[2] += [s for s in source if s not in met[2]]
            met[1] = met[1] or site or ""
        else:
            record = [ord_, site or "", list(dict.fromkeys(source))]
            out.append(record)
            by |= {k: record for k in keys}
    return sorted(map(tuple, ((o, w, "|".join(s)) for o, w, s in out)))


def ours(df):
    return sorted((r.ord, r.website, "|".join(r.source)) for r in C.merge_in_order(df).collect())


def test_a_chain_through_a_taken_row_stays_apart(spark):
    rows = [
        (1, "A", "http://www.a.org/", None, None, ["x"], {}), (2, "B", "https://a.org", 1.0, 2.0, ["y"], {}), (3, "b ", None, 1.00001, 2.0, ["z"], {}), (4, "B", None, 1.0, 2.0, ["y", "x"], {}),
        (5, "C", "", 3.0, 3.0, ["m"], {}), (6, "c", "c.org", 3.0, 3.0, ["n"], {}), (7, "D", "C.org/", None, 1.0, ["o"], {}), (8, "C", "c.org", 3.0, 3.0, ["p"], {}), (9, "E", None, 0.0, 5.0, ["q"], {}), (10, "E", None, 0.0, 5.0, ["q"], {"k": "v"}),
    ]
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    wanted = [(1, "http://www.a.org/", "x|y"), (3, "", "z|y|x"), (5, "c.org", "m|n"), (7, "C.org/", "o|p"), (9, "", "q"), (10, "", "q")]
    assert ours(df) == fold(rows) == wanted


def test_random_folds(spark):
    rng = random.Random(8)
    for n, keys in ((120, 12), (200, 90), (60, 2)):
        rows = [(i, rng.choice("AB"), rng.choice([None, "", f"http://w{rng.randrange(keys)}.org"]), rng.choice([None, float(rng.randrange(1, keys + 1))]), 1.5, rng.sample("xyz", rng.randrange(1, 3)), {}) for i in range(n)]
        assert ours(spark.createDataFrame(rows, SHAPE)) == fold(rows)


def test_a_long_chain_in_order(spark):
    """Each row shares a key with the one before, by turns its website and its place: as many rounds as half the chain."""
    rows = [(i, "A", f"w{(i + 1) // 2}", float(i // 2 + 1), 1.0, ["s"], {}) for i in range(14)]
    assert ours(spark.createDataFrame(rows, SHAPE)) == fold(rows)
    assert ours(spark.createDataFrame([], SHAPE)) == []


@pytest.fixture(scope="module")
def on_map(spark):
    tags = [{"name": "Neural Works", "office": "it", "website": "http://n.org"}, {"name": "Neural Works", "office": "it"}, {"name": "Bakers", "shop": "bakery", "website": "https://www.n.org/"}]
    rows = [(i, f"node/{i}", t, 10.5, 20.25, None, None) for i, t in enumerate(tags)]
    return D.from_map(spark.createDataFrame(rows, "ord long, osm_id string, tags map<string,string>, lat double, lon double, center_lat double, center_lon double"), "map")


def test_records_of_maps_go_through_every_step(spark, on_map):
    """They hold maps, which have no order."""
    merged = C.merge(on_map)
    assert [r.ord for r in merged.collect()] == [0] and set(merged.columns) == set(on_map.columns)
    assert sorted(r.ord for r in C.merge_in_order(on_map).collect()) == [0]
    assert [r.ord for r in C.best_first(merged.withColumn("confidence", C.confidence()), 5).collect()] == [0]
    assert [r.source for r in C.sources(merged).collect()] == ["map"]
    assert [r.key for r in C.name_only(on_map, on_map.limit(0)).orderBy("key").collect()] == ["bakers", "neural works"]
    assert merged.select(F.size("social_links")).first()[0] == 0
