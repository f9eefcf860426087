"""Link resolution on hand-made events with every kind of broken link."""

import random

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calorix.operators import nested
from calorix.operators.kernels import positions_of
from calorix.schemas import EVENT_SCHEMA
from tests.conftest import rows

SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), *EVENT_SCHEMA.fields])


def element(container, **values):
    names = EVENT_SCHEMA[container].dataType.elementType.names
    return {n: values.get(n) for n in names}


def event(event_id, **containers):
    row = {f.name: [] for f in EVENT_SCHEMA.fields}
    row[nested.INFO] = [element(nested.INFO, avgmu=20.0, eventNumber=float(event_id), runNumber=1.0)]
    for name, items in containers.items():
        container = getattr(nested, name)
        row[container] = [element(container, **i) for i in items]
    return (event_id, *[row[f.name] for f in EVENT_SCHEMA.fields])


@pytest.fixture(scope="module")
def events(spark):
    data = [
        event(
            1,
            SEEDS=[{"id": 7, "e": 1.0}, {"id": 7, "e": 2.0}, {"id": 9, "e": 3.0}],
            CLUSTERS=[
                {"cell_links": [10, 11], "seed_link": 2, "eta": 0.1, "phi": 0.2},
                {"cell_links": [11, 12], "seed_link": 5, "eta": 0.3, "phi": 0.4},
                {"cell_links": [], "seed_link": -1, "eta": 0.5, "phi": 0.6},
            ],
            RINGS=[
                {"cluster_link": 1, "rings": [1.0, 2.0]},
                {"cluster_link": 1, "rings": [9.0]},
                {"cluster_link": 4, "rings": [5.0]},
                {"cluster_link": 0, "rings": [3.0]},
            ],
            DESCRIPTORS=[{"hash": 11}, {"hash": 12}, {"hash": 99}, {"hash": 11}],
            CELLS=[{"descriptor_link": 11}, {"descriptor_link": 5}],
            ELECTRONS=[{"cluster_link": 0}, {"cluster_link": 3}, {"cluster_link": -1}],
            PARTICLES=[{"seedid": 7}, {"seedid": 9}, {"seedid": 1}],
        ),
        event(2),
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_seed_position_and_first_rings(events):
    found = nested.cluster_table(events).select("event_id", "pos", "seed_pos", "rings")
    # the second link points outside; the first ring set wins; no ring set gives an empty one
    assert rows(found) == [(1, 0, 2, [3.0]), (1, 1, None, [1.0, 2.0]), (1, 2, None, [])]


def test_cell_in_two_clusters_goes_to_the_last(events):
    found = nested.descriptor_table(events).select("pos", "hash", "cluster_pos")
    assert rows(found) == [(0, 11, 1), (1, 12, 1), (2, 99, None), (3, 11, 1)]


def test_last_descriptor_with_the_hash(events):
    found = nested.cell_table(events).select("pos", "descriptor_pos")
    assert rows(found) == [(0, 3), (1, None)]


def test_dangling_electron_is_null(events):
    found = nested.electron_table(events).select("pos", "cluster_pos")
    assert rows(found) == [(0, 0), (1, None), (2, None)]


def test_particle_finds_last_seed_with_its_id(events):
    found = nested.particle_table(events).select("pos", "seed_pos")
    assert rows(found) == [(0, 1), (1, 2), (2, None)]


def test_seed_id_is_kept(events):
    assert rows(nested.seed_table(events).select("pos", "sid")) == [(0, 7), (1, 7), (2, 9)]


def test_dangling_report(events):
    found = nested.dangling_links(nested.child_tables(events))
    assert rows(found.select("table", "n_rows", "n_dangling")) == [
        ("calo_cells", 2, 1),
        ("calo_descriptor_cells", 4, 1),
        ("clusters", 3, 2),
        ("electrons", 3, 2),
        ("truth_particles", 3, 1),
    ]


def test_strict_fails_on_dangling_links_but_not_electrons(events):
    tables = nested.child_tables(events, strict=True)
    assert tables["electrons"].count() == 3
    with pytest.raises(PySparkException):
        tables["clusters"].collect()


def test_ring_records_skip_out_of_range(events):
    found = nested.ring_records(events, n_rings=2)
    assert [(r[1], r[2], round(r[3], 3), r[5], r[6]) for r in rows(found)] == [
        (0, 2, 0.3, 1.0, 2.0),
        (1, 1, 0.3, 9.0, None),
        (3, 1, 0.1, 3.0, None),
    ]
    assert tuple(nested.skipped_ring_sets(events).first()) == (4, 1)


def test_event_needs_exactly_one_info(spark, events):
    assert nested.event_table(events).count() == 2
    doubled = events.withColumn(nested.INFO, F.concat(nested.INFO, nested.INFO))
    with pytest.raises(PySparkException, match="needs one info entry"):
        nested.event_table(doubled).collect()


@pytest.mark.parametrize("part_size", [None, 100_000, 70])
def test_flatten_undoes_nesting_with_a_hot_key(spark, part_size):
    """One key holds a third of the rows; positions do not depend on the size of the parts."""
    key = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 40)
    df = spark.range(900).select(key.alias("k"), (F.col("id") % 25).alias("v")).repartition(3)
    packed = nested.nest_rows(df, ["k"], ["v"], part_size=part_size)
    assert packed.agg(F.max(F.size("items"))).first()[0] <= (part_size or 900)
    flat = nested.explode_children(packed, ["k"], "items", first_col="first_pos")
    expected = []
    for k in {r.k for r in df.collect()}:
        values = sorted(r.v for r in df.where(F.col("k") == k).collect())
        expected += [(k, i, v) for i, v in enumerate(values)]
    assert rows(flat.select("k", "pos", "v")) == sorted(expected)


def test_links_inside_an_event_against_brute_force():
    draw = random.Random(6)
    some = lambda n: [draw.choice([None, *range(6)]) for _ in range(draw.randrange(n))]
    wanted = [None, [], *[some(9) for _ in range(60)]]
    keys = [None, [1], *[some(9) for _ in range(60)]]
    many = [None, [[1]], *[[some(4) for _ in range(draw.randrange(5))] for _ in range(60)]]
    kind = pa.list_(pa.int64())

    def brute(w, k, last):
        if w is None:
            return []
        at = [[i for i, x in enumerate(k or []) if v is not None and v in (x if isinstance(x, list) else [x])] for v in w]
        return [(x[-1] if last else x[0]) if x else None for x in at]

    for held, t in ((keys, kind), (many, pa.list_(kind))):
        for last in (True, False):
            found = positions_of(pa.array(wanted, kind), pa.array(held, t), last)
            expected = [brute(w, k, last) for w, k in zip(wanted, held, strict=True)]
            assert found.to_pylist() == expected


def test_dense_keys_follow_the_links(events):
    tables = nested.with_dense_keys(
        nested.child_tables(events), ["electrons", "calo_cells", "truth_particles"]
    )
    assert rows(tables["electrons"].select("id", "cluster_id")) == [(1, 1), (2, None), (3, None)]
    assert rows(tables["calo_cells"].select("id", "descriptor_id")) == [(1, 4), (2, None)]
    assert rows(tables["truth_particles"].select("id", "seed_id")) == [(1, 2), (2, 3), (3, None)]


def test_dense_ids(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "a int")
    assert rows(nested.with_dense_ids(df, ["a"])) == [(1, 1), (2, 2), (3, 3)]
