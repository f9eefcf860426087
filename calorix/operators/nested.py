"""Nested events: assembling them, flattening them and resolving the links inside them.

Links never leave an event, so all of them are resolved inside the event row, before anything is
exploded, and need no shuffle. Positional links are expressions; links by hash or own id, and
first matches, are looked up for all events of an Arrow batch by one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calorix.operators.kernels import position_lookup
from calorix.operators.ordering import with_group_rank, with_position, with_scan_index

SEEDS = "SeedContainer_Seeds"
CLUSTERS = "CaloClusterContainer_Clusters"
RINGS = "CaloRingsContainer_Rings"
DESCRIPTORS = "CaloDetDescriptorContainer_Cells"
CELLS = "CaloCellContainer_Cells"
ELECTRONS = "ElectronContainer_Electrons"
PARTICLES = "TruthParticleContainer_Particles"
INFO = "EventInfoContainer_Events"


def nest_rows(
    df: DataFrame,
    key: Sequence[str],
    fields: Sequence[str],
    items_col: str = "items",
    part_size: int | None = None,
) -> DataFrame:
    """Gather rows into arrays of structs per key, ordered by the fields.

    Without ``part_size`` a key is one row, as an event is; all its elements must fit in one. With it
    every key is ranked and cut into rows of at most that many elements, so a key of any size is
    spread over tasks. ``first_pos`` is the position of a row's first element within the key (0
    for whole keys): exploding with it (:func:`explode_children`) gives the same positions
    whatever the size of the parts.
    """
    item = F.struct(*fields)
    if part_size is None:
        # gathering lists before the shuffle saves nothing, so the plain rows are moved first
        placed = df.withColumn("first_pos", F.lit(0).cast("long")).repartition(*key)
    else:
        rank = F.col("_rank") - 1
        ranked = with_group_rank(df, list(key), list(fields), "_rank")
        placed = ranked.withColumn("first_pos", (rank - rank % part_size).cast("long")).drop("_rank")
    return placed.groupBy(*key, "first_pos").agg(
        F.sort_array(F.collect_list(item)).alias(items_col)
    )


def explode_children(
    df: DataFrame,
    key: Sequence[str],
    container: str,
    position_col: str = "pos",
    keep_empty: bool = False,
    first_col: str | None = None,
) -> DataFrame:
    """One row per element of a container with the event key and the element's position.

    ``first_col`` names the position of the container's first element, for keys in parts.
    """
    explode = F.posexplode_outer if keep_empty else F.posexplode
    first = [first_col] if first_col else []
    position = F.col(position_col)
    if first_col:
        position = (position + F.col(first_col)).alias(position_col)
    return df.select(*key, *first, explode(container).alias(position_col, "_item")).select(
        *key, position, "_item.*"
    )


def with_event_ids(df: DataFrame, key: str = "event_id", start: int = 1) -> DataFrame:
    """Give events running ids in reading order, for inputs that bring no event key."""
    return with_scan_index(df, key, start)


def event_table(df: DataFrame, key: str = "event_id") -> DataFrame:
    """Event-level quantities; an event must carry exactly one info entry."""
    one = F.when(F.size(INFO) == 1, F.get(INFO, F.lit(0))).otherwise(
        F.raise_error(F.lit("an event needs one info entry"))
    )
    return df.select(F.col(key).alias("id"), one.alias("_info")).select("id", "_info.*")


def link_by_position(links: Column, target: Column) -> Column:
    """Element of ``target`` at a position; NULL when the link points outside."""
    return F.when(links >= 0, F.get(target, links))


def valid_position(link: Column, target: Column) -> Column:
    """The link itself if it points at an element, else NULL."""
    return F.when((link >= 0) & (link < F.size(target)), link)


def last_position(wanted: Column, keys: Column) -> Column:
    """Array: where each wanted value stands last in the event's ``keys``; NULL when nowhere."""

    return position_lookup(last=True)(wanted, keys)


def first_position(wanted: Column, keys: Column) -> Column:
    """Array: where each wanted value stands first in the event's ``keys``; NULL when nowhere."""

    return position_lookup(last=False)(wanted, keys)


def first_match_or_empty(n: Column, links: Column, values: Column, empty: Column) -> Column:
    """For positions ``0 … n-1``: the value of the first entry linked to it, else ``empty``."""
    positions = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        first_position(positions, links), lambda i: F.coalesce(F.get(values, i), empty)
    )


def _explode_with(
    df: DataFrame,
    key: str,
    container: str,
    drop: Sequence[str],
    carry: dict[str, Column] | None = None,
    **columns: Column,
) -> DataFrame:
    """Explode a container together with arrays resolved next to it, element by element.

    The resolved arrays are zipped to the container, so a row carries its own element only and
    not a copy of the event. ``carry`` are single values of the event to repeat on every row.
    """
    fields = df.schema[container].dataType.elementType.names
    zipped = F.arrays_zip(F.col(container), *[c.alias(n) for n, c in columns.items()])
    carried = {n: c.alias(n) for n, c in (carry or {}).items()}
    rows = df.select(key, *carried.values(), F.posexplode(zipped).alias("pos", "_z"))
    return rows.select(
        key,
        *carried,
        "pos",
        *[F.col(f"_z.{container}.{f}").alias(f) for f in fields if f not in drop],
        *[F.col(f"_z.{n}").alias(n) for n in columns],
    )


def seed_table(df: DataFrame, key: str = "event_id") -> DataFrame:
    seeds = explode_children(df, [key], SEEDS)
    return seeds.withColumnRenamed("id", "sid")


def cluster_table(
    df: DataFrame, key: str = "event_id", carry: dict[str, Column] | None = None
) -> DataFrame:
    """Clusters with their seed's position and their first ring set (empty if none), and the
    event's values ``carry``."""
    seeds = F.transform(
        F.col(f"{CLUSTERS}.seed_link"), lambda link: valid_position(link, F.col(SEEDS))
    )
    rings = first_match_or_empty(
        F.size(CLUSTERS),
        F.col(f"{RINGS}.cluster_link"),
        F.col(f"{RINGS}.rings"),
        F.array().cast("array<float>"),
    )
    return _explode_with(
        df, key, CLUSTERS, ["seed_link", "cell_links"], carry, seed_pos=seeds, rings=rings
    )


def descriptor_table(df: DataFrame, key: str = "event_id") -> DataFrame:
    """Descriptor cells with the position of the last cluster that lists their hash."""
    found = last_position(F.col(f"{DESCRIPTORS}.hash"), F.col(f"{CLUSTERS}.cell_links"))
    return _explode_with(df, key, DESCRIPTORS, [], cluster_pos=found)


def cell_table(df: DataFrame, key: str = "event_id") -> DataFrame:
    """Cells with the position of the last descriptor that has the linked hash."""
    found = last_position(F.col(f"{CELLS}.descriptor_link"), F.col(f"{DESCRIPTORS}.hash"))
    return _explode_with(df, key, CELLS, ["descriptor_link"], descriptor_pos=found)


def electron_table(df: DataFrame, key: str = "event_id") -> DataFrame:
    """Electrons with their cluster's position; a dangling link is NULL."""
    clusters = F.transform(
        F.col(f"{ELECTRONS}.cluster_link"), lambda link: valid_position(link, F.col(CLUSTERS))
    )
    return _explode_with(df, key, ELECTRONS, ["cluster_link"], cluster_pos=clusters)


def particle_table(df: DataFrame, key: str = "event_id") -> DataFrame:
    """Truth particles with the position of the last seed that has their seed id."""
    found = last_position(F.col(f"{PARTICLES}.seedid"), F.col(f"{SEEDS}.id"))
    return _explode_with(df, key, PARTICLES, ["seedid"], seed_pos=found)


LINK_COLUMNS = {
    "clusters": "seed_pos",
    "calo_descriptor_cells": "cluster_pos",
    "calo_cells": "descriptor_pos",
    "electrons": "cluster_pos",
    "truth_particles": "seed_pos",
}


def child_tables(df: DataFrame, key: str = "event_id", strict: bool = False) -> dict:
    """All normalised tables of a nested event frame, keyed by (event, position).

    ``strict`` makes a dangling link fail when the table is computed, except for electrons,
    whose cluster may be missing.
    """
    tables = {
        "events": event_table(df, key),
        "seeds": seed_table(df, key),
        "clusters": cluster_table(df, key),
        "calo_descriptor_cells": descriptor_table(df, key),
        "calo_cells": cell_table(df, key),
        "electrons": electron_table(df, key),
        "truth_particles": particle_table(df, key),
    }
    if strict:
        for name, link in LINK_COLUMNS.items():
            if name != "electrons":
                error = F.raise_error(F.lit(f"{name}: dangling {link}")).cast("int")
                tables[name] = tables[name].withColumn(link, F.coalesce(F.col(link), error))
    return tables


PARENTS = {
    "clusters": ("seeds", "seed_id"),
    "calo_descriptor_cells": ("clusters", "cluster_id"),
    "calo_cells": ("calo_descriptor_cells", "descriptor_id"),
    "electrons": ("clusters", "cluster_id"),
    "truth_particles": ("seeds", "seed_id"),
}


def with_dense_keys(tables: dict, names: Sequence[str], key: str = "event_id") -> dict:
    """The named child tables with running ids, and links turned into the parent's id.

    For readers that need single-column keys; each table is numbered by (event, position), and
    a link is one join on that pair.
    """
    needed = dict.fromkeys([*names, *[PARENTS[n][0] for n in names if n in PARENTS]])
    numbered = {n: with_position(tables[n], [key, "pos"], "id", 1) for n in needed}
    out = {}
    for name in names:
        child = numbered[name]
        if name in PARENTS:
            parent, foreign = PARENTS[name]
            link = LINK_COLUMNS[name]
            ids = numbered[parent].select(
                F.col(key).alias("_event"), F.col("pos").alias("_pos"), F.col("id").alias(foreign)
            )
            on = (F.col(key) == F.col("_event")) & (F.col(link) == F.col("_pos"))
            child = child.join(ids, on, "left").drop("_event", "_pos", link)
        out[name] = child.drop("pos")
    return out


def dangling_links(tables: dict) -> DataFrame:
    """Rows and unresolved links of every child table."""
    parts = [
        tables[name].select(
            F.lit(name).alias("table"),
            F.lit(link).alias("link"),
            F.col(link).isNull().alias("dangling"),
        )
        for name, link in LINK_COLUMNS.items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("table", "link").agg(
        F.count("*").alias("n_rows"), F.count_if("dangling").alias("n_dangling")
    )


def ring_records(df: DataFrame, key: str = "event_id", n_rings: int = 0) -> DataFrame:
    """One record per ring set whose cluster exists: size, cluster direction, opened rings."""
    links = F.col(f"{RINGS}.cluster_link")

    def of_cluster(field: str) -> Column:
        values = F.col(f"{CLUSTERS}.{field}")
        return F.transform(links, lambda link: link_by_position(link, values))

    known = F.transform(links, lambda link: valid_position(link, F.col(CLUSTERS)))
    zipped = F.arrays_zip(
        F.col(f"{RINGS}.rings").alias("rings"),
        of_cluster("eta").alias("eta"),
        of_cluster("phi").alias("phi"),
        known.alias("cluster"),
    )
    rows = df.select(key, F.posexplode(zipped).alias("ring_pos", "_z"))
    return rows.where(F.col("_z.cluster").isNotNull()).select(
        key,
        "ring_pos",
        F.size("_z.rings").alias("rings_size"),
        F.col("_z.eta").alias("cl_eta"),
        F.col("_z.phi").alias("cl_phi"),
        *[F.get(F.col("_z.rings"), F.lit(i)).alias(f"ring_{i}") for i in range(n_rings)],
    )


def skipped_ring_sets(df: DataFrame) -> DataFrame:
    """How many ring sets point outside their event's clusters, counted inside the event row."""
    n = F.size(CLUSTERS)
    outside = F.filter(F.col(f"{RINGS}.cluster_link"), lambda link: (link < 0) | (link >= n))
    return df.agg(
        F.sum(F.size(RINGS)).alias("n_ring_sets"), F.sum(F.size(outside)).alias("n_skipped")
    )


def with_dense_ids(df: DataFrame, order: Sequence[str], id_col: str = "id", start: int = 1):
    """Running ids over the whole frame, for readers that cannot use the (event, pos) key."""
    return with_position(df, order, id_col, start)
