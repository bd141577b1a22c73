"""Resource roles: groups of users whose task profiles correlate.

Users with proportional profiles (equal up to scale and shift) are collapsed
first, so copies cost nothing. Centred and scaled to length one, the others are
points whose angles are a metric: the correlation is the cosine. They are grouped
by the nearest of a few pivots and packed into blocks of neighbours. A block knows
how near and how far its points are from each pivot, and two blocks whose
distances from any pivot are further apart than the angle of the threshold have no
similar users. What is left is one matrix product for each pair of blocks, which
returns the pairs above the threshold.

When only components are wanted, blocks are joined inside first, then by one user
of each component and block, and only users of different components are compared
after that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.positions import global_rank, null_safe_join, number_rows
from logloom.runtime import dimension, pin
from logloom.schema import drop_pseudo_events, drop_system_user

# Cells of a block's matrix (32 MB of doubles).
BLOCK_CELLS = 4_000_000
BLOCK_ROWS = 2_000
# Pivots, at most; they are collected and travel with the tasks.
PIVOTS = 128
# Groups of users that meet all tasks apart.
SALTS = 64
# Added to angles before they are compared with bounds.
SLACK = 1e-6


def task_user_counts(log: DataFrame) -> DataFrame:
    rows = drop_system_user(drop_pseudo_events(log)).select("task", "user")
    return rows.groupBy("task", "user").agg(F.count(F.lit(1)).alias("freq"))


def user_task_profiles(log: DataFrame) -> DataFrame:
    """Every user with every task, zero where the user never did the task."""
    counts = pin(task_user_counts(log))
    # tasks go to each of a fixed number of groups of users
    salted = F.pmod(F.xxhash64("user"), F.lit(SALTS)).alias("_salt")
    users = counts.select("user").distinct().select("user", salted)
    tasks = counts.select("task").distinct()
    tasks = tasks.select("task", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    grid = users.join(tasks, "_salt").drop("_salt")
    own = null_safe_join(grid, counts, ["user", "task"], "left")
    return own.select("user", "task", F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq"))


def _profiles(log: DataFrame) -> tuple[DataFrame, int]:
    """(user, tasks, freqs, shape) with sparse profiles, and the task count."""
    counts = pin(task_user_counts(log))
    tasks = pin(counts.select("task").distinct())
    n = tasks.count()
    tasks = global_rank(tasks, ["task"], "t", n)
    cells = counts.join(dimension(tasks, n), "task")
    sparse = cells.groupBy("user").agg(
        F.sort_array(F.collect_list(F.struct((F.col("t") - 1).alias("t"), "freq"))).alias("cells")
    )
    low = F.when(F.size("cells") == n, F.array_min("cells.freq")).otherwise(0)
    high = F.array_max("cells.freq")
    sparse = sparse.withColumns({"low": low, "high": high}).where("high > low")
    # Scaled to [0, 1]; equal for users whose profiles correlate perfectly.
    shape = F.transform(
        F.filter("cells", lambda c: c["freq"] > F.col("low")),
        lambda c: F.struct(c["t"], (c["freq"] - F.col("low")) / (F.col("high") - F.col("low"))),
    )
    return (
        sparse.select(
            "user",
            F.col("cells.t").cast("array<int>").alias("tasks"),
            F.col("cells.freq").cast("array<double>").alias("freqs"),
            F.sha2(F.to_json(shape), 256).alias("shape"),
        ),
        n,
    )


def _units(part: pd.DataFrame, n_tasks: int) -> np.ndarray:
    """Centred profiles of length one, a line for each row."""
    matrix = np.zeros((len(part), n_tasks))
    for row, (tasks, freqs) in enumerate(zip(part["tasks"], part["freqs"])):
        matrix[row, tasks] = freqs
    matrix -= matrix.mean(axis=1, keepdims=True)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix


def _correlated(n_tasks: int, threshold: float, forest: bool):
    """Kernel over one pair of blocks: the pairs with r > threshold.

    Where rows have a ``component``, only those of different ones are compared.
    """

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("user", ignore_index=True)
        matrix = _units(part, n_tasks)
        r = matrix @ matrix.T
        linked = r > threshold
        np.fill_diagonal(linked, False)
        if part["low"].iat[0] != part["high"].iat[0]:
            block = part["block"].to_numpy()
            linked &= block[:, None] != block[None, :]
        if "component" in part:
            component = pd.factorize(part["component"])[0]
            linked &= component[:, None] != component[None, :]
        x, y = _stars(linked) if forest else np.nonzero(np.triu(linked))
        users = part["user"].to_numpy()
        return pd.DataFrame({"x": users[x], "y": users[y], "r": r[x, y]})

    return pairs


def _stars(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the first node of each component to its other nodes."""
    centres, leaves = [], []
    unseen = np.ones(len(linked), dtype=bool)
    for node in range(len(linked)):
        if not unseen[node]:
            continue
        unseen[node] = False
        frontier = np.array([node])
        while len(frontier):
            frontier = np.nonzero(linked[frontier].any(axis=0) & unseen)[0]
            unseen[frontier] = False
            centres.append(np.full(len(frontier), node))
            leaves.append(frontier)
    empty = np.zeros(0, dtype=int)
    return np.concatenate([empty, *centres]), np.concatenate([empty, *leaves])


EDGES = "x string, y string, r double"


def _pivots(profiles: DataFrame, n_tasks: int, count: int) -> np.ndarray:
    """Profiles far from each other, picked from four times as many that are drawn."""
    drawn = profiles.orderBy(F.xxhash64("user"), "user").limit(4 * count).toPandas()
    points = _units(drawn, n_tasks)
    picked = [0]
    nearest = points @ points[0]
    while len(picked) < min(count, len(points)):
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, points @ points[picked[-1]])
    return points[picked]


def _angles(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(points @ pivots.T, -1, 1))


def metric_blocks(profiles: DataFrame, rows: int, n_tasks: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of neighbours: (block, user, tasks, freqs) and (block, nearest, farthest).

    The second table has a row for each block with its users' least and largest angle to
    each pivot.
    """
    size = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(n_tasks, 1)))
    blocks = -(-rows // size)
    count = max(1, min(PIVOTS, 2 * blocks, BLOCK_CELLS // max(4 * n_tasks, 1)))
    profiles = profiles.select("user", "tasks", "freqs")
    pivots = _pivots(profiles, n_tasks, count)

    def nearest(parts):
        for part in parts:
            for at in range(0, len(part), size):
                some = part.iloc[at : at + size]
                angles = _angles(_units(some, n_tasks), pivots)
                yield some.assign(pivot=angles.argmin(axis=1), angle=angles.min(axis=1))

    def extent(key, part):
        angles = _angles(_units(part, n_tasks), pivots)
        return pd.DataFrame({"block": [key[0]], "nearest": [angles.min(axis=0)], "farthest": [angles.max(axis=0)]})

    placed = "user string, tasks array<int>, freqs array<double>, pivot long, angle double"
    located = pin(profiles.mapInPandas(nearest, placed))
    numbered = number_rows(located, ["pivot"], ["angle", "user"], "_pos")
    block = F.shiftleft("pivot", 40) + F.expr(f"(_pos - 1) div {size}")
    members = pin(numbered.select(block.alias("block"), "user", "tasks", "freqs"))
    extents = members.groupBy("block").applyInPandas(
        extent, "block long, nearest array<double>, farthest array<double>"
    )
    return members, pin(extents)


def close_blocks(extents: DataFrame, threshold: float) -> DataFrame:
    """(low, high): the pairs of blocks, low < high, that may hold similar users.

    Blocks meet in stretches of their angle to the first pivot; the bounds of the
    other pivots are checked on those that do.
    """
    reach = float(np.arccos(threshold)) + SLACK
    width = max(reach, 0.02)
    stretch = lambda a: F.floor(a / F.lit(width)).cast("int")
    near, far = F.col("nearest")[0], F.col("farthest")[0]
    wide = F.sequence(stretch(near - reach), stretch(far + reach))
    left = extents.select(F.col("block").alias("low"), F.explode(wide).alias("at"),
                          F.col("nearest").alias("n1"), F.col("farthest").alias("f1"))
    right = extents.select(F.col("block").alias("high"), F.explode(F.sequence(stretch(near), stretch(far))).alias("at"),
                           F.col("nearest").alias("n2"), F.col("farthest").alias("f2"))
    apart = lambda n, f: F.exists(F.zip_with(n, f, lambda a, b: a - b), lambda d: d > reach)
    met = left.join(right, "at").where("low < high")
    return met.where(~apart("n1", "f2") & ~apart("n2", "f1")).select("low", "high").distinct()


def _compare(members: DataFrame, pairs: DataFrame, n_tasks: int, threshold: float, forest: bool) -> DataFrame:
    """Similar users of each pair of blocks; a pair of a block with itself is all of it."""
    ends = pairs.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    met = members.join(ends, "block")
    return met.groupBy("low", "high").applyInPandas(_correlated(n_tasks, threshold, forest), EDGES)


def _in_one_block(profiles: DataFrame, rows: int, n_tasks: int) -> DataFrame | None:
    """The profiles as one block, if they fit."""
    if rows > max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(n_tasks, 1))):
        return None
    zero = F.lit(0).cast("bigint")
    return profiles.select(zero.alias("low"), zero.alias("high"), zero.alias("block"), "user", "tasks", "freqs")


def _similar(profiles: DataFrame, rows: int, n_tasks: int, threshold: float) -> DataFrame:
    """All pairs with r > threshold."""
    alone = _in_one_block(profiles, rows, n_tasks)
    if alone is not None:
        return alone.groupBy("low", "high").applyInPandas(_correlated(n_tasks, threshold, False), EDGES)
    members, extents = metric_blocks(profiles, rows, n_tasks)
    own = extents.select(F.col("block").alias("low"), F.col("block").alias("high"))
    pairs = pin(close_blocks(extents, threshold).unionByName(own))
    return _compare(members, pairs, n_tasks, threshold, forest=False)


def _components(profiles: DataFrame, rows: int, n_tasks: int, threshold: float) -> DataFrame:
    """(node, component) of the graph of pairs with r > threshold."""
    nodes = profiles.select(F.col("user").alias("node"))
    alone = _in_one_block(profiles, rows, n_tasks)
    if alone is not None:  # the kernel sees every pair, its stars are the components
        stars = alone.groupBy("low", "high").applyInPandas(_correlated(n_tasks, threshold, True), EDGES)
        stars = stars.select(F.col("y").alias("node"), F.col("x").alias("component"))
        found = nodes.join(stars, "node", "left")
        return found.select("node", F.coalesce("component", "node").alias("component"))
    members, extents = metric_blocks(profiles, rows, n_tasks)
    own = extents.select(F.col("block").alias("low"), F.col("block").alias("high"))
    inside = pin(_compare(members, own, n_tasks, threshold, forest=True))
    leaves = inside.select(F.col("y").alias("user")).distinct()
    pairs = pin(close_blocks(extents, threshold))
    # one user of each component of a block, its centre
    centres = members.join(leaves, "user", "left_anti")
    edges = inside.unionByName(_compare(centres, pairs, n_tasks, threshold, forest=True))
    found = pin(connected_components(nodes, pin(edges)))
    coloured = pin(members.join(found, members["user"] == found["node"]).drop("node"))
    open_pairs = different_components(pairs, coloured)
    rest = pin(_compare(coloured, open_pairs, n_tasks, threshold, forest=True))
    links = found.select(F.col("node").alias("x"), F.col("component").alias("y"))
    return connected_components(nodes, links.unionByName(rest.select("x", "y")))


def different_components(pairs: DataFrame, coloured: DataFrame) -> DataFrame:
    """The pairs of blocks whose users are not all of one component."""
    spans = pin(coloured.groupBy("block").agg(F.min("component").alias("a"), F.max("component").alias("b")))
    low = spans.select(F.col("block").alias("low"), F.col("a").alias("a1"), F.col("b").alias("b1"))
    high = spans.select(F.col("block").alias("high"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    met = pairs.join(low, "low").join(high, "high")
    return met.where(~((F.col("a1") == F.col("b2")) & (F.col("b1") == F.col("a2")))).select("low", "high")


def similar_users(log: DataFrame, sim_threshold: float = 0.7) -> DataFrame:
    """Pairs x < y of users with Pearson r > threshold. Constant profiles have none."""
    profiles, n_tasks = _profiles(log)
    profiles = pin(profiles)
    return _similar(profiles, profiles.count(), n_tasks, sim_threshold)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node as component.

    ``nodes(node)``, ``edges(x, y)``. Alternating large-star and small-star
    steps, each a minimum per node and a join back; ends when the edge set,
    compared by its hash sum, no longer changes.
    """
    state = pin(_downward(edges.select("x", "y")))
    mark = _mark(state)
    while mark[0]:
        both = state.unionByName(state.select(F.col("y").alias("x"), F.col("x").alias("y")))
        state = pin(_small_star(_large_star(both)))
        mark, before = _mark(state), mark
        if mark == before:
            break
    found = state.select(F.col("x").alias("node"), F.col("y").alias("component"))
    return nodes.join(found, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def _downward(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end."""
    return (
        edges.where("x <> y")
        .select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
        .distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), total).first())


def _large_star(both: DataFrame) -> DataFrame:
    low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    larger = both.where("y > x").join(low, "x")
    return larger.select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()


def _small_star(down: DataFrame) -> DataFrame:
    low = down.groupBy("x").agg(F.min("y").alias("m"))
    rest = down.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
    own = low.select("x", F.col("m").alias("y"))
    return rest.unionByName(own).where("x <> y").distinct()


def discover_roles(log: DataFrame, sim_threshold: float = 0.7) -> DataFrame:
    """(user, role): components of the similarity graph, largest role first.

    Roles of equal size are ordered by their smallest member.
    """
    if not 0 <= sim_threshold < 1:
        raise ValueError(sim_threshold)
    users = drop_system_user(drop_pseudo_events(log)).select("user").distinct()
    profiles, n_tasks = _profiles(log)
    profiles = pin(profiles)
    shapes = pin(
        profiles.groupBy("shape").agg(
            F.min(F.struct("tasks", "freqs")).alias("p")
        ).select("shape", F.col("shape").alias("user"), "p.*")  # the node is the shape itself
    )
    groups = _components(shapes, shapes.count(), n_tasks, sim_threshold)
    of_shape = shapes.join(groups, F.col("user") == F.col("node")).select("shape", "component")
    members = profiles.select("user", "shape").join(of_shape, "shape").select(
        "user", F.concat(F.lit("shape "), "component").alias("component")
    )
    # Users with a constant profile correlate with nobody.
    members = pin(
        users.join(members, users["user"].eqNullSafe(members["user"]), "left").select(
            users["user"],
            F.coalesce(members["component"], F.concat(F.lit("user "), users["user"])).alias("component"),
        )
    )
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("user").alias("u"))
    sizes = pin(sizes)
    ranked = global_rank(sizes, [F.desc("n"), F.asc("u")], "rank", sizes.count())
    named = ranked.select("component", F.concat(F.lit("Role "), F.col("rank")).alias("role"))
    return members.join(named, members["component"].eqNullSafe(named["component"])).select(
        "user", "role"
    )


def role_members(roles: DataFrame, chunk_rows: int = 10_000) -> DataFrame:
    """(role, quantity, chunk, members): member lists, split above ``chunk_rows``."""
    sizes = roles.groupBy("role").agg(F.count(F.lit(1)).alias("quantity"))
    placed = number_rows(roles, ["role"], ["user"])
    chunk = F.expr(f"cast((pos - 1) div {chunk_rows} as int)").alias("chunk")
    lists = placed.groupBy("role", chunk).agg(F.sort_array(F.collect_list("user")).alias("members"))
    return lists.join(sizes, "role").select("role", "quantity", "chunk", "members")


def add_roles(log: DataFrame, roles: DataFrame) -> DataFrame:
    """Log with ``role``; NULL where the user has none. Pseudo-events are dropped."""
    roles = pin(roles.where(F.col("user").isNotNull()))
    return drop_pseudo_events(log).join(dimension(roles, roles.count()), "user", "left")


def add_resources(log: DataFrame, sim_threshold: float) -> DataFrame:
    return add_roles(log, discover_roles(log, sim_threshold))
