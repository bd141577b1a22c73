import random

import numpy as np
import pytest
from helpers import rows_of

from logloom.operators import roles as X
from logloom.operators.selection import flag_smallest, kth_smallest, quantile_disc, sample_rows, share
from logloom.operators.split import case_parts, split_timeline
from logloom.schema import LogSchema


def tasks(user, counts):
    return [("c", t, user, 0, 1) for t, n in counts.items() for _ in range(n)]


@pytest.fixture(scope="module")
def staff(make_log):
    """Two correlated pairs, one constant profile, the system user."""
    rows = tasks("ann", {"A": 4, "B": 1}) + tasks("bob", {"A": 8, "B": 2})
    rows += tasks("cid", {"C": 3}) + tasks("dan", {"C": 5, "B": 1})
    rows += tasks("eve", {"A": 2, "B": 2, "C": 2}) + tasks("AUTO", {"A": 9})
    return make_log(rows)


def test_profiles(staff):
    got = {(u, t): n for u, t, n in rows_of(X.user_task_profiles(staff), "user", "task", "freq")}
    assert len(got) == 15 and got["cid", "A"] == 0 and got["bob", "A"] == 8
    assert ("AUTO", "A") not in got


def test_similarity_is_pearson(staff):
    profile = {"ann": [4, 1, 0], "bob": [8, 2, 0], "cid": [0, 0, 3], "dan": [0, 1, 5]}
    got = {(x, y): r for x, y, r in rows_of(X.similar_users(staff, 0.7), "x", "y", "r")}
    want = {
        (x, y): np.corrcoef(profile[x], profile[y])[0, 1]
        for x in profile for y in profile
        if x < y and np.corrcoef(profile[x], profile[y])[0, 1] > 0.7
    }
    assert got == pytest.approx(want) and set(got) == {("ann", "bob"), ("cid", "dan")}


def test_roles(staff):
    assert rows_of(X.discover_roles(staff, 0.7), "user", "role") == [
        ("ann", "Role 1"), ("bob", "Role 1"), ("cid", "Role 2"), ("dan", "Role 2"), ("eve", "Role 3"),
    ]


def test_log_with_roles_keeps_the_system_user(staff):
    log = X.add_resources(staff, 0.7)
    assert log.count() == staff.count()
    assert log.where("user = 'AUTO' and role is null").count() == 9


def test_member_lists_are_chunked(staff):
    roles = X.discover_roles(staff, 0.7)
    got = rows_of(X.role_members(roles, 1), "role", "chunk", "quantity", "members")
    assert got[:2] == [("Role 1", 0, 2, ["ann"]), ("Role 1", 1, 2, ["bob"])]


@pytest.fixture(scope="module")
def crowd(make_log):
    rng = random.Random(3)
    rows = []
    for i in range(30):
        rows += tasks(f"u{i:02d}", {t: rng.randint(0, 4) for t in "ABCD"})
    for i in range(20):  # copies of one profile
        rows += tasks(f"v{i:02d}", {"A": 3, "D": 1})
    return make_log(rows)


@pytest.mark.parametrize("threshold", [0.6, 0.9])
def test_blocks_do_not_change_the_roles(crowd, monkeypatch, threshold):
    whole = rows_of(X.discover_roles(crowd, threshold), "user", "role")
    pairs = rows_of(X.similar_users(crowd, threshold), "x", "y")
    monkeypatch.setattr(X, "BLOCK_ROWS", 7)
    assert rows_of(X.discover_roles(crowd, threshold), "user", "role") == whole
    assert rows_of(X.similar_users(crowd, threshold), "x", "y") == pairs
    parent = {u: u for u, _ in whole}

    def root(u):
        return u if parent[u] == u else root(parent[u])

    for x, y in pairs:
        parent[max(root(x), root(y))] = min(root(x), root(y))
    groups = {}
    for u in parent:
        groups.setdefault(root(u), []).append(u)
    names = dict(whole)
    assert all(len({names[u] for u in g}) == 1 for g in groups.values())
    assert len(set(names.values())) == len(groups)


def wide_profiles(spark, groups, each):
    """Users of well separated groups: (profiles, number of tasks, angles' cosines)."""
    rng = np.random.default_rng(groups)
    n_tasks = 24
    centres = rng.integers(0, 60, (groups, n_tasks)) * (rng.random((groups, n_tasks)) < 0.3)
    rows, freqs = [], []
    for k in range(groups * each):
        f = np.maximum(centres[k % groups] * 10 + rng.integers(0, 12, n_tasks), 0)
        freqs.append(f)
        rows.append((f"u{k:05d}", list(range(n_tasks)), [float(x) for x in f]))
    df = spark.createDataFrame(rows, "user string, tasks array<int>, freqs array<double>")
    return df, n_tasks, np.corrcoef(np.array(freqs))


def test_few_block_pairs_are_compared(spark, monkeypatch):
    """Ten times the users: pairs of blocks grow far slower than all pairs, none is lost."""
    monkeypatch.setattr(X, "BLOCK_ROWS", 10)
    counts = []
    for groups, each in ((12, 10), (60, 20)):
        df, n_tasks, r = wide_profiles(spark, groups, each)
        n = groups * each
        _, extents = X.metric_blocks(df, n, n_tasks)
        blocks = extents.count()
        counts.append((X.close_blocks(extents, 0.95).count(), blocks * (blocks - 1) // 2))
        got = {(x, y) for x, y, _ in rows_of(X._similar(df, n, n_tasks, 0.95), "x", "y", "r")}
        x, y = np.nonzero(np.triu(r > 0.95, 1))
        assert got == {(f"u{a:05d}", f"u{b:05d}") for a, b in zip(x, y)}
    assert counts[1][0] < 0.2 * counts[1][1]


def test_joined_components_are_not_compared_again(spark, monkeypatch):
    """One group: after its blocks are joined by their centres no pair is left."""
    monkeypatch.setattr(X, "BLOCK_ROWS", 10)
    df, n_tasks, r = wide_profiles(spark, 1, 200)
    open_pairs = []
    kept = X.different_components
    monkeypatch.setattr(X, "different_components", lambda p, c: open_pairs.append(kept(p, c)) or open_pairs[-1])
    found = rows_of(X._components(df, 200, n_tasks, 0.9), "node", "component")
    assert r.min() > 0.9 and {c for _, c in found} == {"u00000"} and open_pairs[0].count() == 0


def test_components_of_a_path_and_a_hub(spark):
    path = [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(20)]
    hub = [("q99", f"q{i:02d}") for i in range(15)]
    edges = path + hub
    random.Random(1).shuffle(edges)
    nodes = {n for e in edges for n in e} | {"z"}
    got = X.connected_components(
        spark.createDataFrame([(n,) for n in nodes], "node string"),
        spark.createDataFrame(edges, "x string, y string"),
    )
    want = {n: {"p": "p00", "q": "q00", "z": "z"}[n[0]] for n in nodes}
    assert dict(rows_of(got, "node", "component")) == want


def test_components_without_edges(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    got = X.connected_components(nodes, spark.createDataFrame([], "x string, y string"))
    assert rows_of(got, "node", "component") == [("a", "a"), ("b", "b")]


@pytest.mark.parametrize("cells", [2, 5, 16_384])
def test_order_statistics(spark, monkeypatch, cells):
    from logloom.operators import selection

    monkeypatch.setattr(selection, "CELLS", cells)
    rng = random.Random(cells)
    values = [rng.choice([rng.randint(-50, 50), 10**15 + rng.randint(0, 9)]) for _ in range(80)]
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    for k in (1, 17, 40, 80):
        cut = kth_smallest(df, "x", lambda rows: k)
        assert cut.value == sorted(values)[k - 1]
        assert cut.below == sum(v < cut.value for v in values)
    assert quantile_disc(df, "x", 0.8) == sorted(values)[63]
    assert kth_smallest(df.where("x > 10e17"), "x", lambda rows: 1) is None


def test_share_is_exact():
    assert share(0.8)(10) == 8 and share(0.8)(11) == 9 and share(0.1)(10**12) == 10**11


def test_ties_at_the_cut(spark):
    df = spark.createDataFrame([(v, i) for i, v in enumerate([5, 5, 5, 1, 9])], "x bigint, i int")
    got = flag_smallest(df, "x", ["i"], lambda rows: 3, "first")
    assert rows_of(got.where("first"), "i") == [(0,), (1,), (3,)]
    assert sample_rows(df, "x", ["i"], lambda rows: 2).count() == 2


@pytest.fixture(scope="module")
def timeline(make_log):
    """Ten cases of two events, two of them across the cut."""
    rows = [(f"c{i}", t, "u", 10 * i + d, 10 * i + d + 1) for i in range(8) for t, d in (("A", 0), ("B", 3))]
    rows += [("c8", "A", "u", 5, 6), ("c8", "B", "u", 95, 96)]
    rows += [("c9", "A", "u", 90, 91), ("c9", "B", "u", 99, 100)]
    return make_log(rows)


def test_contained_split_drops_straddling_cases(timeline):
    train, test = split_timeline(timeline, LogSchema(), 0.8, "contained")
    assert rows_of(train.select("caseid").distinct()) == [(f"c{i}",) for i in range(7)]
    assert rows_of(test.select("caseid").distinct()) == [("c9",)]  # c7 and c8 straddle


def test_trace_split_takes_whole_cases(timeline):
    parts = dict(rows_of(case_parts(timeline, LogSchema(), 0.8, "trace"), "caseid", "part"))
    assert [c for c, p in sorted(parts.items()) if p == "test"] == ["c7", "c9"]


def test_auto_falls_back(timeline, make_log):
    parts = dict(rows_of(case_parts(timeline, LogSchema(), 0.8, "auto"), "caseid", "part"))
    assert parts["c9"] == "test" and "c8" not in parts  # 2 of 20 events is enough
    long = make_log([("a", "A", "u", s, s) for s in (0, 9)] + [("b", "B", "u", s, s) for s in (1, 10)])
    parts = dict(rows_of(case_parts(long, LogSchema(), 0.5, "contained"), "caseid", "part"))
    assert parts == {}
    parts = dict(rows_of(case_parts(long, LogSchema(), 0.5, "trace"), "caseid", "part"))
    assert parts == {"a": "train", "b": "test"}
    with pytest.raises(ValueError):
        case_parts(long, LogSchema(), 0.5, "other")


def test_null_user_shares_a_role_by_its_profile(make_log):
    from logloom.operators.roles import discover_roles

    rows = [("c", t, u, 0, 1) for u in ("u1", "u2", None) for t in "AAB"]
    rows += [("c", t, "u3", 0, 1) for t in "CCD"]
    roles = {r.user: r.role for r in discover_roles(make_log(rows), 0.85).collect()}
    assert roles["u1"] == roles["u2"] == roles[None] == "Role 1" and roles["u3"] == "Role 2"
