"""Communities of planted groups, lazy funding trace, stored graphs, tables with defaults, completed edge properties."""
import hashlib
import random
import threading

import pytest
from pyspark.sql import functions as F

from tidewell.functions import spec as S
from tidewell.operators import communities as CM
from tidewell.operators.communities import co_membership, communities, modularity
from tidewell.operators.edges import bernoulli_edges, distinct_pairs, k_targets
from tidewell.plans import graph_queries as GQ
from tidewell.plans import graphs as G
from tidewell.plans import source_queries as SQ
from tidewell.plans.datasets import SPECS, build_table, create_statement
from tidewell.plans.user_graphs import ORG_CHART, build_graph
from tidewell.sources import tables as TB
from tidewell.sources.fixtures import Tables
from tidewell.sources.graph_store import EdgeStore, load_graph, save_graph

from .conftest import SF_ORACLE, SF_SMALL


def test_planted_groups_become_communities(spark):
    r = random.Random(4)
    # four groups of twelve; clients meet members of one group, a few of two
    rows = []
    for client in range(300):
        group = client % 4
        pool = [f"w{group}-{i}" for i in range(12)]
        rows += [(client, m) for m in r.sample(pool, 4)]
        if client % 25 == 0:
            rows.append((client, f"w{(group + 1) % 4}-0"))
    links = co_membership(spark.createDataFrame(rows, "client long, worker string"), "client", "worker")
    got = {x["node"]: x["community"] for x in communities(links, 8).collect()}
    assert len(got) == 48 and len(set(got.values())) == 4
    assert all(got[f"w{g}-{i}"] == got[f"w{g}-0"] for g in range(4) for i in range(12))
    q = modularity(links, spark.createDataFrame(list(got.items()), "node string, community string")).collect()
    assert sum(x["members"] for x in q) == 48 and sum(x["modularity"] for x in q) > 0.6


def test_links_of_a_large_group_grow_with_its_members(spark):
    df = spark.range(3000).select(F.lit("hot").alias("g"), F.col("id").alias("m"))
    links = co_membership(df, "g", "m", reach=8)
    assert links.count() == sum(min(8, 2999 - i) for i in range(3000))
    assert communities(links.filter("a < 0")).count() == 0


def _md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def _plain_communities(links, rounds, levels):
    """The moves of ``communities`` in plain integers."""
    ways = {}
    for a, b, w in links:
        for x, y in ((a, b), (b, a)):
            ways[x, y] = ways.get((x, y), 0) + w
    k = {}
    for (a, _), w in ways.items():
        k[a] = k.get(a, 0) + w
    two_m, found = sum(k.values()), {n: n for n in k}
    for _ in range(levels):
        c = {n: n for n in k}
        for r in range(rounds):
            tot = {}
            for n in k:
                tot[c[n]] = tot.get(c[n], 0) + k[n]
            now = dict(c)
            for u in k:
                if ord(_md5(u, r)[0]) % 2 == 0:
                    to = {c[u]: 0}
                    for (a, b), w in ways.items():
                        if a == u:
                            to[c[b]] = to.get(c[b], 0) + w
                    now[u] = min((-(two_m * w - k[u] * (tot[x] - (k[u] if x == c[u] else 0))), x != c[u], x) for x, w in to.items())[2]
            c = now
        first = {x: min(n for n in c if c[n] == x) for x in set(c.values())}
        c = {n: first[x] for n, x in c.items()}
        found = {n: c[x] for n, x in found.items()}
        up, up_k = {}, {}
        for (a, b), w in ways.items():
            if c[a] != c[b]:
                up[c[a], c[b]] = up.get((c[a], c[b]), 0) + w
        for n in k:
            up_k[c[n]] = up_k.get(c[n], 0) + k[n]
        ways, k = up, up_k
    return found


@pytest.mark.parametrize("most", [3, 10 ** 9])  # gains that fit into a long together with a label, and gains that do not
def test_communities_by_plain_integers(spark, most):
    r = random.Random(most)
    pairs = {tuple(sorted(r.sample(range(60), 2))) for _ in range(150)}
    links = [(f"n{a}", f"n{b}", r.randint(1, most)) for a, b in pairs]
    got = communities(spark.createDataFrame([*links, ("n1", "n1", 7), (None, "n1", 7)], "a string, b string, w long"), 4)
    want = _plain_communities(links, 4, 2)
    assert {x["node"]: x["community"] for x in got.collect()} == want and 1 < len(set(want.values())) < 60


def test_links_go_once_to_their_nodes(spark, monkeypatch):
    plans, write = [], CM.settled

    def seen(df, name):
        out = write(df, name)
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(CM, "settled", seen)
    links = spark.range(3000).selectExpr("id % 97 AS a", "id % 89 AS b", "1L AS w").filter("a <> b")
    communities(links, 3, 1).count()
    rounds = [p for n, p in plans if n == "labels"]
    assert len(rounds) == 4 and not any("Exchange hashpartitioning(u#" in p for p in rounds)


def test_co_membership_by_brute_force(spark):
    # groups within blocks of places, over their borders and over several of them; null groups and members, repeats
    rows = [(g, m) for g in range(40) for m in range(g * 7 % 23)] + [(100, m) for m in range(1500)] + [(200, m) for m in range(5)] * 2 + [(None, 1), (None, 2), (300, None), (300, 4)]
    want = {}
    for g in {g for g, _ in rows if g is not None}:
        members = sorted({m for x, m in rows if x == g}, key=lambda m: _md5(g) if m is None else _md5(g, m))
        for i, x in enumerate(members):
            for y in members[i + 1: i + 3]:
                ends = [v for v in (x, y) if v is not None]
                key = (min(ends), max(ends))
                want[key] = want.get(key, 0) + 1
    got = co_membership(spark.createDataFrame(rows, "g long, m long"), "g", "m", reach=2)
    assert {(x["a"], x["b"]): x["w"] for x in got.collect()} == want


def test_numbered_links_give_the_same_communities(spark):
    r = random.Random(9)
    rows = spark.createDataFrame([(c, f"CW-{r.randrange(10 * (c % 3), 10 * (c % 3) + 12) ** 2}") for c in range(60) for _ in range(5)], "c long, w string")
    links, names = co_membership(rows, "c", "w", numbered=True)
    name = {x["node"]: x["name"] for x in names.collect()}
    assert [name[i] for i in sorted(name)] == sorted(name.values())
    plain = co_membership(rows, "c", "w")
    assert {(name[x["a"]], name[x["b"]], x["w"]) for x in links.collect()} == {tuple(x) for x in plain.collect()}
    got = {name[x["node"]]: name[x["community"]] for x in communities(links, 4, names=names).collect()}
    assert got == {x["node"]: x["community"] for x in communities(plain, 4).collect()} and len(set(got.values())) > 1


def test_one_target_of_each_source_is_the_general_draw(spark):
    one = k_targets(spark.range(200), "id", 50, 1, 1, 7, "X")
    general = k_targets(spark.range(200), "id", 50, 1, 2, 7, "X")
    assert one.dtypes == general.dtypes
    assert {r["src"]: r["dst_ord"] for r in one.collect()}.keys() == set(range(200))
    single = {r["src"]: r["dst_ord"] for r in general.groupBy("src").agg(F.count("j").alias("n"), F.max("dst_ord").alias("dst_ord")).filter("n = 1").collect()}
    assert len(single) > 50 and all({r["src"]: r["dst_ord"] for r in one.collect()}[s] == d for s, d in single.items())
    assert k_targets(spark.range(5), "id", 0, 1, 1, 7, "X").count() == 0


def test_places_beyond_one_block(spark):
    df = spark.range(30_000).select((F.col("id") / 7).cast("long").alias("g"), F.col("id").alias("m"))
    links = co_membership(df, "g", "m", reach=8)
    n = [min(7, 30_000 - g * 7) for g in range(30_000 // 7 + 1)]
    assert links.count() == sum(x * (x - 1) // 2 for x in n)
    assert links.filter("cast(a / 7 as long) <> cast(b / 7 as long)").count() == 0


def test_pairs_are_not_drawn_again_by_a_join(spark):
    pairs = distinct_pairs(spark.range(100), "id", 7, 90, 1, "X")
    met = pairs.selectExpr("concat('A-', a_ord) AS a").join(spark.range(7).selectExpr("concat('A-', id) AS a"), "a")
    assert met.count() == 100
    filters = [x for x in met._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert not any("md5" in x for x in filters)


def test_modularity_by_brute_force(spark):
    links = [("a", "b", 3), ("b", "c", 1), ("c", "d", 4), ("d", "d", 9)]
    of = {"a": "a", "b": "a", "c": "c", "d": "c"}
    rows = {x["community"]: x for x in modularity(spark.createDataFrame(links, "a string, b string, w long"), spark.createDataFrame(list(of.items()), "node string, community string")).collect()}
    for c in "ac":
        inside = sum(w for a, b, w in links if a != b and of[a] == of[b] == c)
        degree = sum(w for a, b, w in links if a != b for x in (a, b) if of[x] == c)
        assert (rows[c]["inside"], rows[c]["degree"]) == (inside, degree)
        assert rows[c]["modularity"] == pytest.approx(inside / 8 - (degree / 16) ** 2, abs=1e-6)


def test_funding_trace_runs_nothing_while_it_is_built(spark):
    t = Tables(spark, SF_SMALL)
    t.nation, t.part, t.supplier, t.orders  # their footers, which name the columns, are read by a job of their own
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("funding", "plan only")
    try:
        df = GQ.h4_funding_trace(t)
        assert len(tracker.getJobIdsForGroup("funding")) == 0
        assert df.count() == 25
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_second_populate_adds_only_new_sources(spark, tmp_path):
    store = EdgeStore(spark, str(tmp_path / "e"))

    def build(missing):
        return k_targets(missing, "id", 50, 2, 2, 7, "X").select("src", F.col("dst_ord").alias("dst"))
    assert store.versions() == [] and store.populate(spark.range(10), "id", build) == 20
    assert store.populate(spark.range(15), "id", build) == 10
    assert store.populate(spark.range(15), "id", build) == 0
    e = store.edges()
    assert {r["version"]: r["count"] for r in e.groupBy("version").count().collect()} == {1: 20, 2: 10}
    whole = build(spark.range(15))
    assert sorted(map(tuple, e.select("src", "dst").collect())) == sorted(map(tuple, whole.collect()))
    # a run that failed before its end is not seen, and the next one takes its place
    (tmp_path / "e" / "version=4").mkdir()
    (tmp_path / "e" / "version=4" / "half").write_text("x")
    assert store.versions() == [1, 2, 3]
    assert store.clear() and store.versions() == []


def test_saved_graph_is_cleared_first(spark, tmp_path):
    t = Tables(spark, SF_SMALL)
    g = build_graph(t, ORG_CHART)
    first = save_graph(spark, g, str(tmp_path / "g"), clear_first=True)
    again = save_graph(spark, g, str(tmp_path / "g"), clear_first=True)
    back = load_graph(spark, str(tmp_path / "g"), g.keys, list(g.edges))
    counts = {r["label"]: r["count"] for r in back.label_counts().collect()}
    assert first == again and counts == {n: first[n] for n in g.nodes}
    save_graph(spark, g, str(tmp_path / "g"))
    more = load_graph(spark, str(tmp_path / "g"), g.keys, list(g.edges))
    assert {r["label"]: r["count"] for r in more.label_counts().collect()} == {n: 2 * c for n, c in counts.items()}


def test_defaults_of_a_created_table(spark, tmp_path):
    t = Tables(spark, SF_SMALL)
    name = f"tw_students_{random.randrange(10 ** 9)}"
    ddl = create_statement("students", name, str(tmp_path / "s"))
    assert TB.create_from_ddl(spark, ddl, name) and not TB.create_from_ddl(spark, ddl, name)
    n = TB.insert_with_defaults(build_table(t, "students"), name)
    df = spark.table(name)
    assert n == df.count() == t.customer.count() and df.filter("created_at IS NULL").count() == 0
    d = {r["column_name"]: r["column_default"] for r in TB.describe(df).collect()}
    assert d.pop("created_at") == "current_timestamp()" and set(d.values()) == {None} and len(d) == 11
    with pytest.raises(ValueError):
        TB.insert_with_defaults(spark.range(1), name)
    assert len(SPECS) == 17
    TB.drop(spark, name)


def test_tables_are_filled_at_the_same_time(spark, tmp_path, monkeypatch):
    spark.range(7).selectExpr("cast(id as int) AS n_nationkey").write.parquet(str(tmp_path / "nation.parquet"))
    monkeypatch.setattr(SQ, "SPECS", {n: SPECS[n] for n in ("agencies", "schools")})
    both, insert = threading.Barrier(2), TB.insert_with_defaults

    def insert_with_the_other(df, name):
        both.wait(60)  # breaks if the second table waits for the first one
        return insert(df, name)

    monkeypatch.setattr(SQ.TB, "insert_with_defaults", insert_with_the_other)
    got = SQ.e_table_defaults(Tables(spark, str(tmp_path))).collect()
    assert [(r["table_name"], r["column_name"], r["row_count"], r["filled"]) for r in got] == [("agencies", "created_at", 7, 7), ("schools", "created_at", 7, 7)]


def test_insert_with_defaults_leaves_other_views(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("_tidewell_insert")
    name = f"tw_ids_{random.randrange(10 ** 9)}"
    TB.create_from_ddl(spark, f"CREATE TABLE {name} (id BIGINT, n INT DEFAULT 5) USING parquet LOCATION '{tmp_path / 'i'}'", name)
    assert TB.insert_with_defaults(spark.range(10, 14), name) == 4
    assert sorted(tuple(r) for r in spark.table(name).collect()) == [(i, 5) for i in range(10, 14)]
    assert spark.table("_tidewell_insert").count() == 3
    spark.catalog.dropTempView("_tidewell_insert")
    TB.drop(spark, name)


def test_edge_properties_equal_their_nodes(spark):
    t = Tables(spark, SF_ORACLE)
    p, k, b = G.procurement_graph(t), G.early_warning_graph(t), G.benefits_graph(t)
    for g, rel, prop, end, label, key, own in ((p, "AWARDED_TO", "award_date", "src", "Contract", "contract_id", "start_date"),
                                               (p, "SUBCONTRACTS_TO", "scope", "dst", "ProcVendor", "vendor_id", "specialty"),
                                               (p, "REPRESENTS", "since", "src", "Lobbyist", "lobbyist_id", "registration_date"),
                                               (k, "TAUGHT_BY", "subject", "dst", "Teacher", "teacher_id", "subject")):
        e = g.rel(rel).select(F.col(end).alias(key), F.col(prop).alias("_p"))
        met = e.join(g.node(label).select(key, F.col(own).alias("_o")), key)
        assert met.count() == e.count() > 0 and met.filter(~F.col("_p").eqNullSafe(F.col("_o"))).count() == 0, rel
    assert b.rel("REFERRED").select("date", "source").distinct().count() <= 1
    assert k.rel("ATTENDS").filter("enrollment_date > '2025-12-31' OR enrollment_date < '2023-04-01'").count() == 0


@pytest.mark.parametrize("expr", ["monotonically_increasing_id()", "current_date()", "unix_timestamp()", "localtimestamp()", "rand()", "current_date", "concat('a', uuid())",
                                  "spark_partition_id() + id", "input_file_name()"])
def test_expressions_that_differ_between_runs_are_refused(spark, expr):
    with pytest.raises(S.SpecError):
        S.generate(spark, [{"name": "x", "type": "string", "expr": expr}], 5)


def test_expressions_that_only_mention_them_are_fine(spark):
    rows = S.generate(spark, [{"name": "x", "type": "string", "expr": "concat('now() and rand() ', id)"}, {"name": "u", "type": "long", "expr": "unix_timestamp(timestamp'2024-01-01')"}], 2).collect()
    assert rows[1]["x"] == "now() and rand() 1"
    assert S.generate(spark, [{"name": "x", "type": "double", "expr": "rand()", "unseeded": True}], 2).count() == 2


def test_a_stated_probability_holds_for_many_targets(spark):
    n = bernoulli_edges(spark.range(20), "id", 100_000, 0.01, 1, "P", dense_targets=None).count()
    assert 18_500 < n < 21_500
    assert 250 < bernoulli_edges(spark.range(20), "id", 100_000, 0.01, 1, "P").count() < 550
