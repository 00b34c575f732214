"""Rules that the queries' data don't reach, on small tables."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera.functions import scores as S
from tessera.functions import text as T
from tessera.operators import access as A
from tessera.operators import graph as G
from tessera.operators import messages as M
from tessera.operators import mutate as U
from tessera.operators import neardup as D
from tessera.operators import ranking as R
from tessera.operators import search
from tessera.operators import vectors as V
from tessera.plans.engine import Engine
from tessera.plans.maintenance import Tables, dedup, maintain
from tessera.sources.config import Config, clamp, names
from tessera.sources.schemas import NODES, TABLES
from tessera.sources.snapshots import Store
from tessera.streaming import sessions as E

EDGE = "id string, from_id string, to_id string, name string, description string, session_id string, created_at bigint"


def nodes(spark, *rows):
    base = {"type": "SKILL", "name": None, "description": "", "content": "c", "status": "active", "validated_count": 1, "source_sessions": ["s"], "flags": "[]", "pagerank": 0.0, "belief": 0.5, "success_count": 0.0, "failure_count": 0.0, "access_count": 0, "last_accessed_at": 0, "created_at": 0, "updated_at": 0}
    columns = [f.split()[0] for f in NODES.split(", ")]
    full = [base | {"id": r["id"], "name": r["id"]} | r for r in rows]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in full], NODES)


def edges(spark, *pairs):
    return spark.createDataFrame([(f"e{k}", a, b, "uses", "d", "s", 0) for k, (a, b) in enumerate(pairs)], EDGE)


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_walk_depth_and_cap(spark):
    n = nodes(spark, *({"id": f"n{k}"} for k in range(25)), {"id": "gone", "status": "deprecated"})
    e = edges(spark, ("n0", "n1"), ("n1", "n2"), ("n2", "n3"), ("n0", "gone"), ("gone", "n24"))
    near, _ = G.walk(n, e, ids(spark, "n0"), 1)
    assert got(near, "id") == [("n0",), ("n1",)]
    far, among = G.walk(n, e, ids(spark, "n0"), 2)
    assert got(far, "id") == [("n0",), ("n1",), ("n2",), ("n24",)]
    assert ("e3",) in got(among, "id")
    hub = edges(spark, *(("n0", f"n{k}") for k in range(1, 21)))
    assert G.walk(n, hub, ids(spark, "n0"), 2, 5)[0].count() == 5


@pytest.mark.parametrize("kernel", [0, 10**6])
def test_pagerank(spark, kernel):
    n = nodes(spark, *({"id": c} for c in "abcdefg"))
    adj = G.adjacency(n, edges(spark, ("a", "b"), ("b", "c"), ("b", "d"), ("e", "f")))
    own = {r["id"]: r["score"] for r in G.pagerank(n, adj, ids(spark, "a"), kernel_rows=kernel).collect()}
    assert own["b"] > own["e"] == 0 and sum(own.values()) == pytest.approx(1)
    world = {r["id"]: r["score"] for r in G.pagerank(n, adj, kernel_rows=kernel).collect()}
    assert max(world, key=world.get) == "b" and sum(world.values()) == pytest.approx(1)
    assert G.pagerank(n, adj, ids(spark, "nobody"), kernel_rows=kernel).count() == 0


def test_flags_must_be_exact_and_well_formed(spark):
    rows = [("a", '["hot"]'), ("b", '["hot-ish"]'), ("c", "not json"), ("d", '{"hot":1}'), ("e", "[]"), ("f", '["scope_hot:x","hot"]'), ("g", None)]
    n = nodes(spark, *({"id": k, "flags": f} for k, f in rows))
    assert got(A.hot(n), "id") == [("a",), ("f",)]
    assert got(A.scope_hot(n, ["x"]), "id") == [("f",)]
    assert A.scope_hot(n, []).count() == 0


def test_upsert_revives_and_counts(spark):
    n = nodes(spark, {"id": "1", "name": "a-b", "type": "TASK", "status": "deprecated", "flags": '["x"]'})
    rows = spark.createDataFrame([("A b", "SKILL", "d1", "c1", "s1", ["y"], 1), ("a_b", "EVENT", "d2", "c2", "s2", ["x"], 2)], "name string, type string, description string, content string, session_id string, flags array<string>, seq int")
    r = U.upsert_nodes(n, rows, 99).first()
    assert (r["type"], r["content"], r["status"], r["validated_count"], r["source_sessions"], r["flags"], r["updated_at"]) == ("TASK", "c2", "active", 3, ["s", "s1", "s2"], '["x","y"]', 99)


def test_few_mentions_leave_nodes_unshuffled_and_many_give_the_same(spark):
    n = nodes(spark, {"id": "1", "name": "a"}, {"id": "2", "name": "b", "status": "deprecated"}, {"id": "3"})
    rows = spark.createDataFrame([("A", "SKILL", "d1", "c1", "s1", ["y"], 1), ("new", "EVENT", "d2", "c2", "s2", ["x"], 2), (None, "TASK", "d3", "c3", "s3", [], 3)], "name string, type string, description string, content string, session_id string, flags array<string>, seq int")
    few, many = U.upsert_nodes(n, rows, 99), U.upsert_nodes(n, rows, 99, broadcast_chars=-1)
    assert few.columns == many.columns and sorted(map(repr, few.collect())) == sorted(map(repr, many.collect()))
    assert few.count() == 5 and "FullOuter" not in few._jdf.queryExecution().executedPlan().toString()


def test_merging_moves_edges_once(spark):
    m = spark.createDataFrame([("b", "a")], "merge_id string, keep_id string")
    found = U.merged_edges(edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "b")), m)
    assert got(found, "id", "from_id", "to_id") == [("e1", "a", "c"), ("e3", "c", "a")]


def test_incremental_dedup_leaves_no_cross_type_pairs(spark):
    rows = [("a", [1.0, 0.0], "T"), ("b", [1.0, 0.001], "T"), ("c", [1.0, 0.0], "S"), ("d", [0.0, 1.0], "T")]
    v = spark.createDataFrame(rows, "node_id string, embedding array<float>, type string")
    assert got(D.all_pairs(v), "a", "b") == [("a", "b")]


def test_blocks_lose_no_pair(spark):
    r = random.Random(3)
    rows = [(f"v{k:03d}", [r.gauss(0, 1) for _ in range(4)], "T") for k in range(60)]
    v = spark.createDataFrame(rows, "node_id string, embedding array<float>, type string")
    small = D.blocked(v, 7)
    pairs = got(D.scored_pairs(small, small, 0.8, True), "a", "b")

    def cosine(x, y):
        return sum(p * q for p, q in zip(x, y, strict=True)) / (sum(p * p for p in x) ** 0.5 * sum(q * q for q in y) ** 0.5)

    assert pairs == sorted((a[0], b[0]) for a, b in combinations(rows, 2) if cosine(a[1], b[1]) >= 0.8)


def odd_vectors(spark):
    r = random.Random(4)
    rows = [(f"v{k:03d}", [r.gauss(0, 1) for _ in range(3 + k % 3)], "TS"[k % 2]) for k in range(80)]
    rows += [("e", [], "T"), ("f", [None, 1.0], "T"), ("g", None, "T"), ("h", [float("nan")] * 3, "T"), ("i", [float("inf"), 0.0, 1.0], "T"), ("j", [0.0, 0.0], "T"), ("k", [1e-6, 0.0], "T"), ("k", [1.0], "T"), ("l", [1e-6], "T"), (None, [1.0], "T"), ("m", [1.0], None)]
    return spark.createDataFrame(rows, "node_id string, embedding array<double>, type string")


def test_pairs_come_from_blocks_not_from_a_join_of_rows(spark):
    v = odd_vectors(spark)
    a, b = (v.toDF(n, f"e{n}", "type") for n in "ab")
    near = a.join(b, "type").withColumn("similarity", S.cosine(F.col("ea"), F.col("eb"))).filter("similarity >= 0.8")
    rows = lambda df: got(df.withColumn("similarity", F.col("similarity").cast("string")), "a", "b", "type", "similarity")
    small = D.blocked(v, 9)
    found = D.scored_pairs(small, small, 0.8, True)
    assert rows(found) == rows(near.filter("a < b"))
    some = lambda df, name, odd: df.filter(F.substring(name, -1, 1).isin(*"13579ehk") == F.lit(odd))
    crossed = D.scored_pairs(some(small, "node_id", True), some(small, "node_id", False), 0.8, False)
    assert rows(crossed) == rows(some(some(near, "a", True), "b", False).filter("a <> b"))
    assert str(found._jdf.queryExecution().optimizedPlan()).startswith("FlatMapGroupsInArrow")


def test_capped_pairs_are_the_first_of_all(spark):
    v = odd_vectors(spark).filter("node_id is not null")
    rows = D.blocked(v, 9)
    whole = [r[:3] for r in sorted((r["type"], r["a"], r["b"]) for r in D.scored_pairs(rows, rows, 0.5, True).collect())]
    units = rows.groupBy("type").agg(F.first(F.col("blocks") * (F.col("blocks") + 1) / 2).alias("n")).agg(F.sum("n")).first()[0]
    few = D.scored_pairs(rows, rows, 0.5, True, 3)
    assert 7 < few.count() <= 3 * units < len(whole)
    assert [tuple(r) for r in few.select("type", "a", "b").orderBy("type", "a", "b").limit(3).collect()] == whole[:3]
    assert got(D.all_pairs(v, 0.5, 7), "type", "a", "b") == whole[:7]


def test_greedy_merges_follow_counts(spark):
    n = nodes(spark, {"id": "a", "validated_count": 5}, {"id": "b", "validated_count": 2}, {"id": "c", "validated_count": 6}, {"id": "d"})
    pairs = spark.createDataFrame([("a", "b", "T", 0.99), ("a", "c", "T", 0.95), ("b", "d", "T", 0.94)], "a string, b string, type string, similarity double")
    merges = D.greedy_merges(pairs, n)
    assert got(merges, "merge_id", "keep_id") == [("b", "a"), ("c", "a")]  # 5 + 2 beats 6; b is gone
    assert D.greedy_merges(pairs, n, 1).count() == 1
    chain = spark.createDataFrame([("b", "a"), ("a", "c")], "merge_id string, keep_id string")
    assert got(D.final_targets(chain), "merge_id", "keep_id") == [("a", "c"), ("b", "c")]


def test_merges_by_group_equal_merges_in_one_task(spark):
    r = random.Random(5)
    n = nodes(spark, *({"id": f"v{k:02d}", "validated_count": r.randint(1, 4), "updated_at": r.randint(1, 3)} for k in range(80)))
    rows = [(f"v{a:02d}", f"v{b:02d}", "T", round(r.uniform(0.9, 1), 3)) for a, b in combinations(range(80), 2) if r.random() < 0.015 or b == a + 1 < 20]
    pairs = spark.createDataFrame(rows, "a string, b string, type string, similarity double")
    assert got(D.greedy_merges(pairs, n, None), "merge_id", "keep_id") == got(D.greedy_merges(pairs, n, len(rows)), "merge_id", "keep_id")


def near_pairs(spark, n, checked_at=0):
    """Tables of n pairs of equal vectors, and nothing else that is similar."""
    rows = [(f"{side}{k}", [float(j == k) for j in range(n)]) for k in range(n) for side in "ab"]
    v = spark.createDataFrame([(i, e, "h", 1, checked_at) for i, e in rows], "node_id string, embedding array<float>, content_hash string, updated_at bigint, dedup_checked_at bigint")
    none = spark.createDataFrame([], "id string, created_at bigint, session_id string")
    return Tables(nodes(spark, *({"id": i} for i, _ in rows)), edges(spark, ("a0", "b1")), v, none, none)


def test_merge_budget_loses_no_pair(spark):
    t, config = near_pairs(spark, 5), Config(dedup_max_merges=2)
    reports = []
    for now in (10, 20, 30):
        t, report = dedup(t, now, config)
        reports.append(tuple(report.first()))
    # pending before and after, checked, pairs, merged
    assert reports == [(10, 6, 4, 5, 2), (6, 2, 4, 3, 2), (2, 0, 2, 1, 1)]
    assert t.nodes.filter("status = 'active'").count() == 5


def test_no_pending_budget_means_a_full_pass(spark):
    t, report = dedup(near_pairs(spark, 3, checked_at=5), 10, Config(dedup_max_pending=0))
    assert tuple(report.first()) == (0, 0, 6, 3, 3) and t.nodes.filter("status = 'active'").count() == 3


def test_no_pair_budget_means_no_cap(spark):
    _, report = dedup(near_pairs(spark, 3), 10, Config(dedup_max_pairs=0, dedup_max_merges=2))
    assert tuple(report.first()) == (6, 2, 4, 3, 2)


def test_without_budgets_one_pass_leaves_nothing(spark):
    t, report = dedup(near_pairs(spark, 5), 10, Config(dedup_max_pending=4, dedup_max_pairs=2, dedup_max_merges=1), budgets=False)
    assert tuple(report.first()) == (10, 0, 10, 5, 5) and t.nodes.filter("status = 'active'").count() == 5


def test_maintenance_without_budgets_leaves_nothing(spark):
    t = near_pairs(spark, 3)
    t.messages = spark.createDataFrame([(f"m{k}", 0, "old" if k else "kept") for k in range(5)], "id string, created_at bigint, session_id string")
    t.recalled = spark.createDataFrame([("r0", 0, "old"), ("r1", 10**10, "old")], "id string, created_at bigint, session_id string")
    kept = spark.createDataFrame([("kept",)], "session_id string")
    few = Config(retention_batch=2, dedup_max_pending=4, dedup_max_merges=1)
    t, report = maintain(t, kept, 10**10, 1, few, budgets=False)
    assert (got(t.messages, "id"), got(t.recalled, "id"), report.first()["merged"]) == ([("m0",)], [("r1",)], 3)


def test_vector_search_order_and_limits(spark):
    n = nodes(spark, {"id": "x"}, {"id": "y"}, {"id": "z"}, {"id": "gone", "status": "deprecated"})
    v = spark.createDataFrame([("x", [1.0, 0.0, 0.0]), ("y", [0.9, 0.1, 0.0]), ("z", [0.0, 1.0, 0.0]), ("gone", [1.0, 0.0, 0.0])], "node_id string, embedding array<float>")
    assert [r["node_id"] for r in V.top_k(n, v, [1.0, 0.0, 0.0], 2).collect()] == ["x", "y"]
    assert V.top_k(n, v, [0.0, 0.0, 0.0], 2).count() == V.top_k(n, v, [1.0, 0.0, 0.0], 0).count() == 0


def test_search_falls_back(spark):
    n = nodes(spark, {"id": "1", "content": "install docker compose"}, {"id": "2", "content": "数据库连接池"}, {"id": "3", "content": "docker", "status": "deprecated"})
    assert got(search.search(n, "docker"), "id") == [("1",)]
    assert got(search.search(n, "连接"), "id") == [("2",)]
    assert got(search.search(n, "docker-compose"), "id") == [("1",)]
    assert search.search(n, "", 1).count() == 1
    for query in ("docker", "docker-compose install", "池 数据库连接池"):
        scanned = {r["id"]: round(r["score"], 9) for r in search.matches(n, query).collect()}
        assert scanned == {r["id"]: round(r["score"], 9) for r in search.indexed_matches(n, search.index(n), query).collect()}


def test_context_by_python_model(spark):
    """The order-dependent context rule against a loop, on random sessions."""
    r = random.Random(5)
    rows = [(f"s{s}", t, r.choice(["user", "assistant", "tool"])) for s in range(15) for t in range(r.randint(1, 30))]
    m = spark.createDataFrame([(f"{s}-{t:03d}", s, t, role, "x", True, 0) for s, t, role in rows], "id string, session_id string, turn_index int, role string, content string, extracted boolean, created_at bigint")
    for turns in (1, 3):
        found = {}
        for x in M.recent_extracted(m, turns).orderBy("session_id", "ord").collect():
            found.setdefault(x["session_id"], []).append(x["turn_index"])
        for s in {x[0] for x in rows}:
            own = [x for x in rows if x[0] == s][-turns * 20 :]
            groups, now = [], []
            for x in own:
                now.append(x)
                if x[2] == "user":
                    groups.append(now[::-1])
                    now = []
                    if len(groups) == turns:
                        break
            if now and len(groups) < turns:
                groups.append(now[::-1])
            assert found.get(s, []) == [x[1] for g in groups for x in g]


def test_compaction_by_python_model(spark):
    r = random.Random(9)
    n = nodes(spark, *({"id": f"n{k:03d}", "type": r.choice(["SKILL", "TASK", "EVENT", "KNOWLEDGE", "STATUS"]), "updated_at": r.randint(0, 40)} for k in range(80)))
    rows = sorted(n.collect(), key=lambda x: (x["updated_at"], x["id"]))
    left, quota = list(rows), {"TASK": 5, "EVENT": 10, "KNOWLEDGE": 10}
    for x in rows:
        if len(left) <= 30:
            break
        if x["type"] != "SKILL" and sum(y["type"] == x["type"] for y in left) > quota.get(x["type"], 0):
            left.remove(x)
    assert got(M.compacted(n, 30), "id") == sorted((x["id"],) for x in left)


def test_equal_scores_count_as_one(spark):
    rows = spark.createDataFrame([("a", 0.3), ("b", 0.3)], "id string, x double")
    assert got(rows.select("id", S.min_max(F.col("x")).alias("s")), "s") == [(1.0,), (1.0,)]


def test_missing_vector_scores_nothing(spark):
    rows = spark.createDataFrame([(None,), (0.0,), (0.5,)], "v double")
    assert sorted(r[0] for r in rows.select(S.hybrid(F.col("v"), F.lit(0.0))).collect()) == [0.0, 0.0, 0.3]


def test_parallel_results_prefer_tier_then_first(spark):
    c = "id string, name string, tier string, ppr double, place int"
    a = spark.createDataFrame([("1", "x", "L2", 0.1, 1), ("2", "y", "L1", 0.2, 2)], c)
    b = spark.createDataFrame([("3", "x", "L1", 0.3, 1), ("2", "y", "L1", 0.9, 2)], c)
    assert got(R.merged_results(a, b), "name", "id", "ppr") == [("x", "3", 0.3), ("y", "2", 0.9)]


def test_config_is_clamped():
    c = Config.of({"recall_timeout_ms": 1, "dedup_max_pairs": "7.9", "breaker_max_timeouts": "x", "enabled": False, "denied_chat_ids": [" A ", "a", 3]})
    assert (c.recall_timeout_ms, c.dedup_max_pairs, c.breaker_max_timeouts, c.enabled, c.denied_chat_ids) == (50, 7, 3, False, ("a",))
    assert clamp(float("nan"), 5, 0, 9) == 5 and clamp(True, 5, 0, 9) == 5 and names("x") == ()


def test_cache_and_retries():
    cache = E.Cache(10, 2)
    for k in "abc":
        cache.put(k, k, 0)
    assert cache.get("a", 1) is None and cache.get("c", 1) == "c" and cache.get("c", 10) is None
    pauses, left = [], [ConnectionError(), ConnectionError()]

    def call():
        if left:
            raise left.pop()
        return "done"

    assert E.retried(call, pauses.append) == "done" and pauses == [1, 2]


def test_deadline_cancels(spark):
    with pytest.raises(TimeoutError):
        E.with_deadline(spark, 0.5, lambda: spark.range(10**12).selectExpr("sum(pmod(xxhash64(id), 7))").collect())
    assert E.with_deadline(spark, 60, lambda: spark.range(3).count()) == 3


def test_appending_twice_changes_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/t", TABLES)
    rows = spark.createDataFrame([("alpha", "s1", 1)], TABLES["scopes"])
    first = store.commit({"scopes": rows})["scopes"]
    assert store.append("scopes", rows, "batch-0") and not store.append("scopes", rows, "batch-0")
    assert store.read("scopes").count() == 2
    store.roll_back("scopes", first)
    assert store.read("scopes").count() == 1


def test_commits_are_whole_and_one_writer_wins(spark, tmp_path):
    first, second = (Store(spark, f"file://{tmp_path}/t", TABLES) for _ in range(2))
    rows = spark.createDataFrame([("alpha", "s1", 1)], TABLES["scopes"])
    first.commit({"scopes": rows, "edges": edges(spark, ("a", "b"))})
    known = second._manifests()
    first.commit({"scopes": rows.limit(0)})
    with pytest.raises(RuntimeError):
        second._publish(known, {"scopes": known[-1]["scopes"]})
    assert second.read("scopes").count() == 0 and second.read("edges").count() == 1 and len(second.versions("scopes")) == 2
    assert [f.name for f in (tmp_path / "t" / "_manifests").iterdir() if f.name.startswith("_")] == []


def test_text_helpers(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    assert one(T.shortened(F.lit("abcdef"), 4)) == "abcd\n...(truncated 2 chars)"
    assert one(T.user_text(F.lit("Sender (untrusted metadata)\n```json\n{}\n```\n<memory>x</memory> hi"))) == "hi"
    assert one(T.keyword_overlap(T.keywords(F.lit("the 123")), F.lit("x"))) == 0.0


def test_engine_end_to_end(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", lambda: 1_000)
    answers = spark.createDataFrame([('{"nodes":[{"type":"SKILL","name":"Use Redis","description":"cache","content":"redis-server"},{"type":"TASK","name":"Deploy","description":"","content":"ship it"}],"edges":[{"from":"Use Redis","to":"Deploy","name":"helps","description":"d"}]}', 0)], "raw string, seq int")
    engine.record(answers, "s1")
    assert got(engine.table("nodes"), "name") == [("deploy",), ("use-redis",)]
    assert engine.table("edges").count() == 1
    update = '{"nodes":[],"edges":[],"beliefUpdates":[{"nodeName":"Use Redis","verdict":"supported","weight":1.5,"reason":"ok"}]}'
    engine.record(spark.createDataFrame([(update, 1)], "raw string, seq int"), "s1")
    assert got(engine.table("belief_signals"), "signal_type", "weight", "session_id") == [("supported", 1.5, "s1")]
    engine.set_hot("use redis")
    assert engine.hot().count() == 1
    assert got(engine.search("redis").nodes, "name") == [("deploy",), ("use-redis",)]
    assert engine.explore("deploy").nodes.count() == 2
    engine.set_scope("s1", ["alpha", " ", "alpha"])
    assert got(engine.list_scopes(), "scope_name", "n") == [("alpha", 1)]
    engine.apply_topics(spark.createDataFrame([('{"nodes":[{"name":"Ops","description":"all"}],"edges":[{"from":"Deploy","to":"Ops","name":"主题属于","description":"d"},{"from":"Ops","to":"Deploy","name":"主题属于","description":"d"}]}', 0)], "raw string, seq int"), "s2")
    assert engine.table("edges").count() == 2
    engine.merge("use redis", "deploy")
    assert engine.table("edges").count() == 1
    engine.finalize("s1", spark.createDataFrame([('{"promotedSkills":[{"name":"Cache well","content":"c"}],"newEdges":[],"invalidations":[]}', 0)], "raw string, seq int"))
    assert engine.table("belief_signals").count() > 0
    none = spark.createDataFrame([("nothing to say", 0)], "raw string, seq int")
    report = engine.end_session("s1", none, none, spark.createDataFrame([("s1",)], "session_id string")).first()
    assert report["merged"] == 0 and got(engine.table("nodes").filter("type = 'SESSION'"), "name", "content") == [("session-s1", "session s1")]
    assert engine.table("edges").filter("name = '属于会话'").count() == 2
    engine.remove("session s1")
    engine.remove("ops")
    assert engine.stats().filter("what = 'nodes'").first()["n"] == 2
    with pytest.raises(KeyError):
        engine.get_flags("nobody") and engine.set_hot("nobody")


def test_a_session_s_end_doesn_t_gather_all_nodes_nor_links_to_other_sessions(spark, tmp_path):
    n = nodes(spark, {"id": "1", "name": "one", "type": "TASK"}, {"id": "2", "name": "session-old", "type": "SESSION"}, {"id": "3", "name": "three", "source_sessions": ["t"]})
    row = spark.range(1).select(F.lit("session s").alias("name"), F.lit("SESSION").alias("type"), F.lit("d").alias("description"), F.lit("c").alias("content"), F.lit("s").alias("session_id"), F.array().cast("array<string>").alias("flags"), F.lit(0).alias("seq"))
    after = U.upsert_nodes(n, row, 9)
    assert "BroadcastNestedLoopJoin" not in after._jdf.queryExecution().executedPlan().toString()
    engine = Engine(spark, f"file://{tmp_path}/store", lambda: 1_000)
    engine.store.commit({"nodes": n, "edges": edges(spark, ("1", "3"))})
    engine.induce_session("s", spark.createDataFrame([("nothing to say", 0)], "raw string, seq int"))
    new = engine.table("nodes").filter("name = 'session-s'").first()["id"]
    assert got(engine.table("edges").filter("name = '属于会话'"), "from_id", "to_id") == [("1", new)]


def test_recall_is_cached_bounded_in_time_and_rests(spark, tmp_path):
    now = [1_000]
    engine = Engine(spark, f"file://{tmp_path}/store", lambda: now[0], Config(recall_timeout_ms=600_000))
    answers = spark.createDataFrame([('{"nodes":[{"type":"SKILL","name":"Use Redis","description":"cache","content":"redis-server"}],"edges":[]}', 0)], "raw string, seq int")
    engine.record(answers, "s1")
    first = engine.recall("redis", "redis cache", "s1")
    assert got(first.nodes, "name") == [("use-redis",)] and engine.recall("redis", "redis cache", "s1") is first
    engine.set_hot("use redis")  # other tables, another answer
    assert engine.recall("redis", "redis cache", "s1") is not first
    calls = []
    engine.search = lambda text: calls.append(text) or spark.range(10**12).selectExpr("sum(pmod(xxhash64(id), 7))").collect()
    engine.config = Config(recall_timeout_ms=300)
    assert [engine.recall("a", str(k), "s1") for k in range(5)] == [None] * 5 and len(calls) == 3
    assert engine.recall("a", "other session", "s2") is None and len(calls) == 4
    now[0] += 60_000
    assert engine.recall("a", "again", "s1") is None and len(calls) == 5
