"""Closed-form cases and invariants of the operators."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars
from loomgraph.operators import consolidation, graph, ingest, resolution, rules, search, temporal, vectors, visibility
from loomgraph.schema import KINDS, kinds_table, triples, triples_table
from loomgraph.session import shared_folder
from loomgraph.sources.commit import Store

T0 = datetime(2024, 1, 1)
NODE = "memory_id string, org string, project string, team string, user_id string, visibility int"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def nodes(spark, rows):
    return spark.createDataFrame([(i, "org", p, t, u, v) for i, p, t, u, v in rows], NODE)


def links(spark, rows):
    return spark.createDataFrame([(f"r{n}", a, b, k, 3, "Asserted", 0.5) for n, (a, b, k) in enumerate(rows)], "rel_id string, from_id string, to_id string, kind string, visibility int, provenance string, confidence double")


def test_scope_never_widens(spark):
    rows = [("own", None, None, "u", 0), ("other", None, None, "v", 0), ("null", None, None, None, 0), ("p", "p1", None, None, 1), ("q", "p2", None, None, 1), ("noproject", None, None, None, 1), ("t", None, "t1", None, 2), ("o", None, None, None, 3), ("pub", None, None, None, 4)]
    frame = nodes(spark, rows)
    ids = lambda c: {r[0] for r in frame.where(visibility.memory_visible(c)).select("memory_id").collect()}
    assert ids(visibility.Caller("u", "org", ("p1",), ("t1",))) == {"own", "p", "t", "o", "pub"}
    assert ids(visibility.Caller("u", "org", ("*",))) == {"own", "p", "q", "o", "pub"}
    assert ids(visibility.Caller("u", "org", ("p1",), ("t1",), ceiling=1)) == {"own", "p"}
    assert ids(visibility.Caller("u", "elsewhere", ("*",), ("t1",))) == set()


def test_edges_need_an_end_at_their_level(spark):
    frame = nodes(spark, [("a", "p1", None, "u", 3), ("b", "p2", None, "u", 3), ("c", "p2", None, "v", 0)])
    edges = links(spark, [("a", "b", "Uses"), ("b", "c", "Uses"), ("b", "a", "Uses")]).withColumn("visibility", F.when(F.col("rel_id") == "r2", 1).otherwise(4))
    seen = visibility.visible_edges(edges, frame, visibility.Caller("u", "org", ("p1",)))
    assert {r.rel_id for r in seen.collect()} == {"r0", "r2"}
    assert {r.rel_id for r in visibility.visible_edges(edges, frame, visibility.Caller("u", "org")).collect()} == {"r0"}


def version(lsn, begin, end=None, recorded=None):
    return ("k", lsn, T0 + timedelta(days=begin), None if end is None else T0 + timedelta(days=end), T0 + timedelta(days=begin if recorded is None else recorded))


def test_version_is_chosen_before_it_is_tested(spark):
    frame = spark.createDataFrame([version(1, 0), version(2, 0, 5, 5)], "id string, version_lsn long, valid_from timestamp, valid_until timestamp, recorded_at timestamp")
    at = lambda day: [r.version_lsn for r in temporal.valid_at(frame, F.lit(T0 + timedelta(days=day)), "id").collect()]
    assert (at(3), at(6), at(-1)) == ([1], [], [])
    points = spark.createDataFrame([("k", T0 + timedelta(days=3)), ("k", T0 + timedelta(days=9)), ("x", T0)], "id string, at timestamp")
    assert [r.version_lsn for r in temporal.as_of_join(points, frame, "id", "at").collect()] == [1]


def test_gaps_and_rewinds(spark):
    feed = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("s", 5, "a"), ("s", 6, "a")], "source string, version_lsn long, digest string")
    assert [tuple(r) for r in temporal.gaps(feed, "source").collect()] == [("s", 5, 2)]
    assert [r.version_lsn for r in temporal.rewinds(feed, "source", "version_lsn", "digest").collect()] == [5]


def test_search_scores_and_empty_queries(spark):
    frame = nodes(spark, [("a", None, None, "u", 3), ("b", None, None, "u", 3)]).withColumn("title", F.lit("Redis Timeout")).withColumn("tags", F.array(F.lit("DB"))).withColumn("importance", F.lit(0.4)).withColumn("recorded_at", F.lit(T0))
    edges = links(spark, [("a", "b", "Uses"), ("a", "b", "Fixes")]).withColumn("provenance", F.when(F.col("kind") == "Fixes", "Derived").otherwise("Asserted"))
    caller = visibility.Caller("u", "org")
    run = lambda q, n=5, day=3: [tuple(r) for r in search.search(frame, edges, q, n, caller, F.lit(T0 + timedelta(days=day))).collect()]
    assert run("timeout db") == [("a", 1.675), ("b", 1.3)]
    assert run("REDIS", day=8) == [("a", 1.575), ("b", 1.2)]
    assert run(" ") == [] and run("redis", 0) == [] and run("absent") == []
    with pytest.raises(ValueError):
        search.bounded(frame, 1)


def test_traversal_is_blocked_by_hidden_nodes(spark):
    frame = nodes(spark, [("a", None, None, "u", 3), ("b", None, None, "v", 0), ("c", None, None, "u", 3), ("d", None, None, "u", 3), ("e", None, None, "u", 3)])
    edges = links(spark, [("a", "b", "Uses"), ("b", "c", "Uses"), ("d", "a", "Uses"), ("d", "e", "Uses"), ("e", "a", "Uses")])
    caller = visibility.Caller("u", "org")
    walk = lambda **k: {tuple(r) for r in graph.traverse(frame, edges, "a", caller, **k).collect()}
    assert walk(max_depth=4) == {("d", 1), ("e", 1)}
    assert walk(max_depth=4, direction="out") == set() and walk(max_depth=0) == set()
    assert walk(max_depth=2, max_nodes=1) == {("d", 1)}


def test_rules_take_one_step(spark):
    edges = links(spark, [("a", "b", "DependsOn"), ("b", "a", "DependsOn"), ("b", "c", "DependsOn"), ("x", "p", "Solves"), ("y", "p", "Solves"), ("f", "p", "Fixes")])
    pairs = lambda f: {(r.from_id, r.to_id) for r in f.collect()}
    assert pairs(rules.composed(edges, "DependsOn", "DependsOn")) == {("a", "a"), ("b", "b"), ("a", "c")}
    assert pairs(rules.shared_target(edges, "Solves")) == {("x", "y"), ("y", "x")}
    types = spark.createDataFrame([("f", "Fix"), ("x", "Task")], "memory_id string, memory_type string")
    assert pairs(rules.implied_solves(edges, types)) == {("f", "p")}
    tags = spark.createDataFrame([(f"m{i}", "hot") for i in range(300)] + [("m1", "rare"), ("m2", "rare")], "memory_id string, attribute string")
    assert {tuple(r) for r in rules.shared_attribute(tags).collect()} == {("m1", "m2", 1), ("m2", "m1", 1)}
    both = rules.written("R7", rules.shared_attribute(tags)).unionByName(rules.written("R9", rules.shared_attribute(tags)))
    assert both.select("rel_id").distinct().count() == 4


def test_coding_rate_of_a_known_matrix(spark):
    frame = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 0.0])], "label string, embedding array<double>")
    rates = {r.label: (r.n, r.rate) for r in vectors.coding_rates(frame).collect()}
    assert rates["a"] == (2, round(0.5 * math.log(25), 6)) and rates["b"] == (1, round(0.5 * math.log(9), 6))
    whole = np.linalg.slogdet(np.eye(2) + 2 / (3 * 0.25) * np.diag([2.0, 1.0]))[1] / 2
    assert rates["*"] == (3, round(whole, 6))
    row = vectors.rate_reduction(vectors.coding_rates(frame)).first()
    assert row.delta == pytest.approx(whole - (2 * rates["a"][1] + rates["b"][1]) / 3, abs=1e-5)


def test_merges_are_resolved_in_order():
    got = consolidation.resolved_merges([("a", "b", 0.99), ("b", "c", 0.98), ("a", "d", 0.95), ("e", "a", 0.93), ("x", "y", 0.5)])
    assert got == {"b": "a", "d": "a", "a": "e"}


def test_rewiring_drops_loops_and_open_copies(spark):
    frame = nodes(spark, [("a", None, None, "u", 3), ("b", None, None, "u", 3), ("c", None, None, "u", 3)]).withColumn("valid_until", F.lit(None).cast("timestamp")).withColumn("invalidated_by", F.lit(None).cast("string"))
    edges = links(spark, [("b", "c", "Uses"), ("a", "b", "Uses"), ("c", "a", "Uses")])
    for c in ("valid_until", "valid_from", "recorded_at"):
        edges = edges.withColumn(c, F.lit(None).cast("timestamp") if c == "valid_until" else F.lit(T0))
    closed, moved = consolidation.merged(frame, edges, spark.createDataFrame([("b", "a")], "loser string, survivor string"), F.lit(T0 + timedelta(days=1)))
    assert [(r.memory_id, r.invalidated_by) for r in closed.collect()] == [("b", "a")]
    assert sorted((r.from_id, r.to_id, r.valid_until is None) for r in moved.collect()) == [("a", "b", False), ("a", "c", True), ("b", "c", False)]


def cycle_store(spark, path, near):
    """Three groups of three rows around a direction each; ``near`` is how far they are apart."""
    rows = []
    for g in range(3):
        for k in range(3):
            v = [0.0] * 12
            v[g], v[3 + 3 * g + k] = 1.0, near
            rows.append((f"m{g}{k}", 1, "Fix", f"c{g}", f"t{g}{k}", 3, "u", "p", "t", "o", "Asserted", T0, T0, None, None, v))
    schema = "memory_id string, version_lsn long, memory_type string, class string, title string, visibility int, user_id string, project string, team string, org string, provenance string, recorded_at timestamp, valid_from timestamp, valid_until timestamp, invalidated_by string, embedding array<double>"
    edges = [(f"r{i}", 1, a, b, "Uses", "Asserted", 0.5, 0.5, 1, None, T0, T0, None, None) for i, (a, b) in enumerate([("m00", "m10"), ("m01", "m20"), ("m02", "m00")])]
    kinds = "rel_id string, version_lsn long, from_id string, to_id string, kind string, provenance string, strength double, confidence double, evidence_count int, success_rate double, valid_from timestamp, recorded_at timestamp, valid_until timestamp, invalidated_by string"
    store = Store(spark, str(path))
    store.commit({"memories": spark.createDataFrame(rows, schema), "edges": spark.createDataFrame(edges, kinds)})
    return store


def test_a_cycle_is_committed_as_a_whole(spark, tmp_path):
    store, at = cycle_store(spark, tmp_path, 0.05), F.lit(T0 + timedelta(days=1))
    row = consolidation.cycle(store, at, tolerance=10.0, group="class")
    assert (row["anchors"], row["merged"], row["regression"], row["rolled_back"], row["hairball_regression"]) == (9, 6, False, False, False)
    rows = {r.memory_id: r for r in temporal.latest(store.read("memories"), "memory_id").collect()}
    assert sorted(i for i, r in rows.items() if r.valid_until is None) == ["m00", "m10", "m20"] and {r.invalidated_by for i, r in rows.items() if i[1] == "0" and i != "m00"} == {"m00"}
    assert sorted(r.version_lsn for r in store.read("memories").collect()) == [1] * 9 + list(range(2, 8))
    open_edges = {(r.from_id, r.to_id) for r in temporal.latest(store.read("edges"), "rel_id").collect() if r.valid_until is None}
    assert open_edges == {("m00", "m10"), ("m00", "m20")}  # m02 to m00 would be a loop
    assert {(r.rel_id, r.evidence_count) for r in store.read("edges").collect() if r.evidence_count == 2} == {("r0", 2)}
    assert store.read("similar").count() == 0 and store.read("audit").count() == 1 and store.version() == 2
    again = consolidation.cycle(store, at, tolerance=10.0, group="class")
    assert (again["anchors"], again["merged"]) == (3, 0)


def test_a_regression_is_undone_and_audited(spark, tmp_path):
    store, at = cycle_store(spark, tmp_path, 0.05), F.lit(T0 + timedelta(days=1))
    before = store.manifest()["tables"]
    row = consolidation.cycle(store, at, tolerance=-1e6, group="class")
    assert row["merged"] == 6 and row["regression"] and row["rolled_back"]
    after = store.manifest()["tables"]
    assert {t: after[t] for t in before} == before and set(after) == {*before, "audit"}
    assert store.read("memories").where("valid_until IS NOT NULL").count() == 0 and store.read("audit").first().rolled_back
    kept = consolidation.cycle(store, at, tolerance=-1e6, rollback=False, group="class")
    assert kept["regression"] and not kept["rolled_back"] and store.read("memories").where("valid_until IS NOT NULL").count() == 6


def test_a_cycle_of_too_few_rows_changes_nothing(spark, tmp_path):
    store = cycle_store(spark, tmp_path, 0.05)
    store.commit({"memories": store.read("memories").where("memory_id = 'm00'")})
    row = consolidation.cycle(store, F.lit(T0 + timedelta(days=1)), group="class")
    assert (row["anchors"], row["merged"], row["delta_before"], row["regression"]) == (1, 0, None, False)
    assert set(store.manifest()["tables"]) == {"memories", "edges", "audit"}


def test_survivors_that_are_alike_are_linked(spark, tmp_path):
    store = cycle_store(spark, tmp_path, 0.35)  # a cosine of 0.89
    row = consolidation.cycle(store, F.lit(T0 + timedelta(days=1)), tolerance=10.0, group="class")
    assert (row["merged"], row["similar"]) == (0, 9)
    assert {(r.a, r.b) for r in store.read("similar").where("a < 'm1'").collect()} == {("m00", "m01"), ("m00", "m02"), ("m01", "m02")}


def test_coding_rates_of_the_sample_vectors(spark):
    """agg_07, agg_08 and agg_09 against numpy on whole tables."""
    import duckdb

    from loomgraph.plans import catalog

    rows = duckdb.sql("SELECT label, embedding FROM '/root/testdata/sf0.01/embeddings.parquet' WHERE embedding IS NOT NULL").fetchall()
    x, labels = np.array([v for _, v in rows], float), np.array([g for g, _ in rows])

    def rate(m):
        return np.linalg.slogdet(np.eye(m.shape[1]) + m.shape[1] / (len(m) * 0.25) * m.T @ m)[1] / 2

    whole = rate(x)
    compact = sum((labels == g).sum() * rate(x[labels == g]) for g in set(labels.tolist())) / len(x)
    got = catalog.queries()["agg_08"](spark, "/root/testdata/sf0.01").first().asDict()
    for name, value in (("total", whole), ("compact", compact), ("delta", whole - compact)):
        if name in got:
            assert got[name] == pytest.approx(value, abs=1e-4)
    rates = {str(r.label): r.rate for r in catalog.queries()["agg_07"](spark, "/root/testdata/sf0.01").collect()}
    assert rates and all(rates[k] == pytest.approx(rate(x[labels == int(k)]) if k != "*" else whole, abs=1e-4) for k in rates)
    assert catalog.queries()["agg_09"](spark, "/root/testdata/sf0.01").first().consolidate == (whole - compact < 0 or compact / whole > 0.98)


def test_scalars(spark):
    v = lambda c: value(spark, c)
    assert v(scalars.effective_strength(F.lit(0.5), F.lit(5), F.lit(1.0), F.lit(10))) == pytest.approx((0.5 + 0.1) * 0.9)
    assert v(scalars.effective_strength(F.lit(0.9), F.lit(100), F.lit(None).cast("double"), F.lit(0))) == 1.0
    assert v(scalars.derived_confidence(F.lit(True), F.lit(3), F.lit(0))) == 0.1
    assert v(scalars.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert v(scalars.without_legal_forms(F.lit("Acme Corp. GmbH s.a."))) == "acme s.a"
    assert v(scalars.token_jaccard(F.lit("(Acme) corp"), F.lit("corp acme!"))) == 1.0 and v(scalars.token_jaccard(F.lit(" "), F.lit("x"))) == 0.0
    assert v(scalars.blocking_keys(F.lit("Acme Inc"), F.create_map(F.lit("city"), F.lit("New York")))) == ["a:city:New", "a:city:York", "p:acm", "t:acme"]
    assert v(scalars.percent_decoded(F.lit("a+b%20c%2B"))) == "a+b c+"
    assert v(scalars.normalized_tags(F.array(F.lit(" A"), F.lit("a"), F.lit(" "), F.lit("b")))) == ["a", "b"]
    assert v(scalars.derived_id("d", F.lit("ab"), F.lit("c"))) != v(scalars.derived_id("d", F.lit("a"), F.lit("bc")))
    assert v(scalars.session_key(F.lit("session://x-1"))) == "x-1" and v(scalars.session_key(F.lit("http://x"))) == ""
    assert v(scalars.age_days(F.lit(T0), F.lit(T0 - timedelta(days=2)))) == 0


def test_signatures_and_tag_hashes(spark):
    import hashlib
    import hmac

    texts = ["", "a", "héllo wörld", "x" * 300, None, "foobar"]
    for key in (b"k", bytes(range(64)), b"long" * 40):
        frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.hmac_sha256(key, F.col("t")).alias("s"))
        for r in frame.select("t", "s", scalars.verified(key, F.col("t"), F.col("s")).alias("good"), scalars.verified(b"other", F.col("t"), F.col("s")).alias("bad"), scalars.verified(key, F.col("t"), F.lit("")).alias("none")).collect():
            assert r.s == (None if r.t is None else hmac.new(key, r.t.encode(), hashlib.sha256).hexdigest())
            assert (r.good, r.bad, r.none) == (r.t is not None, False, False)

    def plain(text):
        h = 14695981039346656037
        for b in text.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        return h

    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.fnv1a(F.col("t")).alias("h")).collect():
        assert r.h == (None if r.t is None else plain(r.t))


def test_strings():
    assert resolution.jaro_similarity("martha", "marhta") == pytest.approx(0.944444, abs=1e-6)
    assert resolution.winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert resolution.jaro_similarity("", "") == 1.0 and resolution.jaro_similarity("a", "") == 0.0


def test_transpositions_are_whole_pairs_as_in_sql():
    import random

    import duckdb

    assert resolution.jaro_similarity("Supplier#000000204", "SUPPLIER#000000042") == pytest.approx((1 + 1 + 17 / 18) / 3)
    g = random.Random(8)
    pairs = [tuple("".join(g.choice("abAB01#") for _ in range(g.randint(0, 14))) for _ in "xy") for _ in range(3000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pairs (x VARCHAR, y VARCHAR)")
    con.executemany("INSERT INTO pairs VALUES (?, ?)", pairs)
    for x, y, jaro, jw in con.execute("SELECT x, y, jaro_similarity(lower(x), lower(y)), jaro_winkler_similarity(lower(x), lower(y)) FROM pairs WHERE x <> '' AND y <> ''").fetchall():
        assert resolution.jaro_similarity(x, y) == pytest.approx(jaro, abs=1e-9), (x, y)
        assert resolution.winkler(x, y) == pytest.approx(jw, abs=1e-9), (x, y)


CORPUS = [("1", "Acme Corp", {"city": "Berlin"}), ("2", "ACME corporation", {"city": "Berlin"}), ("3", "Zenith Ltd", {"city": "Paris"}), ("4", "Zenith", {"city": "Paris"}), ("5", "Omega", {})]
PAIRS = [("1", "2", "match"), ("3", "4", "match"), ("1", "3", "non_match"), ("2", "4", "non_match"), ("1", "5", "non_match")]


def test_resolution_from_labels_to_decisions(spark):
    corpus = spark.createDataFrame(CORPUS, "id string, name string, attributes map<string,string>")
    labelled = resolution.compared(spark.createDataFrame(PAIRS, "a string, b string, label string"), corpus, ["city"])
    slots = {(r.a, r.b): r.slots for r in labelled.collect()}
    assert slots[("1", "2")] == {"name": "Exact", "name_tokens": "Exact", "attr:city": "Exact"}
    assert slots[("1", "5")]["attr:city"] == "Missing"
    model = resolution.estimate(labelled)
    assert model.weights[("name", "Exact")] == pytest.approx(math.log((3 / 6) / (1 / 7))) and model.accept > model.review
    found = {tuple(r) for r in resolution.candidates(corpus).collect()}
    assert {("1", "2"), ("3", "4")} <= found and ("1", "3") not in found
    scores = resolution.scored(labelled, resolution.probabilities(labelled))
    decided = scores.withColumn("decision", resolution.decision(F.col("score"), F.lit(model.accept), F.lit(model.review)))
    row = resolution.evaluated(decided).first()
    assert (row.tp, row.fp, row.fn, row.f1) == (2, 0, 0, 1.0)
    with pytest.raises(ValueError):
        resolution.estimate(labelled.where("label = 'match'"))


def test_frequent_attributes_give_all_pairs_if_none_is_dropped(spark):
    import random

    g = random.Random(3)
    own = {f"m{i:03d}": {"all", *g.sample("abcdefgh", g.randint(0, 3))} for i in range(300)} | {"n1": {"a", "z"}, "n2": {"z"}, "n3": {"q"}}
    facts = spark.createDataFrame([(m, t) for m, tags in own.items() for t in [*sorted(tags), min(tags)]] + [("n3", None), ("n2", None)], "memory_id string, attribute string")
    expected = sorted((a, b, len(own[a] & own[b])) for a in own for b in own if a != b and own[a] & own[b])
    for block_rows in (1024, 50):
        assert sorted(tuple(r) for r in rules.shared_attribute(facts, None, block_rows).collect()) == expected
    assert rules.shared_attribute(facts).count() < len(expected)  # the engine's rule drops "all"


def test_partners_are_counted_without_forming_pairs(spark):
    import random

    from loomgraph.functions.scalars import blocking_keys

    g = random.Random(5)
    names = [" ".join(g.choice(["Acme", "Bolt", "Cord", "Dyne", "Echo"]) + g.choice(["", "x", "y"]) for _ in range(g.randint(1, 4))) for _ in range(120)]
    corpus = spark.createDataFrame([(f"r{i % 110}", n, {"city": g.choice(["Rome", "Oslo"])} if i % 3 else None) for i, n in enumerate(names)], "id string, name string, attributes map<string,string>")
    keys = {}
    for r in corpus.select("id", blocking_keys(F.col("name"), F.col("attributes")).alias("k")).collect():
        keys.setdefault(r.id, set()).update(r.k)
    later = {a: [b for b in keys if b > a and keys[a] & keys[b]] for a in keys}
    expected = sorted((a, len(b), min(b), max(b)) for a, b in later.items() if b)
    for most in (8, 3, 1):  # by sets of keys, mixed, and by pairs
        assert sorted(tuple(r) for r in resolution.partners(corpus, most).collect()) == expected

    n = 60_000  # one hot key: 1.8 billion pairs
    hot = spark.range(n).select(F.format_string("r%06d", "id").alias("id"), F.concat(F.lit("supplier"), "id").alias("name"), F.lit(None).cast("map<string,string>").alias("attributes"))
    row = resolution.partners(hot).agg(F.sum("partners").alias("pairs"), F.max("partners").alias("most"), F.min("last").alias("last")).first()
    assert (row.pairs, row.most, row["last"]) == (n * (n - 1) // 2, n - 1, f"r{n - 1:06d}")


def test_candidates_and_vector_pairs_equal_brute_force_in_blocks(spark):
    import random
    from itertools import combinations

    import numpy as np

    from loomgraph.functions.scalars import blocking_keys
    from loomgraph.operators import vectors

    g = random.Random(2)
    names = [" ".join(g.choice(["Acme", "Bolt", "Cord", "Dyne", "Echo"]) + g.choice(["", "x", "y"]) for _ in range(g.randint(1, 3))) for _ in range(90)]
    corpus = spark.createDataFrame([(f"r{i % 85}", n, {"city": g.choice(["Rome", "Oslo"])} if i % 3 else None) for i, n in enumerate(names)], "id string, name string, attributes map<string,string>")
    keys = {}
    for r in corpus.select("id", blocking_keys(F.col("name"), F.col("attributes")).alias("k")).collect():
        keys.setdefault(r.id, set()).update(r.k)
    got = [tuple(r) for r in resolution.candidates(corpus, block_rows=7).collect()]
    assert sorted(got) == sorted((a, b) for a, b in combinations(sorted(keys), 2) if keys[a] & keys[b])

    n = np.random.default_rng(4)
    rows = [(i, i % 3 if i % 11 else None, n.normal(size=4 if i % 5 else 3).round(3).tolist() if i % 13 else None) for i in range(120)]
    rows[7], rows[8] = (7, 1, [0.0] * 4), (8, 2, [1.0, None, 2.0, 3.0])
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")

    def cosine(x, y):
        if x is None or y is None or None in x or None in y:
            return None
        x, y = (np.array(v[: min(len(x), len(y))]) for v in (x, y))
        norm = np.sqrt(x @ x) * np.sqrt(y @ y)
        return 0.0 if norm == 0 else float(x @ y / norm)

    every = {(a[0], b[0]): cosine(a[2], b[2]) for a, b in combinations(rows, 2) if a[1] is not None and a[1] == b[1]}
    want = {(*k, round(v, 6) + 0.0) for k, v in every.items() if v is not None and v >= 0.2}
    found = vectors.similar_pairs(frame, 0.2, block_rows=9)
    assert {(r.a, r.b, r.score) for r in found.collect()} == want and found.count() == len(want)
    best = sorted(want, key=lambda r: (-r[2], r[0], r[1]))[:10]
    top = vectors.similar_pairs(frame, 0.2, most=10, block_rows=9).orderBy(F.desc("score"), "a", "b").limit(10)
    assert [(r.a, r.b, r.score) for r in top.collect()] == best
    prior = vectors.best_prior(frame.where("vec_id >= 90"), frame.where("vec_id < 90"), 0.1, 0.9, block_rows=9)
    expected = {}
    for (a, b), v in every.items():
        if a < 90 <= b and v is not None and 0.1 <= round(v, 6) < 0.9:
            expected[b] = min(expected.get(b, (9, 9)), (-round(v, 6), a))
    assert {r.new: (-r.score, r.prior) for r in prior.collect()} == expected


def test_vocabulary_and_verdicts(spark):
    assert len(KINDS) == 49 and ("Fix", "Fixes", "Problem") in triples() and (None, "RelatedTo", None) in triples()
    rows = [("ok", "Fixes", "Fix", "Error", 0.5), ("kind", "Likes", "Fix", "Error", 0.5), ("computed", "SimilarTo", "Fix", "Error", 0.5), ("triple", "Fixes", "Task", "Error", 0.5), ("end", "Fixes", "Fix", None, 0.5), ("nan", "Fixes", "Fix", "Error", float("nan")), ("range", "Fixes", "Fix", "Error", 1.5)]
    edges = spark.createDataFrame([(*r, 0.5) for r in rows], "rel_id string, kind string, from_type string, to_type string, strength double, confidence double")
    got = {r.rel_id: r.reject_code for r in ingest.edge_verdicts(edges, kinds_table(spark), triples_table(spark)).collect()}
    assert got == {"ok": None, "kind": "UNKNOWN_KIND", "computed": "COMPUTED_KIND_REJECTED", "triple": "INVALID_TYPE_TRIPLE", "end": "MISSING_EXTERNAL_KEY", "nan": "UNKNOWN", "range": "UNKNOWN"}
    stages = spark.createDataFrame([("b1", "memories", None), ("b1", "edges", "UNKNOWN"), ("b2", "memories", "UNKNOWN"), ("b2", "edges", "UNKNOWN"), ("b3", "memories", None)], "batch_id string, stage string, reject_code string")
    assert {r.batch_id: (r.accepted, r.stage) for r in ingest.batch_verdicts(stages, ["memories", "edges"]).collect()} == {"b1": (False, "edges"), "b2": (False, "memories"), "b3": (True, None)}


def test_entities_of_every_type(spark):
    text = "see src/a.rs and run_it() fn go struct Foo ParseError use redis Big Idea @some_one my-own-service cargo test pkg@1.2 http://x.y/z., MAX_SIZE"
    frame = spark.createDataFrame([(1, text)], "id long, text string")
    found = {(r.entity_type, r.name) for r in ingest.entities(frame, F.col("text"), "id").collect()}
    assert {("File", "src/a.rs"), ("Function", "run_it"), ("Function", "go"), ("Class", "Foo"), ("Error", "ParseError"), ("Technology", "redis"), ("Concept", "big idea"), ("Person", "@some_one"), ("Project", "my-own-service"), ("Command", "cargo test"), ("Package", "pkg@1.2"), ("Url", "http://x.y/z"), ("Variable", "MAX_SIZE")} <= found


def test_inverses_are_added_once(spark):
    edges = spark.createDataFrame([("r1", "a", "b", "Fixes", False), ("r2", "a", "b", "SimilarTo", False), ("r3", "a", "c", "Fixes", True)], "rel_id string, from_id string, to_id string, kind string, bidirectional boolean")
    got = sorted((r.from_id, r.kind, r.to_id) for r in ingest.inverses(edges, kinds_table(spark)).collect())
    assert got == [("a", "Fixes", "b"), ("a", "Fixes", "c"), ("a", "SimilarTo", "b"), ("b", "FixedBy", "a")]


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert {r.component for r in graph.components(edges, "a", "b").collect()} == {0}


def test_shared_folder_is_kept(spark):
    assert shared_folder(spark) == shared_folder(spark)
