import dataclasses
import json
import math

import pytest

from arterial.operators import contract, network, topology
from arterial.operators.components import components, connectivity
from arterial.schema import TEST_BOX
from arterial.sources import graphs
from arterial.sources.settings import load_config, start_up_errors, thresholds

DUMBBELL = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)]
PLACES = {1: (0, 0), 2: (0, 1), 3: (1, 1), 4: (2, 1), 5: (3, 1), 6: (3, 0)}


def graph(spark, pairs, weight=1.0, places=None, extra=()):
    ids = sorted({x for p in pairs for x in p[:2]} | set(extra))
    nodes = [{"id": i, "lat": float((places or {}).get(i, (0, i))[0]), "lon": float((places or {}).get(i, (0, i))[1])} for i in ids]
    at = {n["id"]: [n["lat"], n["lon"]] for n in nodes}
    edges = [{"source": p[0], "target": p[1], "weight_m": p[2] if len(p) > 2 else weight, "geometry": [at[p[0]], at[p[1]]]} for p in pairs]
    return graphs.frames_of(spark, {"crs": "EPSG:4326", "nodes": nodes, "edges": edges})


def crit(g):
    return {r.id: r.crit for r in network.node_criticality(g[0], network.edge_betweenness(*g)).collect()}


@pytest.mark.parametrize(
    ("pairs", "efficiency", "critical"),
    [([(1, 2), (2, 3)], 0.8333333, {1: 0.5, 2: 1.0, 3: 0.5}), ([(1, 2), (1, 3), (1, 4)], 0.75, {1: 1.0, 2: 1 / 3, 3: 1 / 3, 4: 1 / 3}), ([(1, 2), (2, 3), (3, 4)], 0.722222, {1: 3 / 7, 2: 1, 3: 1, 4: 3 / 7}), (DUMBBELL, 0.688889, {3: 1.0, 4: 1.0, 1: 0.294118, 2: 0.294118, 5: 0.294118, 6: 0.294118})],
)
def test_small_graphs(spark, pairs, efficiency, critical):
    g = graph(spark, pairs)
    assert network.global_efficiency(*g).first()[0] == pytest.approx(efficiency, abs=1e-6)
    assert crit(g) == pytest.approx(critical, abs=1e-5)


def test_complete_graph_has_equal_betweenness(spark):
    g = graph(spark, [(i, j) for i in range(10) for j in range(i)])
    assert {round(r.ebc, 9) for r in network.edge_betweenness(*g).collect()} == {round(2 / 90, 9)}


def test_dumbbell_what_if(spark):
    g = graph(spark, DUMBBELL, places=PLACES)
    scores = network.node_criticality(g[0], network.edge_betweenness(*g))
    assert network.choke_points(scores, 1).first().id == 3
    end = network.ablation(*g, scores).collect()
    assert [(r.step, r.removed_node) for r in end] == [(1, 3)] and end[0].penalty == pytest.approx(0.722222, abs=1e-6)
    out = {r.scenario_id: r for r in network.impacts(*g, g[0].selectExpr("id scenario_id", "id")).collect()}
    assert {i: round(r.survival_all_pairs * 15) for i, r in out.items()} == {1: 10, 2: 10, 3: 4, 4: 4, 5: 10, 6: 10}
    assert all(r.stretch == 0 for r in out.values())


def test_closing_the_hub_of_a_star(spark):
    g = graph(spark, [(1, 2), (1, 3), (1, 4)])
    row = next(r for r in network.leave_one_out(*g).collect() if r.id == 1)
    assert row.efficiency == 0 and row.penalty is None and row["index"] == 0


def test_relaxation_equals_the_kernel(spark):
    g = graph(spark, [(1, 2, 3.0), (2, 3, 4.0), (1, 3, 9.0), (4, 5, 1.0), (6, 6, 2.0)])
    rows = lambda df: sorted((r.src, r.dst, r.d) for r in df.collect())
    assert rows(network.distances(*g)) == rows(network.relaxed_distances(g[1], g[0]))


@pytest.mark.parametrize("finish", [2_000_000, 1])
def test_components(spark, finish):
    nodes, edges = graph(spark, [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)], extra=(500,))
    found = {r.id: r.component for r in components(nodes, edges, finish=finish).collect()}
    assert found == {i: 0 if i <= 40 else 100 if i < 200 else 500 for i in found} and len(found) == 41 + 30 + 1
    row = connectivity(nodes, edges).first()
    assert (row.n_components, row.n_isolated, row.sizes) == (3, 1, [41, 30, 1])


def test_degrees_of_loops_and_parallel_edges(spark):
    nodes, edges = graph(spark, [(1, 1), (1, 2), (2, 1), (2, 3)], extra=(9,))
    assert {r.id: r.degree for r in network.degrees(nodes, edges).collect()} == {1: 3, 2: 2, 3: 1, 9: 0}


def test_gaps_are_found_and_bridged(spark):
    places = {1: (12.92, 77.62), 2: (12.9201, 77.62), 3: (12.92028, 77.62), 4: (12.9204, 77.62)}
    g = graph(spark, [(1, 2, 11.0), (3, 4, 13.0)], places=places)
    pairs = topology.breaks(*g, 25.0)
    assert [(r.id_a, r.id_b) for r in pairs.collect()] == [(1, 2), (3, 4), (2, 3)]
    for heal in (topology.heal_straight, topology.heal_curved):
        healed = heal(*g, pairs)
        assert {(r.source, r.target) for r in healed.collect()} == {(1, 2), (3, 4), (2, 3)}
        assert connectivity(g[0], healed).first().n_components == 1


def test_stubs_are_pruned_round_by_round(spark):
    ring = [(1, 2, 50.0), (2, 3, 50.0), (3, 4, 50.0), (4, 1, 50.0)]
    nodes, edges = topology.prune_stubs(*graph(spark, [*ring, (1, 5, 5.0), (5, 6, 5.0), (2, 7, 100.0)]))
    assert {r.id for r in nodes.collect()} == {1, 2, 3, 4, 7} and edges.count() == 5


def test_chains_are_contracted(spark):
    pairs = [(1, 2, 1.0), (2, 3, 2.0), (3, 4, 4.0), (1, 5, 8.0), (1, 6, 16.0), (4, 7, 1.0), (4, 8, 1.0), (20, 21, 1.0), (21, 22, 1.0), (22, 20, 1.0)]
    nodes, edges = topology.contract_chains(*graph(spark, pairs))
    found = {(r.source, r.target): (r.weight_m, len(r.geometry)) for r in edges.collect()}
    assert found[1, 4] == (7.0, 4) and {(20, 21), (21, 22), (20, 22)} <= set(found) and len(found) == 8
    assert {r.id for r in nodes.collect()} == {1, 4, 5, 6, 7, 8, 20, 21, 22}


def test_audit_replaces_wrong_weights(spark):
    sample = {"nodes": [{"id": 1, "lat": 12.927, "lon": 77.615}, {"id": 2, "lat": 12.928, "lon": 77.617}], "edges": [{"source": 1, "target": 2, "weight_m": 250.0, "geometry": [[12.927, 77.615], [12.928, 77.617]]}, {"source": 1, "target": 2, "weight_m": 243.0, "geometry": [[12.927, 77.615], [12.928, 77.617]]}]}
    rows = topology.audit_weights(graphs.frames_of(spark, sample)[1]).orderBy("edge_idx").collect()
    assert [(r.corrected, round(r.weight_m, 4)) for r in rows] == [(True, 243.6108), (False, 243.0)]


def test_contracts(spark, tmp_path):
    good = {"crs": "EPSG:4326", "nodes": [{"id": 1, "lat": 12.92, "lon": 77.62}, {"id": 2, "lat": 12.93, "lon": 77.63}], "edges": [{"source": 1, "target": 2, "weight_m": 5.0, "geometry": [[12.92, 77.62], [12.93, 77.63]]}]}
    assert contract.document_violations({k: v for k, v in good.items() if k != "edges"}) == ["Missing top-level key: 'edges'"]
    assert "CRS must be" in contract.document_violations(good | {"crs": "EPSG:3857"})[0]
    assert "must be of type int" in contract.document_violations(good | {"nodes": [{"id": "abc", "lat": 0, "lon": 0}]})[0]
    assert contract.document_violations(good | {"more": 1}) == [] and contract.document_violations(good | {"more": 1}, strict=True)
    path = tmp_path / "g.json"
    assert contract.check_file(spark, str(path))["status"] == "FILE_NOT_FOUND"
    path.write_text("{")
    assert contract.check_file(spark, str(path))["status"] == "JSON_ERROR"
    path.write_text(json.dumps(good))
    assert contract.check_file(spark, str(path))["status"] == "PASS"
    nodes, edges = graphs.read_graphs(spark, str(path))
    assert nodes.count() == 2 and edges.first().weight_m == 5.0
    graphs.write_graph(nodes, edges.drop("road_type"), str(tmp_path / "out"))
    again = graphs.read_graphs(spark, str(tmp_path / "out"))
    assert [tuple(r)[1:] for r in again[0].orderBy("id").collect()] == [tuple(r)[1:] for r in nodes.orderBy("id").collect()]
    bad = good | {"nodes": good["nodes"] + [{"id": 2, "lat": 50.0, "lon": 0.0}], "edges": [{"source": 1, "target": 7, "weight_m": 0.0, "geometry": []}]}
    n, e = graphs.frames_of(spark, bad)
    assert {r.rule for r in contract.loose_violations(n, e).collect()} == {"node.duplicate", "edge.endpoint"}
    assert {r.rule for r in contract.strict_violations(n, e).collect()} == {"node.box", "edge.weight", "edge.geometry", "edge.endpoint"}
    with pytest.raises(contract.ContractError):
        contract.ensure(contract.loose_violations(n, e))


def test_grid_and_thresholds(spark):
    nodes, edges = graphs.grid_graph(spark)
    assert nodes.count() == 25 and edges.agg({"weight_m": "sum"}).first()[0] == pytest.approx(27376, abs=1)
    degree = network.degrees(nodes, edges).groupBy("degree").count().collect()
    assert {r.degree: r["count"] for r in degree} == {2: 4, 3: 12, 4: 9}
    meta = spark.createDataFrame([(6.0, "LISS-IV"), (10.0, "Sentinel-2"), (2.0, "drone"), (3.0, None)], "resolution_m double, source string")
    got = [(r.snap_m, r.second_snap_m, r.stub_m) for r in thresholds(meta).collect()]
    assert got == [(34.8, 60.9, 8.7), (30.0, 52.5, 15.0), (12.0, 21.0, 5.0), (18.0, 31.5, 5.0)]
    assert load_config()["collapse_threshold"] == 0.5
    assert math.isclose(TEST_BOX.max_lat - TEST_BOX.min_lat, 0.02, abs_tol=1e-9)


def test_start_up_errors(spark, tmp_path):
    (tmp_path / "there").write_text("x")
    assert start_up_errors(spark, load_config(), TEST_BOX, [str(tmp_path / "there")]) == []
    wrong = load_config() | {"collapse_threshold": 0.6, "graph_source": "elsewhere"}
    found = start_up_errors(spark, wrong, TEST_BOX._replace(min_lon=90.0) if hasattr(TEST_BOX, "_replace") else dataclasses.replace(TEST_BOX, min_lon=90.0), [str(tmp_path / "missing")])
    assert len(found) == 4


def test_graphml_round_trip(spark, tmp_path):
    nodes, edges = graph(spark, DUMBBELL, 2.5, PLACES)
    graphs.write_graphml(nodes, edges, str(tmp_path / "g"))
    n, e = graphs.read_graphml(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, nodes.select("id", "lat", "lon").collect()))
    assert sorted(map(str, e.collect())) == sorted(map(str, edges.select("source", "target", "weight_m", "geometry").collect()))


def test_street_statistics(spark):
    r = topology.street_statistics(*graph(spark, [(1, 2), (2, 3)], 150_000.0), area_km2=2.0).first()
    assert (r.n_intersections, r.per_km2, r.length_m) == (1, 0.5, 300_000.0) and r.circuity == pytest.approx(150_000 / 111_194.93, rel=1e-4)


def test_neighbours_of_many_nodes_at_one_place(spark):
    rows = [(i, 12.9, 77.6) for i in range(700)] + [(700, 12.9003, 77.6), (701, 12.9003, 77.6), (702, 12.95, 77.6)]
    nodes = spark.createDataFrame(rows, "id long, lat double, lon double")
    out = network.within_radius(nodes, 60.0)
    found = {(r.centre, r.id): r.dist_m for r in out.collect()}
    assert len(found) == out.count() == 702 * 701 and all(702 not in pair for pair in found)
    assert found[0, 1] == 0 and found[0, 700] == found[700, 0] == pytest.approx(33.36, abs=0.01)
    assert network.near_places(nodes, 60.0).count() < 20  # blocks of ids, not pairs
    assert out.rdd.getNumPartitions() >= 4  # dealt out, although small
    assert {(r.centre, r.id) for r in network.within_radius(nodes, 60.0, nodes.where("id = 700")).collect()} == {(700, i) for i in range(702) if i != 700}
