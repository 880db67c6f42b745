import json

from epistola.operators.network import build_network
from epistola.sources import bundle, graph
from epistola.streaming import network as stream

MAIL = "From: Ana Stone <ana.stone@d.org>\nTo: bo.hale@e.org\n"


def docs(spark):
    return spark.createDataFrame([("h1", 2001, MAIL), ("h2", 2002, MAIL)], "hash_id string, year int, text string")


def test_graph_round_trip(spark, tmp_path):
    nodes, edges = build_network(docs(spark))
    path = str(tmp_path / "g.json")
    graph.write_graph(nodes, edges, path, str(tmp_path / "tables"))
    graph.write_graph(nodes, edges, path)
    assert (tmp_path / "g.json.bak").exists()
    raw = json.loads((tmp_path / "g.json").read_text())
    assert raw["stats"] == {"nodes": 2, "edges": 1, "top_domains": [{"domain": "d.org", "count": 1}, {"domain": "e.org", "count": 1}]}
    n, e = graph.read_graph(spark, path)
    assert {r.id: r.name for r in n.collect()} == {"ana.stone@d.org": "Ana Stone", "bo.hale@e.org": "Bo Hale"}
    assert e.first().weight == 2 and e.first().doc_ids == ["h1", "h2"]


def test_versions_and_dictionary(spark, tmp_path):
    a = graph.write_version(docs(spark), str(tmp_path / "v"))
    b = graph.write_version(docs(spark), str(tmp_path / "v"))
    assert a != b and spark.read.parquet(b).count() == 2
    (tmp_path / "d.txt").write_text("the 100\nplan 5\n")
    assert {r.term: r["count"] for r in graph.read_dictionary(spark, str(tmp_path / "d.txt")).collect()} == {"the": 100, "plan": 5}


def test_bundle(spark, tmp_path):
    store = bundle.FolderStore(str(tmp_path))
    req = tmp_path / "r.json"
    req.write_text(json.dumps({"email1": "ana.stone@d.org", "email2": "bo.hale@e.org", "name1": "x", "other": 1}))
    ask = bundle.Request.read(str(req))

    def get(url):
        if "h2" in url:
            raise OSError
        return b"pdf"

    first = bundle.fetch_bundle(docs(spark), ask, store, get, 0)
    assert first.success and first.doc_count == 1 and first.cached is False
    assert bundle.fetch_bundle(docs(spark), ask, store, get, 0).cached is True
    assert not bundle.fetch_bundle(docs(spark), bundle.Request("", "x"), store).success
    assert not bundle.fetch_bundle(docs(spark), bundle.Request("no@d.org", "bo.hale@e.org"), store).success


def test_stream(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "docs"))
    q = stream.run_to_table(stream.node_stream(spark, str(tmp_path / "docs")), "test_nodes", str(tmp_path / "cp"))
    q.awaitTermination()
    assert {r.email: (r.sent, r.received) for r in spark.table("test_nodes").collect()} == {"ana.stone@d.org": (2, 0), "bo.hale@e.org": (0, 2)}
