"""The command lines, end to end on a small corpus."""

import json

import pytest

from epistola import cli, session

MAILS = [
    ("h1", 2001, "From: Ana Stone <ana.stone@d.org>\nTo: bo.hale@e.org\n\nTbe plan  is here.\n"),
    ("h2", 2002, "From: Ana Stone <anastone@d.org>\nTo: bo.hale@e.org\n\nOk.\n"),
    ("h3", 2003, None),
]


@pytest.fixture
def corpus(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(MAILS, "hash_id string, year int, text string").write.parquet(path)
    return path


def test_build_dedup_and_unmatched(spark, corpus, tmp_path, capsys):
    out = str(tmp_path / "g.json")
    cli.main(["build-network", corpus, "--output", out])
    built = json.loads((tmp_path / "g.json").read_text())
    assert {n["id"] for n in built["nodes"]} == {"ana.stone@d.org", "anastone@d.org", "bo.hale@e.org"}
    cli.main(["dedup", out, "--dry-run", "--report"])
    assert json.loads((tmp_path / "g.json").read_text()) == built
    cli.main(["dedup", out, "-o", str(tmp_path / "m.json")])
    merged = json.loads((tmp_path / "m.json").read_text())
    assert sorted(len(n["aliases"]) for n in merged["nodes"]) == [1, 2]
    assert sum(n["count"] for n in merged["nodes"]) == sum(n["count"] for n in built["nodes"])
    capsys.readouterr()
    cli.main(["unmatched", str(tmp_path / "m.json"), corpus])
    assert capsys.readouterr().out.strip() == ""


def test_rules_of_a_deployment(spark, corpus, tmp_path):
    cli.main(["build-network", corpus, "--output", str(tmp_path / "g.json")])
    (tmp_path / "rules.json").write_text(json.dumps({"domain_repairs": {"e.org": "d.org"}, "address_repairs": {"anastone@d.org": "ana.stone@d.org"}, "first_names": ["Bo"], "generic": []}))
    cli.main(["dedup", str(tmp_path / "g.json"), "-o", str(tmp_path / "m.json"), "--rules", str(tmp_path / "rules.json")])
    assert {n["domain"] for n in json.loads((tmp_path / "m.json").read_text())["nodes"]} == {"d.org"}
    (tmp_path / "bad.json").write_text('{"prices": {}}')
    with pytest.raises(ValueError):
        cli.rules.load(str(tmp_path / "bad.json"))


def test_clean_writes_a_new_version(spark, corpus, tmp_path, capsys):
    cli.main(["clean", corpus])
    cli.main(["clean", corpus, "--apply", str(tmp_path / "versions"), "--sample", "2"])
    assert str(tmp_path / "versions") in capsys.readouterr().out
    rows = {r.hash_id: r.text for r in spark.read.parquet(str(tmp_path / "versions" / "v0")).collect()}
    assert set(rows) == {"h1", "h2"} and "The plan is here." in rows["h1"]


def test_fetch(spark, corpus, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli.bundle.fetch_bundle, "__defaults__", (lambda url: b"%PDF", 0))
    (tmp_path / "r.json").write_text(json.dumps({"email1": "ana.stone@d.org", "email2": "bo.hale@e.org"}))
    cli.main(["fetch", str(tmp_path / "r.json"), corpus, "--store", str(tmp_path / "store")])
    assert json.loads(capsys.readouterr().out)["doc_count"] == 1


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: type("C", (), {"get": lambda s, k: None})()
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda s, k, d: d})()

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def test_scratch_drops_only_its_own_tables(spark):
    s = session.Scratch(spark, "test")
    a = s.save(spark.range(3))
    b = a.select("id")
    s.drop(b, None)
    assert b.count() == 3
    s.drop(a)
    with pytest.raises(Exception):
        spark.read.parquet(vars(a)["scratch_path"]).count()
