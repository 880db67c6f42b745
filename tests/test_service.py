import json
import threading
import urllib.error
import urllib.request

from epistola.service import Service, shown
from epistola.sources import bundle

MAIL = "From: Ana Stone <ana.stone@d.org>\nTo: bo.hale@e.org\n<b>\n"


def service(spark, tmp_path, get=lambda url: b"%PDF"):
    docs = spark.createDataFrame([("h1", 2001, MAIL), ("h2", None, MAIL)], "hash_id string, year int, text string")
    return Service(spark, {"docs": (docs, "hash_id")}, docs, bundle.FolderStore(str(tmp_path)), get, 0)


def test_answers(spark, tmp_path):
    s = service(spark, tmp_path)
    ask = lambda *x: (lambda r: (r[0], json.loads(r[2])))(s.answer(*x))
    assert ask("GET", "/api/collections") == (200, [{"name": "docs", "count": 2}])
    assert ask("GET", "/api/schema?collection=docs")[1][0] == {"name": "hash_id", "type": "string"}
    assert ask("GET", "/api/docs?collection=docs&skip=1&limit=5") == (200, {"docs": [{"hash_id": "h2", "text": MAIL}], "total": 2})
    assert ask("GET", "/api/docs?collection=none")[0] == 404 and ask("GET", "/api/docs?skip=x")[0] == 400
    assert ask("POST", "/api/fetch-correspondence", b"{}")[0] == 400 and ask("POST", "/api/fetch-correspondence", b"{")[0] == 400
    asked = json.dumps({"email1": "ana.stone@d.org", "email2": "bo.hale@e.org"}).encode()
    assert ask("POST", "/api/fetch-correspondence", asked)[1]["doc_count"] == 2
    assert ask("POST", "/api/fetch-correspondence", asked)[1]["cached"] is True
    status, kind, page = s.answer("GET", "/?collection=docs")
    assert status == 200 and "html" in kind and b"&lt;b&gt;" in page and b"<b>" not in page
    assert shown(None) == "null" and shown("x" * 999).endswith("…") and shown(["<"]) == "[&quot;&lt;&quot;]"


def test_a_failing_store_answers(spark, tmp_path, monkeypatch):
    s = service(spark, tmp_path)
    monkeypatch.setattr(s.store, "put", lambda *a: 1 / 0)
    assert s.answer("POST", "/api/fetch-correspondence", json.dumps({"email1": "ana.stone@d.org", "email2": "bo.hale@e.org"}).encode())[0] == 500


def test_over_the_wire(spark, tmp_path):
    server = service(spark, tmp_path).serve(port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/api/collections", timeout=60) as r:
            assert json.load(r) == [{"name": "docs", "count": 2}]
        try:
            urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/nothing", timeout=60)
        except urllib.error.HTTPError as e:
            assert e.code == 404
    finally:
        server.shutdown()
