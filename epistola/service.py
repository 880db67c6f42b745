"""The engine over HTTP: the collection browser's queries and the pair search, on the standard library's server."""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession

from epistola.operators import browse
from epistola.sources import bundle

#: Characters of a value that a page shows.
SHOWN = 300


def shown(value: object) -> str:
    """A field's value for the page: escaped, long ones cut, null and nested ones as JSON."""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)
    return html.escape(text[:SHOWN] + ("…" if len(text) > SHOWN else ""))


class Service:
    """Answers by path. ``tables``: the collections by name, each with the column its pages are ordered by."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, tuple[DataFrame, str]], documents: DataFrame | None = None, store: bundle.FolderStore | None = None, get: Callable[[str], bytes] = bundle.http_get, delay_s: float = bundle.DELAY_S):
        self.spark, self.tables, self.documents, self.store, self.http_get, self.delay_s = spark, tables, documents, store, get, delay_s

    def collections(self) -> list[dict]:
        return [r.asDict() for r in browse.collections(self.spark, {n: t for n, (t, _) in self.tables.items()}).collect()]  # one row per collection

    def schema(self, collection: str) -> list[dict]:
        table, key = self.tables[collection]
        return [r.asDict() for r in browse.describe(table, key).collect()]  # one row per field

    def docs(self, collection: str, skip: int = 0, limit: int = 20) -> dict:
        table, key = self.tables[collection]
        rows = browse.page(table, key, max(0, skip), max(0, limit)).toJSON().collect()  # one page
        return {"docs": [json.loads(r) for r in rows], "total": table.count()}

    def fetch(self, body: dict) -> tuple[int, dict]:
        if not body.get("email1") or not body.get("email2"):
            return 400, {"success": False, "error": "two addresses are needed"}
        known = bundle.Request.__dataclass_fields__
        try:
            answer = bundle.fetch_bundle(self.documents, bundle.Request(**{k: v for k, v in body.items() if k in known and v is not None}), self.store, self.http_get, self.delay_s)
        except Exception as e:  # a store that fails must answer, not hang
            return 500, {"success": False, "error": str(e)}
        return 200, json.loads(answer.json())

    def page(self, collection: str | None, skip: int, limit: int) -> str:
        links = " ".join(f'<a href="/?collection={html.escape(c["name"])}">{html.escape(c["name"])}</a> ({c["count"]})' for c in self.collections())
        rows = ""
        if collection in self.tables:
            for d in self.docs(collection, skip, limit)["docs"]:
                rows += "<table>" + "".join(f"<tr><th>{html.escape(k)}</th><td>{shown(v)}</td></tr>" for k, v in d.items()) + "</table>"
            rows += f'<a href="/?collection={html.escape(collection)}&amp;skip={skip + limit}&amp;limit={limit}">next</a>'
        return f"<!doctype html><meta charset=utf-8><title>collections</title>{links}{rows}"

    def answer(self, method: str, target: str, body: bytes = b"") -> tuple[int, str, bytes]:
        """(status, content type, content) of a request."""
        url = urlsplit(target)
        asked = {k: v[-1] for k, v in parse_qs(url.query).items()}
        try:
            skip, limit, name = int(asked.get("skip", 0)), int(asked.get("limit", 20)), asked.get("collection")
            data = json.loads(body or b"{}") if method == "POST" else {}
        except ValueError:
            return 400, "application/json", b'{"error":"malformed request"}'
        status, out = 200, None
        if method == "POST" and url.path == "/api/fetch-correspondence" and self.documents is not None and self.store is not None:
            status, out = self.fetch(data if isinstance(data, dict) else {})
        elif method == "GET" and url.path == "/":
            return 200, "text/html; charset=utf-8", self.page(name, skip, limit).encode()
        elif method == "GET" and url.path == "/api/collections":
            out = self.collections()
        elif method == "GET" and url.path in ("/api/schema", "/api/docs") and name in self.tables:
            out = self.schema(name) if url.path == "/api/schema" else self.docs(name, skip, limit)
        else:
            status, out = 404, {"error": "not found"}
        return status, "application/json", json.dumps(out, ensure_ascii=False, default=str).encode()

    def serve(self, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
        """A server on that address, not yet running; ``serve_forever`` runs it."""
        service = self

        class Handler(BaseHTTPRequestHandler):
            def _reply(self) -> None:
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                status, kind, content = service.answer(self.command, self.path, body)
                self.send_response(status)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(content)))
                self.end_headers()
                self.wfile.write(content)

            do_GET = do_POST = _reply

            def log_message(self, *args) -> None:
                pass

        return ThreadingHTTPServer((host, port), Handler)
