"""The end of a pair search, outside Catalyst: fetch the documents, zip them, store the bundle and hand out its address. Works on the few rows a search returns."""

from __future__ import annotations

import json
import os
import time
import urllib.request
import uuid
import zipfile
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

from epistola.operators.search import MAX_DOCS, bundle_key, correspondence

DELAY_S, TIMEOUT_S, URL_LIFE_S = 0.05, 30, 3600


@dataclass
class Request:
    email1: str
    email2: str
    aliases1: list[str] = field(default_factory=list)
    aliases2: list[str] = field(default_factory=list)
    name1: str = ""
    name2: str = ""

    @classmethod
    def read(cls, path: str) -> Request:
        known = cls.__dataclass_fields__
        return cls(**{k: v for k, v in json.loads(Path(path).read_text()).items() if k in known and v is not None})


@dataclass
class Answer:
    success: bool
    doc_count: int = 0
    download_url: str | None = None
    cached: bool | None = None
    error: str | None = None

    def json(self) -> str:
        return json.dumps(asdict(self))


class FolderStore:
    """Bundles in a folder; any object store with these three functions will do."""

    def __init__(self, root: str):
        self.root = Path(root)

    def exists(self, key: str) -> bool:
        return (self.root / key).exists()

    def put(self, key: str, path: str) -> None:
        target = self.root / key
        target.parent.mkdir(parents=True, exist_ok=True)
        os.replace(path, target)

    def url(self, key: str, life_s: int = URL_LIFE_S) -> str:
        return (self.root / key).resolve().as_uri()


def http_get(url: str) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "epistola"}), timeout=TIMEOUT_S) as r:
        return r.read()


def fetch_bundle(documents: DataFrame, request: Request, store: FolderStore, get: Callable[[str], bytes] = http_get, delay_s: float = DELAY_S) -> Answer:
    """Searches, and answers with a bundle's address. A bundle that exists is used again; documents that can't be had are skipped."""
    if not request.email1 or not request.email2:
        return Answer(False, error="two addresses are needed")
    rows = correspondence(documents, request.email1, request.email2, request.aliases1, request.aliases2, MAX_DOCS).collect()  # MAX_DOCS rows at most
    if not rows:
        return Answer(False, error="no documents found")
    key = bundle_key(request.email1, request.email2)
    if store.exists(key):
        return Answer(True, len(rows), store.url(key), True)
    tmp = str(store.root / f"{uuid.uuid4().hex}.part")  # requests at once don't meet
    store.root.mkdir(parents=True, exist_ok=True)
    got = 0
    with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
        for i, r in enumerate(rows):
            if i and delay_s:
                time.sleep(delay_s)
            try:
                z.writestr(f"{r.hash_id}.pdf", get(r.url))
                got += 1
            except OSError:
                continue
    if not got:
        os.remove(tmp)
        return Answer(False, len(rows), error="no document could be fetched")
    store.put(key, tmp)
    return Answer(True, got, store.url(key), False)
