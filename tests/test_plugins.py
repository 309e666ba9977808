"""Programs and services that are plugged in: a ranker process, an embedder over HTTP."""

import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lexforge.plans import ranker
from lexforge.plans.session import Session
from lexforge.sources import vectors

PROGRAM = """import json, sys
q = json.load(sys.stdin)
assert q["protocol_version"] == 1
regions = [{"path": "a.py", "start_line": 1 + n, "end_line": 2 + n, "score": 1.0 / (1 + n)} for n in range(150)]
page = regions[q["offset"] : q["offset"] + q["limit"]]
print(json.dumps({"protocol_version": 1, "backend": "t", "index_note": "", "has_more": q["offset"] + q["limit"] < 150, "results": page}))
"""


def test_ranker_process(spark, tmp_path):
    (tmp_path / "a.py").write_text("def widget():\n    return 1\n" + "x = 1\n" * 200)
    rank = ranker.process_ranker([sys.executable, "-c", PROGRAM], str(tmp_path))
    got = rank(spark.range(1), "widget", 500).orderBy(F.desc("score")).collect()
    assert len(got) == 150 and tuple(got[0]) == ("a.py", 1, 2, 1.0)
    assert rank(spark.range(1), "widget", 120).count() == 120
    s = Session(spark, str(tmp_path), ranker="semantic", semantic=rank)
    page = s.search_concept("widget thing", limit=2, fields=("excerpt",))
    assert [(r["start_line"], r.get("symbol"), r["excerpt"]) for r in page.results] == [(1, "widget", "def widget():\n    return 1"), (2, "widget", "    return 1\nx = 1")] and page.has_more
    assert "excerpt" not in s.search_concept("widget thing", limit=1).results[0]
    for bad in ("print('{}')", "raise SystemExit(3)", "print('x' * 2000000)", "print('{\"protocol_version\": 1, \"results\": [], \"has_more\": true}')"):
        with pytest.raises((ValueError, RuntimeError)):
            ranker.ask([sys.executable, "-c", bad], str(tmp_path), "q", 5, 0, 20)


class Service(BaseHTTPRequestHandler):
    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        found = [[float(len(t)), 1.0] for t in asked["input"]]
        body = json.dumps({"embeddings": found[1:] if asked["model"] == "short" else found}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_http_embedder(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    chunks = spark.createDataFrame([(str(n), "t" * n) for n in range(70)], "key string, text string")
    got = {r.key: r.embedding for r in vectors.embed(chunks, vectors.http_embedder(url, "m")).collect()}
    assert got == {str(n): [float(n), 1.0] for n in range(70)}
    with pytest.raises(ValueError):
        vectors.http_embedder(url, "short")(["a", "b"])
    with pytest.raises(ValueError):
        vectors.http_embedder(url, "m", most_bytes=3)(["a"])
    server.shutdown()
