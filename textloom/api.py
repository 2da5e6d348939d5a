"""The search request of the demo service as a function: JSON in, status and JSON out."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame

from textloom.operators.index import Index
from textloom.operators.search import search_one
from textloom.sources.wiki import enriched

#: Limits of a request (fixed values).
MAX_BODY, DEFAULT_LIMIT, MAX_LIMIT = 8_192, 5, 20


def search_api(index: Index, catalog: DataFrame, body: str | bytes) -> tuple[int, str]:
    """Answer {"query": ..., "limit": ...}: 400 for a bad request, 500 for a result without catalog row."""
    raw = body.encode() if isinstance(body, str) else body
    if len(raw) > MAX_BODY:
        return 400, json.dumps({"error": "the request is too large"})
    try:
        asked = json.loads(raw)
        query, limit = asked["query"], asked.get("limit", DEFAULT_LIMIT)
    except (ValueError, KeyError, TypeError, AttributeError):
        return 400, json.dumps({"error": "the request is malformed"})
    if not isinstance(query, str) or not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= MAX_LIMIT:
        return 400, json.dumps({"error": "the limit must lie between 1 and 20"})
    began = time.perf_counter()
    rows = enriched(search_one(index, query, limit), catalog).orderBy("rank").collect()
    if any(r.title is None for r in rows):
        return 500, json.dumps({"error": "a result has no catalog row"})
    results = [{"external_id": r.external_id, "score": r.score, "title": r.title, "preview": r.preview, "source_url": r.source_url} for r in rows]
    return 200, json.dumps({"results": results, "search_ms": (time.perf_counter() - began) * 1000})


def serve(index: Index, catalog: DataFrame, host: str = "127.0.0.1", port: int = 8080):
    """An HTTP server that answers POST /v1/search; requests run side by side in one session. Call serve_forever() on it."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:  # noqa: N802 - the name is the library's
            length = int(self.headers.get("Content-Length") or 0)
            if self.path != "/v1/search":
                status, body = 404, json.dumps({"error": "not found"})
            elif length > MAX_BODY:
                status, body = 400, json.dumps({"error": "the request is too large"})
            else:
                status, body = search_api(index, catalog, self.rfile.read(length))
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            """Requests aren't logged."""

    return ThreadingHTTPServer((host, port), Handler)
