"""HTTP: POST /v1/rest/query or /v1/rest/mgmt with {"db": ..., "csl": ...} gives {"Tables": [...]}."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from .engine import Engine
from .lang.lexer import QueryError
from .operators.relational import NET
from .output import values


def answer(frame) -> dict:
    columns = [{"ColumnName": n, "DataType": NET.get(k, "System.String").removeprefix("System."), "ColumnType": k} for n, k in frame.types.items()]
    return {"Tables": [{"TableName": "Table_0", "Columns": columns, "Rows": list(values(frame))}]}


def server(spark: SparkSession, databases: dict[str, Engine | str], host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """``databases``: engines or catalog roots by name; the first serves requests without one.  Call ``serve_forever`` on it."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
                if self.path not in ("/v1/rest/query", "/v1/rest/mgmt"):
                    return self.reply(404, {"error": "not found"})
                name = body.get("db") or next(iter(databases))
                if name not in databases:
                    return self.reply(400, {"error": f"unknown database {name}"})
                text = body.get("csl", "")
                if self.path.endswith("mgmt") != text.strip().startswith("."):
                    return self.reply(400, {"error": "commands go to mgmt, queries to query"})
                found = databases[name]
                engine = found if isinstance(found, Engine) else Engine(spark, found)  # a session for each request
                self.reply(200, answer(engine.frame(text)))
            except (QueryError, ValueError) as e:
                self.reply(400, {"error": str(e)})

        def reply(self, code: int, value: dict) -> None:
            data = json.dumps(value, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
