"""Counters of an index and their Prometheus endpoint; percentiles over a query log of any size."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Collector:
    """Counts queries and their microseconds. With a port (0: any free one) it serves /metrics and /health on 127.0.0.1."""

    def __init__(self, dim: int = 0, metric: str = "", size: Callable[[], int] = lambda: 0, port: int | None = None) -> None:
        self._lock, self._count, self._total, self._recall = threading.Lock(), 0, 0.0, {}
        self.dim, self.metric, self.size, self.began = dim, metric, size, time.time()
        self.server = self._serve(port) if port is not None else None

    def record_query(self, microseconds: float) -> None:
        with self._lock:
            self._count += 1
            self._total += microseconds

    def update_recall(self, k: int, recall: float) -> None:
        with self._lock:
            self._recall[k] = recall

    def snapshot(self) -> dict:
        with self._lock:
            count, total, recall = self._count, self._total, dict(self._recall)
        return {"query_count": count, "avg_query_latency_us": total / count if count else 0.0, "index_size": self.size(), "dimensions": self.dim, "distance_metric": self.metric, "uptime_seconds": int(time.time() - self.began), "recall_estimates": recall}

    def prometheus(self) -> str:
        s = self.snapshot()
        rows = [
            ("query_count", "counter", "Queries so far", s["query_count"]),
            ("avg_query_latency_microseconds", "gauge", "Mean time of a query", f"{s['avg_query_latency_us']:.2f}"),
            ("index_size", "gauge", "Rows in the index", s["index_size"]),
            ("dimensions", "gauge", "Numbers in a vector", s["dimensions"]),
            ("uptime_seconds", "counter", "Seconds since the start", s["uptime_seconds"]),
        ]
        out = [f"# HELP nearfield_{n} {h}\n# TYPE nearfield_{n} {t}\nnearfield_{n} {v}\n" for n, t, h, v in rows]
        out.append(f'# HELP nearfield_distance_metric The metric\n# TYPE nearfield_distance_metric gauge\nnearfield_distance_metric{{metric="{s["distance_metric"]}"}} 1\n')
        return "".join(out)

    def _serve(self, port: int) -> ThreadingHTTPServer:
        collector = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                pages = {"/metrics": collector.prometheus, "/health": lambda: "OK\n"}
                body = pages[self.path]().encode() if self.path in pages else b"Not Found\n"
                self.send_response(200 if self.path in pages else 404)
                self.send_header("Content-Type", "text/plain; version=0.0.4")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_) -> None:
                pass

        server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server

    def stop(self) -> None:
        if self.server:
            self.server.shutdown()
            self.server.server_close()


def latency_stats(log: DataFrame, latency: str, *by: str) -> DataFrame:
    """Count, mean, least, largest and exact 50th, 95th and 99th percentile (interpolated) by group."""
    p = lambda x, name: F.percentile(latency, x).alias(name)
    return log.groupBy(*by).agg(F.count(latency).alias("n"), F.avg(latency).alias("mean"), F.min(latency).alias("least"), F.max(latency).alias("largest"), p(0.5, "p50"), p(0.95, "p95"), p(0.99, "p99"))
