"""The category taxonomy and the hints by domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Categories in order, with priority and keywords.
CATEGORIES = [
    (0, "api", 1, ["api", "endpoint", "sdk", "rest", "graphql", "rpc", "webhook", "http"]),
    (1, "architecture", 2, ["architecture", "design pattern", "microservice", "monolith", "event-driven", "circuit breaker"]),
    (2, "configuration", 3, ["config", "configuration", "setting", "environment", "env", "properties", "yaml", "toml"]),
    (3, "deployment", 4, ["deploy", "ci/cd", "docker", "kubernetes", "k8s", "cloud", "aws", "azure", "gcp", "pipeline"]),
    (4, "security", 1, ["security", "auth", "authentication", "authorization", "oauth", "jwt", "tls", "encryption", "vulnerability"]),
    (5, "performance", 5, ["performance", "optimization", "benchmark", "latency", "throughput", "scalability", "caching"]),
    (6, "database", 6, ["database", "sql", "nosql", "query", "schema", "migration", "index", "storage"]),
    (7, "testing", 7, ["test", "testing", "qa", "coverage", "unit test", "integration test", "e2e", "mock"]),
    (8, "machine_learning", 8, ["machine learning", "ml", "ai", "model", "training", "inference", "neural network", "llm", "embedding"]),
    (9, "networking", 9, ["network", "protocol", "dns", "tcp", "udp", "http", "websocket", "proxy"]),
    (10, "language", 10, ["python", "javascript", "typescript", "rust", "go", "java", "syntax", "feature"]),
    (11, "tooling", 11, ["cli", "tool", "ide", "editor", "workflow", "debugging", "profiling"]),
    (12, "error_handling", 12, ["error", "exception", "logging", "monitoring", "observability", "alerting", "debug"]),
    (13, "data_format", 13, ["json", "xml", "yaml", "protobuf", "avro", "csv", "format", "serialization"]),
    (14, "concurrency", 14, ["async", "await", "thread", "concurrent", "parallel", "goroutine", "coroutine"]),
]

# Domains and the categories they hint at.
HINTS = [
    ("docs.python.org", ["language", "tooling"]),
    ("developer.mozilla.org", ["language", "api"]),
    ("kubernetes.io", ["deployment", "architecture"]),
    ("docker.com", ["deployment"]),
    ("aws.amazon.com", ["deployment", "cloud"]),
    ("docs.github.com", ["tooling", "deployment"]),
    ("grpc.io", ["api", "networking"]),
    ("redis.io", ["database", "caching"]),
    ("postgresql.org", ["database"]),
    ("tensorflow.org", ["machine_learning"]),
    ("pytorch.org", ["machine_learning"]),
    ("fastapi.tiangolo.com", ["api", "framework"]),
    ("django.readthedocs.io", ["api", "framework"]),
    ("nextjs.org", ["framework", "deployment"]),
    ("react.dev", ["framework", "language"]),
]


def categories(spark: SparkSession) -> DataFrame:
    """``ord, category, priority, keywords``: 15 rows."""
    return spark.createDataFrame(CATEGORIES, "ord int, category string, priority int, keywords array<string>")


def hints(spark: SparkSession) -> DataFrame:
    """``domain, category`` for the hints that name a category of the taxonomy."""
    known = {c[1] for c in CATEGORIES}
    return spark.createDataFrame([(d, n) for d, names in HINTS for n in names if n in known], "domain string, category string")


def categories_sql() -> str:
    """The taxonomy as a VALUES list."""
    rows = ", ".join(f"({o}, '{n}', {p}, {w!r})" for o, n, p, w in CATEGORIES)
    return f"(VALUES {rows}) c(ord, category, priority, keywords)"


def hints_sql() -> str:
    known = {c[1] for c in CATEGORIES}
    return "(VALUES " + ", ".join(f"('{d}', '{n}')" for d, names in HINTS for n in names if n in known) + ") h(domain, category)"
