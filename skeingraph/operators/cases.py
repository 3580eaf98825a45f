"""Evaluation cases with graphs of their own: a built-in sample, ranking within each case, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

_CASE = "id string, dataset string, category string, query string, expected_answer string, expected_ids array<string>, nodes array<struct<id:string,type:string,name:string,content:string>>"
#: (category, question, answer, name of the expected node, texts of the graph by name).
_SAMPLE = [
    ("fact", "Which port does the billing gateway listen on", "The billing gateway listens on port 9443", "billing-gateway", {"billing-gateway": "The billing gateway listens on port 9443 behind the proxy", "report-job": "The report job runs at night"}),
    ("fact", "Who maintains the ledger importer", "Mara maintains the ledger importer", "ledger-importer", {"ledger-importer": "Mara maintains the ledger importer since spring", "ledger-export": "The ledger export writes one file a day"}),
    ("fix", "How was the broken login page repaired", "The session cookie was renewed", "renew-cookie", {"renew-cookie": "The broken login page was repaired when the session cookie was renewed", "slow-query": "An index repaired the slow query"}),
    ("fix", "What solved the memory leak in the parser", "Closing the token stream solved the leak", "close-stream", {"close-stream": "Closing the token stream solved the memory leak in the parser", "parser-tests": "The parser has tests for every rule", "memory-note": "Memory is measured each night"}),
    ("cause", "Why did the nightly backup fail", "The disk was full", "full-disk", {"full-disk": "The nightly backup failed because the disk was full", "backup-plan": "Backups are kept for thirty days"}),
    ("cause", "What caused the late deliveries in May", "A strike at the harbour caused them", "harbour-strike", {"harbour-strike": "A strike at the harbour caused the late deliveries in May", "may-report": "The report for May is late"}),
    ("steps", "How do I rotate the signing keys", "Create a key, publish it, retire the old one", "rotate-keys", {"rotate-keys": "To rotate the signing keys create a key publish it and retire the old one", "signing-note": "Signing takes two approvals"}),
    ("steps", "How do I add a region to the map service", "Add the tiles and restart the map service", "add-region", {"add-region": "To add a region add the tiles and restart the map service", "map-colours": "The map has two colour schemes", "region-list": "There are nine regions"}),
    ("time", "When does the tax season job start", "It starts in February", "tax-season", {"tax-season": "The tax season job starts in February", "season-note": "A season has thirteen weeks"}),
    ("time", "When was the archive moved to the new hall", "The archive moved in autumn", "archive-move", {"archive-move": "The archive was moved to the new hall in autumn", "hall-plan": "The new hall has four floors"}),
]


def sample_cases(spark: SparkSession) -> DataFrame:
    """Ten questions, each with the nodes of a small graph, one of which answers it."""
    rows = []
    for i, (kind, query, answer, name, texts) in enumerate(_SAMPLE):
        nodes = [(f"bench-sample-{i}-{n}", "SKILL" if n == name else "EVENT", n, body) for n, body in texts.items()]
        rows.append((f"sample-{i}", "sample", kind, query, answer, [f"bench-sample-{i}-{name}"], nodes))
    return spark.createDataFrame(rows, _CASE)


def rank_in_cases(cases: DataFrame, limit: int = 6, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(case_id, id, rank, text): the best nodes of each case's own graph for its question, by BM25 within the case."""
    docs = cases.select(F.col("id").alias("case_id"), "query", F.explode("nodes").alias("n"))
    docs = docs.select("case_id", "query", "n.id", F.concat_ws(": ", "n.name", "n.content").alias("text"), text.search_tokens(F.col("n.content")).alias("terms"))
    sizes = docs.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("terms")).alias("avg_length"))
    hits = docs.select("case_id", "id", "text", F.size("terms").alias("length"), F.explode("terms").alias("term"), "query").where(F.array_contains(text.search_tokens(F.col("query")), F.col("term")))
    tf = hits.groupBy("case_id", "id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length"), F.max("text").alias("text"))
    df = tf.groupBy("case_id", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    scored = tf.join(df, ["case_id", "term"]).join(sizes, "case_id").groupBy("case_id", "id").agg(F.sum(part).alias("score"), F.max("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.round("score", 9).desc(), "id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= limit).select("case_id", "id", "rank", "text")


def case_results(cases: DataFrame, ranked: DataFrame, latency_ms: float = 0.0) -> DataFrame:
    """(case_id, dataset, category, hit1, hit3, rr, f1, latency_ms, tokens, recalled) of every case; without a result all measures are 0."""
    expected = cases.select(F.col("id").alias("case_id"), F.explode("expected_ids").alias("id"))
    first = ranked.join(expected, ["case_id", "id"]).groupBy("case_id").agg(F.min("rank").alias("first_rank"))
    found = ranked.groupBy("case_id").agg(F.count(F.lit(1)).alias("recalled"), F.max(F.when(F.col("rank") == 1, F.col("text"))).alias("top"))
    rows = cases.select(F.col("id").alias("case_id"), "dataset", "category", "expected_answer").join(first, "case_id", "left").join(found, "case_id", "left")
    r = F.col("first_rank")
    return rows.select(
        "case_id", "dataset", "category", F.coalesce(r <= 1, F.lit(False)).alias("hit1"), F.coalesce(r <= 3, F.lit(False)).alias("hit3"), F.coalesce(1.0 / r, F.lit(0.0)).alias("rr"),
        text.token_f1(F.col("expected_answer"), F.col("top")).alias("f1"), F.lit(latency_ms).alias("latency_ms"), (F.coalesce("recalled", F.lit(0)) * 50).alias("tokens"), F.coalesce("recalled", F.lit(0)).alias("recalled"),
    )
