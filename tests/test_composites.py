"""Best chunks and the reranked hybrid search against plain Python."""

from larkspur.functions import chunking
from larkspur.operators import composites


def test_best_chunks(spark):
    body = "\n\n".join(f"Section {i}. " + "filler text here " * 60 + ("apples and pears" if i == 7 else "") + ("harvest season" if i == 9 else "") for i in range(14))
    docs = [(1, body), (2, "short apples"), (3, None), (4, "never asked for")]
    asked = [(1, "where are apples, pears and", "the harvest season"), (2, "harvest season", None), (3, "", "apples")]
    hits = spark.createDataFrame([(q, d) for q in (1, 2, 3) for d in (1, 2, 3)] + [(1, 1)], "query_id long, id long")
    found = composites.best_chunks(hits, spark.createDataFrame(docs, "id long, body string"), spark.createDataFrame(asked, "query_id long, query string, intent string"), "intent")
    got = {(r.query_id, r.id): (r.seq, r.held) for r in found.collect()}
    want = {}
    stop = {"the"}
    for q, query, intent in asked:
        words = [w for w in query.lower().split() if len(w) > 2]
        terms = [w for w in (intent or "").lower().split() if w not in stop]
        for d, text in docs[:3]:
            held = [sum(w in c.lower() for w in words) + 0.5 * sum(t in c.lower() for t in terms) for _, c in chunking.chunks(text or "")]
            want[q, d] = (held.index(max(held)), max(held))
    assert got == want and got[1, 1][0] > 0


def test_reranker_sees_the_best_chunk(spark):
    docs = spark.createDataFrame([(i, "filler words " * 600 + ("the answer is blue" if i == 3 else "")) for i in range(5)], "id long, body string")
    asked = spark.createDataFrame([(1, "answer blue")], "query_id long, query string")
    ranked = spark.createDataFrame([(1, i, i + 1) for i in range(5)], "query_id long, id long, rank int")
    seen = []

    def share(pairs):
        seen.extend(pairs.collect())
        return pairs.selectExpr("query_id", "id", "CASE WHEN contains(text, 'blue') THEN 1.0D ELSE 0.0D END AS score")

    top = composites.hybrid_search([ranked], docs, asked, reranker=share).orderBy("rank").collect()
    assert len(seen) == 5 and sum("blue" in r.text for r in seen) == 1 and all(len(r.text) <= chunking.SIZE for r in seen)
    assert {r.id: r.score for r in top}[3] > {r.id: r.score for r in top}[2]
