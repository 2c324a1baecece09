"""Ranking: lexical and dense search, fusion, reranking and evaluation."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.adapters import PAPERS_SQL, TURNS_SQL, papers, questions, table, turns, vectors
from spindrift.catalog.base import query
from spindrift.functions.embedding import hash_embed
from spindrift.functions.text import ANCHORS, STOPWORDS, overlap, skip_rewrite, tokens
from spindrift.operators import metrics
from spindrift.operators.evaluation import against_published
from spindrift.operators.filters import Filters
from spindrift.operators.fusion import degrade, fuse
from spindrift.operators.lexical import all_terms, best_field, postings
from spindrift.operators.lexical import bm25_topk as bm25_topk_of
from spindrift.operators.ranking import top_k
from spindrift.plans.hybrid import arms, judgements, reranked, retrieve, retrieve_plans
from spindrift.plans.providers import embed_ladder
from spindrift.session import scratch_path

STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
ANCHOR = "[" + ", ".join(f"'{w}'" for w in ANCHORS) + "]"


def tokens_sql(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({STOP}, w)))"


def overlap_sql(a: str, b: str) -> str:
    own = tokens_sql(a)
    return f"CASE WHEN len({own}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({own}, {tokens_sql(b)}))::DOUBLE / len({own}) END"


def bm25_sql(text: str, k1: str = "1.2", b: str = "0.75", name: str = "bm") -> str:
    return f"""{name}_w AS (SELECT doc_id AS id, regexp_extract_all(lower({text}), '[a-z0-9]+') AS w FROM papers),
{name}_st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM {name}_w),
{name}_tf AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM {name}_w) GROUP BY id, term),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name} AS (SELECT qid, t.id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / avgdl))), 6) AS score
  FROM qt JOIN {name}_tf t ON qt.term = t.term JOIN {name}_df d ON d.term = t.term, {name}_st GROUP BY qid, t.id)"""


QT = """q AS (SELECT item_id AS qid, text AS query FROM benchmark),
qt AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM q))"""


def rank_sql(source: str, k: int) -> str:
    return f"SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {source}) WHERE rank <= {k}"


LEX = f"{PAPERS_SQL}, {QT}, {bm25_sql('text')}, lex AS ({rank_sql('bm', 50)})"
DENSE = f"""den_s AS (SELECT q.vec_id AS qid, v.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark)), den AS ({rank_sql('den_s', 50)})"""
LISTS = "lists AS (SELECT qid, 0 AS list_no, rank, id FROM lex UNION ALL SELECT qid, 1, rank, id FROM den)"
FUSED = """fused AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, id) AS rank FROM (
  SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list_no * 1000 + rank) AS seen FROM lists GROUP BY qid, id))"""
HYBRID = f"{LEX}, {DENSE}, {LISTS}, {FUSED}"


def query_vectors(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir)
    return v.join(questions(spark, sf_dir).select(F.col("qid").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


def lexical_ranks(spark, sf_dir, k: int = 50) -> DataFrame:
    return bm25_topk_of(papers(spark, sf_dir), questions(spark, sf_dir), k, "doc_id", F.col("text"))


def once(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: a table that a query reads several times."""
    path = scratch_path(df.sparkSession, "once")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fused(spark, sf_dir) -> DataFrame:
    return retrieve(papers(spark, sf_dir), vectors(spark, sf_dir), questions(spark, sf_dir), query_vectors(spark, sf_dir))


@query(f"WITH {LEX} SELECT * FROM lex")
def bm25_topk(spark, sf_dir):
    return lexical_ranks(spark, sf_dir)


@query(f"WITH {PAPERS_SQL}, {QT}, {bm25_sql('text')}, {bm25_sql('title', name='bt')}, best AS (SELECT qid, id, max(score) AS score FROM (SELECT * FROM bm UNION ALL SELECT qid, id, round(score * 2.0::DOUBLE, 6) FROM bt) GROUP BY qid, id) {rank_sql('best', 50)}")
def bm25_multifield(spark, sf_dir):
    """The best of the text and twice the title."""
    return best_field(papers(spark, sf_dir), questions(spark, sf_dir), "doc_id", {"text": 1.0, "title": 2.0}, 50)


@query(f"WITH {PAPERS_SQL}, {QT}, {bm25_sql(chr(39).join(['concat(title, ', '. ', ', text)']), '0.9', '0.4')} {rank_sql('bm', 10)}")
def bm25_contents(spark, sf_dir):
    """The parameters of a public benchmark run, over title and text as one field."""
    p = papers(spark, sf_dir)
    return bm25_topk_of(p, questions(spark, sf_dir), 10, "doc_id", F.concat("title", F.lit(". "), "text"), 0.9, 0.4)


@query(f"""WITH {PAPERS_SQL}, q AS (SELECT item_id AS qid, text AS query FROM benchmark),
qt AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM q)),
w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM papers),
tf AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY id, term),
need AS (SELECT qid, count(*) AS need FROM qt GROUP BY qid),
hit AS (SELECT qid, id, count(*) AS have, sum(tf) AS tf, max(dl) AS dl FROM qt JOIN tf USING (term) GROUP BY qid, id),
s AS (SELECT hit.qid, id, round(tf::DOUBLE / dl, 6) AS score FROM hit JOIN need ON hit.qid = need.qid WHERE have = need) {rank_sql('s', 50)}""")
def lexical_all_terms(spark, sf_dir):
    """Every term of the question must occur."""
    return top_k(all_terms(papers(spark, sf_dir), questions(spark, sf_dir), "doc_id", F.col("text")), 50)


@query(f"WITH {HYBRID} SELECT qid, list_no, rank, id FROM lists")
def arms_union_all(spark, sf_dir):
    return arms(papers(spark, sf_dir), vectors(spark, sf_dir), questions(spark, sf_dir), query_vectors(spark, sf_dir))


@query(f"WITH {HYBRID} SELECT qid, id, score, rank FROM fused")
def rrf_fuse(spark, sf_dir):
    return fuse(arms_union_all(spark, sf_dir))


@query(f"WITH {HYBRID} SELECT qid, id, score, rank FROM fused WHERE rank <= 50")
def hybrid_topn(spark, sf_dir):
    return fused(spark, sf_dir)


@query(f"WITH {HYBRID} SELECT f.qid, f.rank, p.paper_id, p.title FROM fused f JOIN papers p ON p.doc_id = f.id WHERE f.rank <= 50 AND p.owner IS NULL")
def hydrate_candidates(spark, sf_dir):
    """Ranked ids get their texts; ids that are missing or not visible drop out, and ranks stay."""
    p = papers(spark, sf_dir).where("owner is null").select(F.col("doc_id").alias("id"), "paper_id", "title")
    return fused(spark, sf_dir).join(p, "id").select("qid", "rank", "paper_id", "title")


RERANKED = f"""{HYBRID}, held AS (SELECT f.qid, f.id, f.rank, p.paper_id, p.text, q.query, round({overlap_sql('q.query', 'p.text')}, 6) AS rerank_score
  FROM fused f JOIN papers p ON p.doc_id = f.id JOIN q ON q.qid = f.qid WHERE f.rank <= 50),
rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, rank) AS new_rank FROM held) WHERE new_rank <= 8)"""


@query(f"WITH {RERANKED} SELECT qid, id, rerank_score, new_rank FROM rr")
def rerank_apply(spark, sf_dir):
    return reranked(fused(spark, sf_dir), papers(spark, sf_dir), questions(spark, sf_dir)).select("qid", "id", "rerank_score", "new_rank")


@query(f"WITH {RERANKED} SELECT qid, id, rank AS old_rank, new_rank, rank - new_rank AS shift FROM rr")
def rank_shift(spark, sf_dir):
    r = reranked(fused(spark, sf_dir), papers(spark, sf_dir), questions(spark, sf_dir))
    return r.select("qid", "id", F.col("rank").alias("old_rank"), "new_rank", (F.col("rank") - F.col("new_rank")).alias("shift"))


@query(f"WITH {LEX} SELECT qid, id, rank, CAST(NULL AS DOUBLE) AS rerank_score, true AS degraded FROM lex WHERE rank <= 8")
def rerank_degrade(spark, sf_dir):
    return degrade(lexical_ranks(spark, sf_dir))


@query(f"WITH {LEX} SELECT l.qid, l.rank, l.id, substr(p.text, 1, 80) AS preview FROM lex l JOIN papers p ON p.doc_id = l.id WHERE l.rank <= 10")
def trace_topk(spark, sf_dir):
    p = papers(spark, sf_dir).select(F.col("doc_id").alias("id"), F.substring("text", 1, 80).alias("preview"))
    return lexical_ranks(spark, sf_dir, 10).join(p, "id").select("qid", "rank", "id", "preview")


@query("""WITH q AS (SELECT item_id AS qid, [text, concat('about ', text), reverse(text)] AS v FROM benchmark)
SELECT qid, i AS variant_no, v[i + 1] AS variant, arm FROM q, (SELECT unnest([0, 1, 2]) AS i) a, (SELECT unnest(['lexical', 'dense']) AS arm) b""")
def variant_fanout(spark, sf_dir):
    v = F.array(F.col("query"), F.concat(F.lit("about "), "query"), F.reverse("query"))
    out = questions(spark, sf_dir).select("qid", F.posexplode(v).alias("variant_no", "variant"))
    return out.select("qid", F.col("variant_no").cast("long").alias("variant_no"), "variant", F.explode(F.array(F.lit("lexical"), F.lit("dense"))).alias("arm"))


@query("SELECT item_id AS qid, 0 AS variant_no, text AS variant, 'factual' AS intent, true AS degraded FROM benchmark")
def plan_degraded(spark, sf_dir):
    """Without a planner: the question as it stands, no expansions, a factual intent."""
    return questions(spark, sf_dir).select("qid", F.lit(0).cast("long").alias("variant_no"), F.col("query").alias("variant"), F.lit("factual").alias("intent"), F.lit(True).alias("degraded"))


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 9 <> 0 AS valid FROM events""")
def plan_json_parse(spark, sf_dir):
    """JSON by a schema; what does not parse is marked (every ninth text is cut short here)."""
    raw = F.when(F.col("event_id") % 9 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    parsed = table(spark, sf_dir, "events").select("event_id", F.from_json(raw, "k long, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("p"))
    return parsed.select("event_id", F.when(F.col("p.broken").isNull(), F.col("p.k")).alias("k"), F.col("p.broken").isNull().alias("valid"))


@query(f"""SELECT conv_id, turn, len(regexp_split_to_array(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '\\s+')) >= 6
 AND NOT len(list_filter(regexp_split_to_array(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '\\s+'), lambda w: length(w) BETWEEN 2 AND 4 AND w = upper(w) AND w <> lower(w))) > 0
 AND list_has_any({tokens_sql('text')}, {ANCHOR}) AS skip FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN concat(text, ' method') ELSE text END AS text FROM conversations)""")
def should_skip_rewrite(spark, sf_dir):
    text = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" method"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", skip_rewrite(text).alias("skip"))


@query("SELECT vec_id AS qid, least(label + 4, 16) AS attempt_1, least(label + 8, 16) AS attempt_2 FROM embeddings")
def widen_schedule(spark, sf_dir):
    """The context of a second and third attempt: four more, sixteen at most."""
    wider = lambda n: F.least(n + 4, F.lit(16))
    label = F.col("label").cast("long")
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("qid"), wider(label).alias("attempt_1"), wider(wider(label)).alias("attempt_2"))


@query(f"SELECT doc_id, len({tokens_sql('text')}) AS n_tokens, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_words FROM documents")
def tokenize_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(tokens("text")).cast("long").alias("n_tokens"), F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).cast("long").alias("n_words"))


@query(f"WITH {TURNS_SQL} SELECT conv_id, turn, round({overlap_sql('answer', 'query')}, 6) AS overlap FROM turns")
def overlap_ratio(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.round(overlap("answer", "query"), 6).alias("overlap"))


# Evaluation.
JUDGED = """judged AS (SELECT qid, id, max(grade) AS grade FROM (
  SELECT b.item_id AS qid, d.doc_id AS id, 2 AS grade FROM benchmark b JOIN documents d ON contains(d.text, b.text)
  UNION ALL SELECT item_id, item_id, 1 FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents)
  UNION ALL SELECT item_id, item_id + 100, 0 FROM benchmark WHERE item_id + 100 IN (SELECT doc_id FROM documents)) GROUP BY qid, id)"""


def metrics_sql(source: str, k: int, tag: str) -> str:
    return f"""{tag}_h AS (SELECT j.qid, j.id, j.grade, r.rank FROM judged j LEFT JOIN {source} r ON r.qid = j.qid AND r.id = j.id AND r.rank <= {k}),
{tag}_i AS (SELECT qid, sum(CASE WHEN grade > 0 THEN (pow(2.0, grade) - 1) / log2(r + 1.0) ELSE 0 END) AS ideal FROM (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, id) AS r FROM judged) WHERE r <= {k} GROUP BY qid),
{tag} AS (SELECT h.qid, count(rank)::DOUBLE / count(*) AS recall, coalesce(1.0::DOUBLE / min(rank), 0) AS mrr,
  CASE WHEN any_value(ideal) > 0 THEN sum(CASE WHEN rank IS NOT NULL AND grade > 0 THEN (pow(2.0, grade) - 1) / log2(rank + 1.0) ELSE 0 END) / any_value(ideal) ELSE 0 END AS ndcg
  FROM {tag}_h h JOIN {tag}_i i ON h.qid = i.qid GROUP BY h.qid)"""


def judged(spark, sf_dir) -> DataFrame:
    return judgements(papers(spark, sf_dir), questions(spark, sf_dir))


@query(f"WITH {LEX}, {JUDGED}, {metrics_sql('lex', 10, 'm')} SELECT qid, round(recall, 6) AS recall FROM m")
def recall_at_k(spark, sf_dir):
    return metrics.recall(lexical_ranks(spark, sf_dir), judged(spark, sf_dir), 10).select("qid", F.round("recall", 6).alias("recall"))


@query(f"WITH {LEX}, {JUDGED}, {metrics_sql('lex', 10, 'm')} SELECT qid, round(ndcg, 6) AS ndcg FROM m")
def ndcg_at_k(spark, sf_dir):
    return metrics.ndcg(lexical_ranks(spark, sf_dir), judged(spark, sf_dir), 10).select("qid", F.round("ndcg", 6).alias("ndcg"))


@query(f"WITH {LEX}, {JUDGED}, {metrics_sql('lex', 10, 'm')} SELECT qid, round(mrr, 6) AS mrr FROM m")
def mrr_at_k(spark, sf_dir):
    return metrics.reciprocal_rank(lexical_ranks(spark, sf_dir), judged(spark, sf_dir), 10).select("qid", F.round("mrr", 6).alias("mrr"))


@query(f"""WITH {RERANKED}, {JUDGED}, fz AS (SELECT qid, id, rank FROM fused), rz AS (SELECT qid, id, new_rank AS rank FROM rr),
{metrics_sql('lex', 10, 'ma')}, {metrics_sql('den', 10, 'mb')}, {metrics_sql('fz', 10, 'mc')}, {metrics_sql('rz', 10, 'md')}
SELECT config, count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr FROM (
 SELECT 'bm25' AS config, * FROM ma UNION ALL SELECT 'dense', * FROM mb UNION ALL SELECT 'hybrid', * FROM mc UNION ALL SELECT 'hybrid_rerank', * FROM md) GROUP BY config""")
def ablation_summary(spark, sf_dir):
    """Means over all judged questions; a question without results scores 0 and stays."""
    j = once(judged(spark, sf_dir))
    lists = once(arms_union_all(spark, sf_dir))
    f = once(fuse(lists))
    r = reranked(f.where("rank <= 50"), papers(spark, sf_dir), questions(spark, sf_dir)).select("qid", "id", F.col("new_rank").alias("rank"))
    configs = {"bm25": lists.where("list_no = 0").select("qid", "id", "rank"), "dense": lists.where("list_no = 1").select("qid", "id", "rank"), "hybrid": f.select("qid", "id", "rank"), "hybrid_rerank": r}
    out = None
    for name, ranked in configs.items():
        each = metrics.recall(ranked, j, 10).join(metrics.ndcg(ranked, j, 10), "qid").join(metrics.reciprocal_rank(ranked, j, 10), "qid")
        one = each.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(m), 6).alias(m) for m in ("recall", "ndcg", "mrr")]).withColumn("config", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {PAPERS_SQL}, {QT}, {bm25_sql(chr(39).join(['concat(title, ', '. ', ', text)']), '0.9', '0.4')}, bench AS ({rank_sql('bm', 10)}), {JUDGED}, {metrics_sql('bench', 10, 'm')},
a AS (SELECT count(*) AS n_queries, round(avg(ndcg), 6) AS mean FROM m)
SELECT n_queries, mean, 0.665::DOUBLE AS published, round(mean - 0.665::DOUBLE, 6) AS difference, CASE WHEN abs(round(mean - 0.665::DOUBLE, 6)) <= 0.02 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM a""")
def validation_run(spark, sf_dir):
    """The mean nDCG of the public benchmark's parameters against its published value (of other texts, so it differs here)."""
    return against_published(metrics.ndcg(bm25_contents(spark, sf_dir), judged(spark, sf_dir), 10), "ndcg", 0.665, 0.02)


@query(f"WITH {JUDGED} SELECT qid, id % 50 AS paper, max(grade) AS grade FROM judged GROUP BY qid, id % 50")
def derive_doc_qrels(spark, sf_dir):
    """Judgements of papers from those of their passages: the highest grade."""
    return judged(spark, sf_dir).groupBy("qid", (F.col("id") % 50).alias("paper")).agg(F.max("grade").alias("grade"))


@query(f"WITH {LEX}, r AS (SELECT qid, id % 50 AS paper, min(rank) AS first_rank FROM lex GROUP BY qid, id % 50) SELECT qid, paper, first_rank, row_number() OVER (PARTITION BY qid ORDER BY first_rank) AS rank FROM r")
def doc_rollup_first(spark, sf_dir):
    """Passages to papers: the first rank counts, then ranks are given anew."""
    r = lexical_ranks(spark, sf_dir).groupBy("qid", (F.col("id") % 50).alias("paper")).agg(F.min("rank").alias("first_rank"))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("first_rank")).cast("long"))


#: CRC-32 of an ASCII word: for each byte, eight steps of the reflected polynomial.
WORD_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(word, ''), lambda d: ascii(d)::BIGINT)),
  lambda a, d: list_reduce(list_prepend(xor(a, d), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda e, z: xor(e >> 1, 3988292384 * (e & 1)))), 4294967295)"""


HASHED = f"""w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS word FROM documents),
h AS (SELECT word, {WORD_CRC32} AS h FROM (SELECT DISTINCT word FROM w)),
c AS (SELECT doc_id, h % 64 AS place, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS n FROM w JOIN h USING (word) GROUP BY doc_id, h % 64),
v AS (SELECT doc_id, sum(CASE WHEN place = 0 THEN n ELSE 0 END)::DOUBLE AS first, sqrt(sum(n * n)::DOUBLE) AS norm FROM c GROUP BY doc_id)"""


@query(f"WITH {HASHED} SELECT c.doc_id, place, round(n / norm, 9) AS component FROM c JOIN v ON v.doc_id = c.doc_id WHERE n <> 0")
def embed_hash(spark, sf_dir):
    """Embeddings of all documents by the offline provider, in Arrow batches; the components that are not zero."""

    @F.pandas_udf("array<double>")
    def embed(text: pd.Series) -> pd.Series:
        return pd.Series(list(hash_embed(text.fillna("").tolist())))

    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(embed("text")).alias("place", "component")).where("component <> 0")
    return parts.select("doc_id", F.col("place").cast("long").alias("place"), F.round("component", 9).alias("component"))


@query(f"""WITH {HASHED}
SELECT d.doc_id, round(coalesce(CASE WHEN norm > 0 THEN first / norm END, 0), 9) AS component FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id""")
def embed_align(spark, sf_dir):
    """Distinct texts are embedded once, and every row gets the vector of its text (its first component here)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = embed_ladder(d, [("hashed", hash_embed)], "doc_id")
    return out.select("doc_id", F.round(F.col("vector")[0], 9).alias("component"))


@query("SELECT item_id, text FROM benchmark")
def scan_jsonl(spark, sf_dir):
    """Rows written as files of JSON lines and scanned by a declared schema."""
    path = scratch_path(spark, "jsonl")
    table(spark, sf_dir, "benchmark").select("item_id", "text").write.json(path)
    return spark.read.schema("item_id long, text string").json(path)


@query("SELECT CAST(item_id AS VARCHAR) AS query_id, CAST(item_id AS VARCHAR) AS corpus_id, 1 AS score FROM benchmark")
def scan_benchmark(spark, sf_dir):
    """Judgements written as tab-separated files with a header line and scanned by a declared schema."""
    path = scratch_path(spark, "tsv")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("corpus_id"), F.lit(1).alias("score"))
    rows.write.csv(path, sep="\t", header=True)
    return spark.read.schema("query_id string, corpus_id string, score long").csv(path, sep="\t", header=True)


# Plans with variants and filters.
PLANS = """q AS (SELECT item_id * 64 + v AS qid, CASE v WHEN 0 THEN text ELSE concat('about ', text) END AS query, item_id, v FROM benchmark, (SELECT unnest([0, 1]) AS v)),
qt AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM q))"""


def plans_sql(eligible: str = "") -> str:
    among = (lambda x: f"WHERE {x} IN (SELECT doc_id FROM ok)") if eligible else lambda x: ""
    return f"""WITH {PAPERS_SQL}, ok AS (SELECT doc_id FROM papers WHERE {eligible or 'true'}), {PLANS}, {bm25_sql('text')},
bm_ok AS (SELECT * FROM bm {among('id')}), lex AS ({rank_sql('bm_ok', 50)}),
den_s AS (SELECT q.qid, v.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
  FROM q JOIN embeddings a ON a.vec_id = q.item_id + q.v, embeddings v {among('v.vec_id')}), den AS ({rank_sql('den_s', 50)}),
lists AS (SELECT qid // 64 AS qid, (qid % 64) * 2 AS list_no, rank, id FROM lex UNION ALL SELECT qid // 64, (qid % 64) * 2 + 1, rank, id FROM den),
{FUSED} SELECT qid, id, score, rank FROM fused WHERE rank <= 50"""


def plans_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two variants of each question: its text, and the text about it with the next vector."""
    v = F.array(F.col("query"), F.concat(F.lit("about "), "query"))
    q = questions(spark, sf_dir).select("qid", F.posexplode(v).alias("variant_no", "query"))
    e = vectors(spark, sf_dir).select(F.col("vec_id").alias("at"), F.col("embedding").alias("vector"))
    return q, q.join(e, F.col("qid") + F.col("variant_no") == F.col("at")).select("qid", "variant_no", "vector")


@query(plans_sql())
def hybrid_variants(spark, sf_dir):
    """All variants of a question in both arms, and all their lists fused."""
    return retrieve_plans(papers(spark, sf_dir), vectors(spark, sf_dir), *plans_of(spark, sf_dir))


@query(plans_sql("(owner IS NULL OR owner = 's1') AND list_contains(category, 'en') AND published_date >= DATE '2024-02-01'"))
def hybrid_filtered(spark, sf_dir):
    """Filters hold in both arms alike, before the ranking."""
    return retrieve_plans(papers(spark, sf_dir), vectors(spark, sf_dir), *plans_of(spark, sf_dir), Filters(category="en", date_from="2024-02-01", session="s1"))


@query(plans_sql("owner IS NULL AND published_date <= DATE '2024-10-31'"))
def hybrid_sanitised(spark, sf_dir):
    """A category that no shared paper has is dropped; the date still holds."""
    return retrieve_plans(papers(spark, sf_dir), vectors(spark, sf_dir), *plans_of(spark, sf_dir), Filters(category="cs.ZZ", date_to="2024-10-31"))


@query(f"WITH {LEX} SELECT * FROM lex")
def bm25_indexed(spark, sf_dir):
    """The same ranks from a stored table of postings, built once for any questions."""
    path = scratch_path(spark, "index")
    postings(papers(spark, sf_dir), None, "doc_id", F.col("text")).write.parquet(path)
    return bm25_topk_of(None, questions(spark, sf_dir), 50, index=spark.read.parquet(path))
