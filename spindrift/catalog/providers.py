"""Ladders of providers, evaluation with failures, and parsing by dispatch."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.adapters import papers, questions, table, vectors
from spindrift.catalog.base import query
from spindrift.catalog.retrieval import ANCHOR, JUDGED, RERANKED, arms_union_all, fuse, fused, judged, metrics_sql, overlap_sql, plans_sql, tokens_sql
from spindrift.functions.embedding import hash_embed
from spindrift.operators.evaluation import METRICS, Configuration, evaluate
from spindrift.plans.hybrid import retrieve_plans
from spindrift.plans.planner import plan_questions, variants
from spindrift.plans.providers import embed_ladder, question_share, rerank_ladder, role_ladders, text_share
from spindrift.session import stored
from spindrift.sources.dispatch import parse_files


def refuses(scorer, every: int):
    """A provider that turns some questions away, by their length."""

    def score(query: str, texts: list[str]) -> list[float]:
        if len(query) % every == 0:
            raise ConnectionError("turned away")
        return scorer(query, texts)

    return score


def candidates(spark, sf_dir) -> DataFrame:
    f = fused(spark, sf_dir)
    return f.join(papers(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), "id").join(questions(spark, sf_dir), "qid").select("qid", "query", "id", "rank", "text")


OWN, OTHER = tokens_sql("query"), tokens_sql("text")
LADDER = f"""{RERANKED}, both_ AS (SELECT qid, id, rank, query, len(list_intersect({OWN}, {OTHER}))::DOUBLE AS both_n, len({OWN}) AS own_n, len({OTHER}) AS text_n FROM held),
rungs AS (SELECT qid, id, rank, query, length(query) % 3 = 0 AS no_1, length(query) % 2 = 0 AS no_2,
 round(CASE WHEN own_n > 0 THEN both_n / own_n ELSE 0 END, 6) AS s1, round(CASE WHEN text_n > 0 THEN both_n / text_n ELSE 0 END, 6) AS s2 FROM both_),
ladder AS (SELECT qid, id, rank, CASE WHEN NOT no_1 THEN s1 WHEN NOT no_2 THEN s2 END AS rerank_score, CASE WHEN NOT no_1 THEN 'first' WHEN NOT no_2 THEN 'second' END AS served,
 CASE WHEN no_1 THEN concat('first: ConnectionError: turned away', CASE WHEN no_2 THEN '; second: ConnectionError: turned away' ELSE '' END) END AS reason FROM rungs),
lad AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC NULLS LAST, rank) AS new_rank FROM ladder) WHERE new_rank <= 8)"""


@query(f"WITH {LADDER} SELECT qid, id, rank, rerank_score, new_rank, served, reason FROM lad")
def rerank_ladder_served(spark, sf_dir):
    """The first provider turns every third length away, the second every other; what both do stays in its order."""
    return rerank_ladder(candidates(spark, sf_dir), [("first", refuses(question_share, 3)), ("second", refuses(text_share, 2))])


@query("""WITH o AS (SELECT r_name AS role, CASE WHEN r_regionkey % 2 = 1 THEN concat('only ', r_name) END AS provider FROM region)
SELECT r_name AS role, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS rung, n_name AS provider FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey % 2 = 0
UNION ALL SELECT role, 1, provider FROM o WHERE provider IS NOT NULL""")
def role_ladder(spark, sf_dir):
    """Bindings of roles in order (regions and their nations stand in for them); an override is the whole ladder."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    bindings = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("role"), F.col("n_nationkey").alias("rung"), F.col("n_name").alias("provider"))
    overrides = r.select(F.col("r_name").alias("role"), F.when(F.col("r_regionkey") % 2 == 1, F.concat(F.lit("only "), "r_name")).alias("provider"))
    return role_ladders(bindings, overrides)


def planner(refused: int, broken: int, intent: str):
    """A planner that turns some questions away and answers some in a way that cannot be read."""

    def plan(told: str, query: str) -> str:
        if len(query) % refused == 0:
            raise ConnectionError("turned away")
        if len(query) % broken == 0:
            return "{"
        return json.dumps({"normalized": query, "expansions": [f"about {query}", query], "filters": {"category": "en"}, "intent": intent})

    return plan


@query(f"""WITH q AS (SELECT item_id AS qid, CASE WHEN item_id % 4 = 0 THEN concat(text, ' model') ELSE text END AS query FROM benchmark),
s AS (SELECT *, item_id_skip AS skipped FROM (SELECT *, len(regexp_split_to_array(trim(query, chr(32) || chr(9) || chr(10) || chr(13)), '\\s+')) >= 6
 AND NOT len(list_filter(regexp_split_to_array(trim(query, chr(32) || chr(9) || chr(10) || chr(13)), '\\s+'), lambda w: length(w) BETWEEN 2 AND 4 AND w = upper(w) AND w <> lower(w))) > 0
 AND list_has_any({tokens_sql('query')}, {ANCHOR}) AS item_id_skip FROM q)),
r AS (SELECT *, CASE WHEN skipped THEN NULL WHEN length(query) % 3 <> 0 AND length(query) % 5 <> 0 THEN 'first' WHEN length(query) % 2 <> 0 AND length(query) % 7 <> 0 THEN 'second' END AS served FROM s)
SELECT qid, query AS normalized, CASE WHEN served IS NULL THEN '' ELSE concat('about ', query, '|', query) END AS expansions, CASE served WHEN 'first' THEN 'comparative' WHEN 'second' THEN 'multi_hop' ELSE 'factual' END AS intent,
 CASE WHEN served IS NOT NULL THEN 'en' END AS category, served, NOT skipped AND served IS NULL AS degraded,
 CASE WHEN NOT skipped AND served IS NULL THEN CASE WHEN length(query) % 2 = 0 THEN 'second: ConnectionError: turned away' ELSE 'second: ValueError: the plan is not JSON' END END AS reason, skipped FROM r""")
def plan_ladder_served(spark, sf_dir):
    """Questions planned by the first planner whose plan can be read; some need none, some stand as they are."""
    q = questions(spark, sf_dir).select("qid", F.when(F.col("qid") % 4 == 0, F.concat("query", F.lit(" model"))).otherwise(F.col("query")).alias("query"))
    out = plan_questions(q, [("first", planner(3, 5, "comparative")), ("second", planner(2, 7, "multi_hop"))], ["en", "de"])
    return out.select("qid", "normalized", F.array_join("expansions", "|").alias("expansions"), "intent", "category", "served", "degraded", "reason", "skipped")


def turns_away(embed, every: int):
    """An embedder that cannot take texts of some lengths."""

    def run(texts: list[str]):
        if any(len(t) % every == 0 for t in texts):
            raise ConnectionError("turned away")
        return embed(texts)

    return run


@query("""SELECT doc_id, CASE WHEN length(text) % 5 <> 0 THEN 'first' WHEN length(text) % 2 <> 0 THEN 'second' END AS provider,
 CASE WHEN length(text) % 5 <> 0 THEN 64 WHEN length(text) % 2 <> 0 THEN 32 END AS dim,
 CASE WHEN length(text) % 5 <> 0 THEN NULL WHEN length(text) % 2 <> 0 THEN 'first: ConnectionError: turned away' ELSE 'first: ConnectionError: turned away; second: ConnectionError: turned away' END AS reason FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def embed_ladder_served(spark, sf_dir):
    """Embeddings by the first provider that takes a text; the second one has another width, and some texts have none."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = embed_ladder(d, [("first", turns_away(hash_embed, 5)), ("second", turns_away(lambda t: hash_embed(t, 32), 2))], "doc_id")
    return out.select("doc_id", "provider", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dim"), "reason")


def status_sql(name: str, needs: str, source: str, failed: str = "false", status: str = "ran") -> str:
    """A configuration whose questions fail where ``failed`` holds; a failure is a miss."""
    means = ", ".join(f"round(avg(CASE WHEN failed THEN 0 ELSE {m} END), 6) AS {m}, round(avg(CASE WHEN NOT failed THEN {m} END), 6) AS {m}_answered" for m in METRICS)
    return f"SELECT '{name}' AS config, '{needs}' AS needs, '{status}' AS status, CAST(NULL AS VARCHAR) AS reason, count(*) AS n_queries, count(*) FILTER (WHERE failed) AS n_failed, {means} FROM (SELECT m.*, {failed} AS failed FROM {source} m JOIN q ON q.qid = m.qid)"


NO_METRICS = ", ".join(f"NULL AS {m}, NULL AS {m}_answered" for m in METRICS)
STRICT = "length(q.query) % 3 = 0"


@query(f"""WITH {LADDER}, {JUDGED}, fz AS (SELECT qid, id, rank FROM fused), sz AS (SELECT rungs.qid, id, row_number() OVER (PARTITION BY rungs.qid ORDER BY s1 DESC, rank) AS rank FROM rungs WHERE NOT no_1), lz AS (SELECT qid, id, new_rank AS rank FROM lad),
{metrics_sql('lex', 10, 'ma')}, {metrics_sql('den', 10, 'mb')}, {metrics_sql('fz', 10, 'mc')}, {metrics_sql('sz', 10, 'md')}, {metrics_sql('lz', 10, 'me')}
{status_sql('bm25', 'postings', 'ma')} UNION ALL {status_sql('dense', 'vectors', 'mb')} UNION ALL {status_sql('hybrid', 'postings and vectors', 'mc')}
UNION ALL {status_sql('one reranker', 'first', 'md', STRICT)} UNION ALL {status_sql('ladder of rerankers', 'first or second', 'me')}
UNION ALL SELECT 'down', 'third', 'error', 'ConnectionError: turned away', (SELECT count(DISTINCT qid) FROM judged), (SELECT count(DISTINCT qid) FROM judged), {NO_METRICS}
UNION ALL SELECT 'hosted', 'a key', 'not run', 'no key', 0, 0, {NO_METRICS}""")
def ablation_status(spark, sf_dir):
    """Configurations that ran, of which one fails on some questions, one that fails on all, and one that was not run."""
    j = judged(spark, sf_dir)
    lists = stored(arms_union_all(spark, sf_dir))
    f = stored(fuse(lists))
    text = papers(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    held = stored(f.where("rank <= 50").join(text, "id").join(questions(spark, sf_dir), "qid").select("qid", "query", "id", "rank", "text"))
    first, second = ("first", refuses(question_share, 3)), ("second", refuses(text_share, 2))

    def reranker(name: str, needs: str, rungs: list, strict: bool) -> Configuration:
        """Where it is strict, a question that no rung serves has failed."""
        out = stored(rerank_ladder(held, rungs, 50))
        failed = out.where("served is null").select("qid", F.regexp_replace(F.substring_index("reason", ";", -1), r"^\s*\w+: ", "").alias("error"))
        ranked = out.where("served is not null" if strict else "true").where("new_rank <= 8" if not strict else "true")
        return Configuration(name, needs, ranked.select("qid", "id", F.col("new_rank").alias("rank")), failed if strict else None)

    return evaluate(
        [
            Configuration("bm25", "postings", lists.where("list_no = 0")),
            Configuration("dense", "vectors", lists.where("list_no = 1")),
            Configuration("hybrid", "postings and vectors", f),
            reranker("one reranker", "first", [first], True),
            reranker("ladder of rerankers", "first or second", [first, second], False),
            reranker("down", "third", [("third", refuses(question_share, 1))], True),
            Configuration("hosted", "a key", reason="no key"),
        ],
        j,
    )


FULL = plans_sql().rsplit(" SELECT qid, id, score, rank FROM fused", 1)[0]


@query(f"""{FULL}, {JUDGED}, held AS (SELECT f.qid, f.id, f.rank, round({overlap_sql('b.text', 'p.text')}, 6) AS s1 FROM fused f JOIN papers p ON p.doc_id = f.id JOIN benchmark b ON b.item_id = f.qid WHERE f.rank <= 50),
rz AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s1 DESC, rank) AS rank FROM held), {metrics_sql('rz', 10, 'm')}
SELECT 'full' AS config, 'ran' AS status, count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr FROM m""")
def ablation_full(spark, sf_dir):
    """The whole chain: questions planned, all their variants searched in both arms, fused, and reranked by a ladder."""
    asked = questions(spark, sf_dir)
    plans = stored(variants(plan_questions(asked, [("planner", planner(10**9, 10**9, "factual"))], always=True)))
    e = vectors(spark, sf_dir).select(F.col("vec_id").alias("at"), F.col("embedding").alias("vector"))
    own = plans.join(e, F.col("qid") + F.col("variant_no") == F.col("at")).select("qid", "variant_no", "vector")
    found = retrieve_plans(papers(spark, sf_dir), vectors(spark, sf_dir), plans, own)
    held = found.join(papers(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), "id").join(asked, "qid").select("qid", "query", "id", "rank", "text")
    ranked = rerank_ladder(held, [("first", question_share)], 50).select("qid", "id", F.col("new_rank").alias("rank"))
    return evaluate([Configuration("full", "planner, postings, vectors, first", ranked)], judged(spark, sf_dir)).select("config", "status", "n_queries", *METRICS)


def packed_docx(lines: list[str]) -> bytes:
    """A word-processor file: a heading, and a paragraph for each line."""
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    escape = lambda s: "".join(c for c in s if ord(c) >= 32 or c == "\t").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
    body = "".join(f"<w:p>{'' if i else style}<w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for i, line in enumerate(lines))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def mixed_files(spark, sf_dir) -> DataFrame:
    """Documents as files of five kinds ``(path, content)``, below a heading where the kind has any."""

    @F.pandas_udf("binary")
    def content(no: pd.Series, text: pd.Series) -> pd.Series:
        def one(i: int, t: str) -> bytes:
            head, lines = f"Part {i}", (t or "").split("\n")
            escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
            kinds = {
                0: lambda: t or "", 1: lambda: f"# {head}\n" + (t or ""), 3: lambda: packed_docx([head, *lines]),
                2: lambda: f"<html><script>no</script><h1>{head}</h1>" + "".join(f"<p>{escape(x)}</p>" for x in lines) + "</html>",
            }
            made = kinds.get(i % 6, lambda: b"PK")()
            return made if isinstance(made, bytes) else made.encode()

        return pd.Series([one(i, t) for i, t in zip(no, text, strict=True)])

    names = F.array(*[F.lit(x) for x in (".txt", ".MD", ".html", ".docx", ".zip", ".docx")])
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("in/d"), F.col("doc_id").cast("string"), names[(F.col("doc_id") % 6).cast("int")])
    return d.select(path.alias("path"), content("doc_id", "text").alias("content"))


@query(r"""WITH d AS (SELECT doc_id, doc_id % 6 AS kind, coalesce(text, '') AS text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines,
 concat('in/d', CAST(doc_id AS VARCHAR), ['.txt', '.MD', '.html', '.docx', '.zip', '.docx'][doc_id % 6 + 1]) AS path FROM documents),
p AS (SELECT *, CASE kind WHEN 0 THEN 'txt' WHEN 1 THEN 'markdown' WHEN 2 THEN 'html' WHEN 3 THEN 'docx' WHEN 5 THEN 'docx' END AS parser,
 CASE kind WHEN 0 THEN regexp_replace(text, '^\s+|\s+$', '', 'g')
  WHEN 1 THEN regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')), chr(10)), '^\s+|\s+$', '', 'g')
  ELSE array_to_string(lines, chr(10)) END AS said FROM d)
SELECT path, parser, CASE WHEN kind = 4 THEN 'unsupported' WHEN kind = 5 THEN 'error: BadZipFile' WHEN said = '' THEN 'empty' ELSE 'parsed' END AS status,
 CASE WHEN kind < 4 AND said <> '' THEN 0 END AS section_no, CASE WHEN kind IN (1, 2, 3) AND said <> '' THEN concat('Part ', CAST(doc_id AS VARCHAR)) END AS heading, CASE WHEN kind < 4 AND said <> '' THEN said END AS text FROM p""")
def parse_documents(spark, sf_dir):
    """Mixed files, each by its own parser; what has none, or cannot be read, says so."""
    return parse_files(mixed_files(spark, sf_dir))
